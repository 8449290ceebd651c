"""Package validation: every check is a DataFrame of findings; the report is one aggregation over their union.

Findings have the columns package, code, check, severity, path, line, element_id, source_id, physical_page and message.
Joins carry the package in every key, so any number of packages is validated at once.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.functions import scalars as S
from foliomill.operators import profile
from foliomill.operators.shapes import CHECKS, check_records
from foliomill.sources import packages as P

COLUMNS = {"package": "string", "code": "string", "check": "string", "severity": "string", "path": "string", "line": "int", "element_id": "string", "source_id": "string", "physical_page": "int", "message": "string"}
SCHEMA = ", ".join(f"`{k}` {v}" for k, v in COLUMNS.items())

# --- fixed values of the format -------------------------------------------------------------------------------------
REQUIRED = ("manifest.json", "content/document.xml", "provenance/pages.jsonl", "provenance/elements.jsonl", "provenance/omissions.jsonl", "validation/report.json", "checksums.sha256")
ROOTS = ("manifest.json", "checksums.sha256", "content/", "provenance/", "assets/content/", "assets/evidence/pages/", "assets/sources/", "annotations/", "validation/")
# ----------------------------------------------------------------------------------------------------------------------

REF = "source_id string, physical_page int, logical_page_id string, page_image string"
PAGE = "source_id string, physical_page int, logical_page_id string, width_pt double, height_pt double, rotation_degrees int, image string, image_width_px int, image_height_px int, ocr_status string"
CANDIDATE = "array<struct<method:string,engine:string,engine_version:string,text:string,confidence:double>>"
ELEMENT = (
    "element_id string, xml_path string, reading_order int, sources array<struct<source_id:string,physical_page:int,logical_page_id:string,page_image:string,"
    f"regions:array<struct<bbox:array<double>,polygon:array<array<double>>>>,candidates:{CANDIDATE}>>, decision struct<method:string,confidence:double>, "
    "revisions array<struct<timestamp:string,actor:string,method:string,before:string,after:string,reason:string,evidence:array<struct<source_id:string,physical_page:int,logical_page_id:string,page_image:string,bbox:array<double>>>>>, "
    "resources array<struct<role:string,path:string,media_type:string,sha256:string,source_id:string>>"
)
OMISSION = f"id string, {REF}, bbox array<double>, type string, reason string"
MANIFEST = (
    "package_id string, document struct<id:string,type:string,profile:string,language:string,content:string>, "
    "sources array<struct<id:string,role:string,media_type:string,sha256:string,size:long,page_count:int,source_class:string,extraction_modes:array<string>,embedded_path:string>>, annotations struct<index:string>"
)


@dataclass
class Package:
    """The tables that the checks read."""

    files: DataFrame
    texts: DataFrame
    manifest: DataFrame
    sources: DataFrame
    pages: DataFrame
    elements: DataFrame
    omissions: DataFrame
    nodes: DataFrame
    checksums: DataFrame
    bad: DataFrame


def say(df: DataFrame, code: str, check: str, message: str | Column = "", severity: str = "error", **at: Column | str) -> DataFrame:
    """Findings from the rows of df; `at` gives the places."""
    made = {"code": F.lit(code), "check": F.lit(check), "severity": F.lit(severity), "message": F.lit(message or code) if isinstance(message, str) else message}
    made |= {k: F.col(v) if isinstance(v, str) else v for k, v in at.items()}
    return df.select(*[(F.col("package") if c == "package" else made.get(c, F.lit(None))).cast(t).alias(c) for c, t in COLUMNS.items()])


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _records(texts: DataFrame, path: str, shape: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records that fit their shape, faults of the others)."""
    lines = P.json_lines(texts, path)
    bad = check_records(lines, shape)
    good = lines.join(bad.select("package", "line").distinct(), ["package", "line"], "left_anti")
    return good.select("package", "line", F.from_json("json", schema).alias("r")).select("package", "line", "r.*"), bad


def load(spark: SparkSession, roots: list[tuple[str, str]]) -> Package:
    """A package's tables. The listing is kept, as all tables come from it."""
    files = P.files(spark, roots).cache()
    texts = P.texts(files)
    whole = texts.filter("path = 'manifest.json' AND text IS NOT NULL").select("package", "path", F.lit(None).cast("int").alias("line"), F.col("text").alias("json"))
    bad = [check_records(whole, "manifest").withColumn("check", F.lit("manifest_schema"))]
    manifest = whole.join(bad[0].select("package").distinct(), "package", "left_anti").select("package", F.from_json("json", MANIFEST).alias("m")).select("package", "m.*")
    found = {}
    for name, shape, schema in (("pages", "page", PAGE), ("elements", "element", ELEMENT), ("omissions", "omission", OMISSION)):
        found[name], faults = _records(texts, f"provenance/{name}.jsonl", shape, schema)
        bad.append(faults.withColumn("check", F.lit("element_provenance" if name != "pages" else "asset_integrity")))
    sources = manifest.select("package", F.posexplode("sources").alias("nth", "s")).select("package", "nth", "s.*")
    raw = texts.filter("path = 'checksums.sha256'").select("package", F.posexplode(F.split("text", "\n", -1)).alias("nth", "raw"))
    last = F.max("nth").over(Window.partitionBy("package"))
    checksums = raw.withColumn("last", last).filter("NOT (nth = last AND raw = '')").select("package", (F.col("nth") + 1).alias("line"), "raw", F.regexp_extract("raw", r"^([0-9a-f]{64})  (.+)$", 1).alias("sha256"), F.regexp_extract("raw", r"^([0-9a-f]{64})  (.+)$", 2).alias("path"))
    # each table is read by many checks
    kept = [t.cache() for t in (texts, manifest, sources, found["pages"], found["elements"], found["omissions"], P.xml_nodes(files), checksums, union(bad))]
    return Package(files, *kept)


def check_files(p: Package) -> list[DataFrame]:
    """S9, U1."""
    c, f = "manifest_schema", p.files

    @F.pandas_udf("boolean")
    def is_nfc(paths: pd.Series) -> pd.Series:
        return paths.map(lambda x: unicodedata.is_normalized("NFC", x))

    @F.pandas_udf("string")
    def folded(paths: pd.Series) -> pd.Series:
        return paths.map(str.casefold)

    ok = is_nfc(F.col("path"))
    standard = reduce(or_, [F.col("path").startswith(x) if x.endswith("/") else F.col("path") == x for x in ROOTS])
    need = p.files.select("package").distinct().select("package", F.explode(F.array(*[F.lit(x) for x in REQUIRED])).alias("path"))
    twice = f.select("package", "path", folded(F.col("path")).alias("low")).withColumn("n", F.row_number().over(Window.partitionBy("package", "low").orderBy("path"))).filter("n > 1")
    return [
        say(f.filter("kind = 'link'"), "symbolic_link", c, path="path"),
        say(f.filter(~ok), "path_not_nfc", c, path="path"),
        say(f.filter(ok & ~S.is_package_path(F.col("path"))), "illegal_path_name", c, path="path"),
        say(twice, "casefold_collision", c, path="path"),
        say(f.filter("kind = 'other'"), "non_regular_file", c, path="path"),
        say(f.filter((F.col("kind") == "file") & ~standard), "unexpected_package_path", c, path="path"),
        say(need.join(f.filter("kind = 'file'").select("package", "path"), ["package", "path"], "left_anti"), "required_file_missing", c, path="path"),
    ]


def check_text(p: Package) -> list[DataFrame]:
    """S10."""
    named = F.when(F.col("path").startswith("provenance/"), "element_provenance").when(F.col("path") == "content/document.xml", "xml_well_formed").when(F.col("path") == "checksums.sha256", "checksum_integrity").otherwise("manifest_schema")

    @F.pandas_udf("array<string>")
    def faults(content: pd.Series) -> pd.Series:
        def one(data: bytes) -> list[str]:
            out = ["text_bom"] * data.startswith(b"\xef\xbb\xbf") + ["text_line_endings"] * (b"\r" in data)
            try:
                return out + ["text_not_nfc"] * (not unicodedata.is_normalized("NFC", data.decode("utf-8")))
            except UnicodeDecodeError:
                return [*out, "text_invalid_utf8"]

        return content.map(lambda x: one(bytes(x)))

    found = p.texts.select("package", "path", F.explode(faults(F.col("content"))).alias("found"))
    return [found.select(*[x.cast(t).alias(k) for (k, t), x in zip(COLUMNS.items(), [F.col("package"), F.col("found"), named, F.lit("error"), F.col("path"), *[F.lit(None)] * 4, F.col("found")], strict=True)])]


def check_manifest(p: Package, name_prefix: str | None) -> list[DataFrame]:
    """Unique sources, the primary first, the package id from the primary's digest, annotations on both sides or none."""
    c = "manifest_schema"
    order = Window.partitionBy("package", "id").orderBy("nth")
    index = p.files.filter("path = 'annotations/index.json'").select("package", F.lit(True).alias("has_index"))
    noted = p.manifest.join(index, "package", "left").filter(F.coalesce("has_index", F.lit(False)) != F.col("annotations").isNotNull())
    out = [
        say(p.sources.withColumn("n", F.row_number().over(order)).filter("n > 1"), "duplicate_source_id", c, source_id="id"),
        say(p.sources.filter("nth = 0 AND (id <> 'src-001' OR role <> 'primary')"), "primary_source_order", c, source_id="id"),
        say(noted, "annotation_manifest_mismatch", c),
    ]
    if name_prefix is not None:
        first = p.sources.filter("role = 'primary'").groupBy("package").agg(F.min_by("sha256", "nth").alias("sha"))
        wrong = p.manifest.join(first, "package").filter(F.col("package_id") != F.concat(F.lit("urn:uuid:"), S.uuid5(S.PACKAGE_NAMESPACE, F.concat(F.lit(name_prefix), "sha"))))
        out.append(say(wrong, "package_id_mismatch", c))
    return out


def check_checksums(p: Package) -> list[DataFrame]:
    """S15, J18, W14."""
    c = "checksum_integrity"
    good = p.checksums.filter("path <> ''")
    before = F.lag("path").over(Window.partitionBy("package").orderBy("line"))
    nth = F.row_number().over(Window.partitionBy("package", "path").orderBy("line"))
    listed = good.groupBy("package", "path").agg(F.min_by("sha256", "line").alias("listed"))
    real = p.files.filter("kind = 'file' AND NOT path RLIKE '(^|/)checksums[.]sha256$'").select("package", "path", "sha256")
    both = real.join(listed, ["package", "path"], "full_outer")
    return [
        say(p.checksums.filter("path = ''"), "checksum_syntax", c, line="line", path=F.lit("checksums.sha256")),
        say(good.withColumn("before", before).filter(F.encode("path", "UTF-8") < F.encode("before", "UTF-8")), "checksum_order", c, line="line", path="path"),
        say(good.withColumn("n", nth).filter("n > 1"), "checksum_duplicate", c, line="line", path="path"),
        say(both.filter("listed IS NULL"), "checksum_missing", c, path="path"),
        say(both.filter("sha256 IS NULL"), "checksum_extra", c, path="path"),
        say(both.filter("sha256 <> listed"), "checksum_mismatch", c, path="path"),
    ]


def check_xml(p: Package) -> list[DataFrame]:
    """S14, V6, J14, J16, J21, A10, W18."""
    n, c = p.nodes.filter("error IS NULL"), "cross_references"
    at = {"path": "path", "line": "line"}
    root = n.filter("depth = 0").join(p.manifest.select("package", "document"), "package")
    kind = F.when(F.col("tag") == "article", "article").when(F.col("tag") == "book", "book")
    again = n.filter("id IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("package", "id").orderBy("seq"))).filter("nth > 1")
    ids = n.filter("id IS NOT NULL").select("package", F.col("id").alias("rid")).distinct()
    refs = n.select("package", "path", "line", "tag", "id", F.explode(F.split(F.trim(F.coalesce(F.element_at("attrs", F.lit("rid")), F.lit(""))), r"\s+")).alias("rid")).filter("rid <> ''")
    links = n.filter("tag IN ('graphic', 'media', 'supplementary-material')").withColumn("href", F.element_at("attrs", F.lit("xlink:href"))).filter("href IS NOT NULL")
    links = links.withColumn("target", F.when(F.col("href").startswith("../"), F.expr("substring(href, 4)")))
    safe = F.col("target").isNotNull() & S.is_safe_path(F.col("target")) & F.col("target").startswith("assets/content/")
    spans = F.array(*[F.coalesce(F.element_at("attrs", F.lit(a)), F.lit("1")) for a in ("rowspan", "colspan")])
    cells = n.filter("tag IN ('td', 'th')")
    return [
        say(p.nodes.filter("error IS NOT NULL"), "xml_syntax", "xml_well_formed", F.col("error"), **at),
        say(root.filter(F.coalesce(kind != F.col("document.type"), F.lit(True))), "manifest_document_type_mismatch", c, **at),
        say(root.filter(F.coalesce(F.col("id") != F.col("document.id"), F.lit(True))), "manifest_xml_id_mismatch", c, **at),
        say(root.filter(F.coalesce(F.element_at("attrs", F.lit("xml:lang")) != F.col("document.language"), F.lit(True))), "manifest_xml_language_mismatch", c, **at),
        say(root.filter(kind.isNull()), "manifest_xml_root_mismatch", c, **at),
        say(root.filter(kind.isNull()), "jats_bits_profile_unknown", "jats_bits_schema", **at),
        say(again, "duplicate_xml_id", "id_uniqueness", element_id="id", **at),
        say(refs.join(ids, ["package", "rid"], "left_anti"), "xref_target_missing", c, element_id="rid", **at),
        say(links.filter(~F.coalesce(safe, F.lit(False))), "xml_resource_path_invalid", c, **at),
        say(links.filter(safe).drop("path").withColumnRenamed("target", "path").join(p.files.filter("kind = 'file'").select("package", "path"), ["package", "path"], "left_anti"), "xml_resource_missing", c, **at),
        say(n.filter(F.col("tag").isin("media", "supplementary-material") & F.element_at("attrs", F.lit("mimetype")).isNull() & F.element_at("attrs", F.lit("mime-subtype")).isNull()), "media_mime_missing", c, **at),
        say(cells.filter(F.exists(spans, lambda x: ~x.rlike("^[1-9][0-9]*$"))), "table_span_invalid", c, element_id="id", **at),
        say(n.filter("tag = 'tex-math'"), "formula_parser_unavailable", c, **at),
        *table_grid(n),
    ]


def table_grid(nodes: DataFrame) -> list[DataFrame]:
    """The cells of a table placed row by row; cells that overlap, rows whose width is not the first row's. Spans that reach a row from above count."""
    schema = "package string, path string, line int, code string"

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        taken: dict[tuple[int, int], int] = {}
        out, at = [], {}
        rows = rows.sort_values("seq")
        order = {r: i for i, r in enumerate(dict.fromkeys(rows["row"]))}
        for r, line, down, right in zip(rows["row"], rows["line"], rows["down"], rows["right"], strict=True):
            y, x = order[r], at.get(r, 0)
            while (y, x) in taken:
                x += 1
            for dy in range(down):
                for dx in range(right):
                    if (y + dy, x + dx) in taken:
                        out.append((*key[:2], line, "table_cell_overlap"))
                    taken[y + dy, x + dx] = line
            at[r] = x + right
        width = {y: 1 + max((x for yy, x in taken if yy == y), default=-1) for y in order.values()}
        first = {order[r]: line for r, line in zip(rows["row"][::-1], rows["line"][::-1], strict=True)}
        out += [(*key[:2], first[y], "table_row_width_mismatch") for y, w in width.items() if w != width[0]]
        return pd.DataFrame(out, columns=["package", "path", "line", "code"])

    tables = nodes.filter("tag = 'table'").select("package", F.col("seq").alias("table"))
    rows = nodes.filter("tag = 'tr'").select("package", F.col("seq").alias("row"))
    top = F.last(F.when(F.col("tag") == "table", F.col("seq")), ignorenulls=True).over(Window.partitionBy("package").orderBy("seq"))
    span = [F.coalesce(F.element_at("attrs", F.lit(a)).try_cast("int"), F.lit(1)) for a in ("rowspan", "colspan")]
    cells = nodes.withColumn("table", top).filter("tag IN ('td', 'th')").select("package", "path", "line", "seq", "table", F.col("parent").alias("row"), span[0].alias("down"), span[1].alias("right"))
    cells = cells.join(rows, ["package", "row"], "left_semi").join(tables, ["package", "table"], "left_semi").filter("down BETWEEN 1 AND 1000 AND `right` BETWEEN 1 AND 1000")
    found = cells.groupBy("package", "path", "table").applyInPandas(place, schema)
    return [say(found.filter(F.col("code") == code), code, "cross_references", path="path", line="line") for code in ("table_cell_overlap", "table_row_width_mismatch")]


def png_facts(content: DataFrame) -> DataFrame:
    """(package, path, error, width, height, colour, x_ppm, y_ppm) of image files: signature, chunks with their checksums, decoded size."""

    def read(data: bytes) -> tuple:
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            return "not a PNG", None, None, None, None, None
        at, w, h, depth, colour, ppm, packed = 8, None, None, 0, None, (None, None), []
        try:
            while at < len(data):
                size, kind = struct.unpack(">I4s", data[at : at + 8])
                body, (crc,) = data[at + 8 : at + 8 + size], struct.unpack(">I", data[at + 8 + size : at + 12 + size])
                if crc != zlib.crc32(kind + body):
                    return "chunk checksum", w, h, colour, *ppm
                if kind == b"IHDR":
                    w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
                elif kind == b"pHYs" and body[8] == 1:
                    ppm = struct.unpack(">II", body[:8])
                elif kind == b"IDAT":
                    packed.append(body)
                at += 12 + size
            bits = depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
            if not laced and len(zlib.decompress(b"".join(packed))) != h * (1 + (w * bits + 7) // 8):
                return "image data size", w, h, colour, *ppm
            return None, w, h, colour, *ppm
        except (struct.error, zlib.error, KeyError, TypeError, IndexError) as e:
            return f"broken: {type(e).__name__}", w, h, colour, *ppm

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([(p, x, *read(bytes(c))) for p, x, c in zip(b["package"], b["path"], b["content"], strict=True)], columns=["package", "path", "error", "width", "height", "colour", "x_ppm", "y_ppm"])
            for c in ("width", "height", "colour", "x_ppm", "y_ppm"):
                out[c] = out[c].astype("Int64")
            yield out

    return content.select("package", "path", "content").mapInPandas(run, "package string, path string, error string, width long, height long, colour long, x_ppm long, y_ppm long")


def check_pages(p: Package) -> list[DataFrame]:
    """V7: J19, J20, A10, A11, H22."""
    c, g = "asset_integrity", p.pages
    at = {"source_id": "source_id", "physical_page": "physical_page", "line": "line"}
    nth = F.row_number().over(Window.partitionBy("package", "source_id", "physical_page").orderBy("line"))
    nth_logical = F.row_number().over(Window.partitionBy("package", "source_id", "logical_page_id").orderBy("line"))
    real = p.files.filter("kind = 'file'").select("package", F.col("path").alias("image"), F.col("content"))
    listed = g.select("package", F.col("image").alias("path"))
    stray = p.files.filter("kind = 'file' AND path LIKE 'assets/evidence/pages/%'").join(listed, ["package", "path"], "left_anti")
    per = g.groupBy("package", "source_id").agg(F.count("*").alias("n"), F.countDistinct("physical_page").alias("d"), F.min("physical_page").alias("low"), F.max("physical_page").alias("high"))
    src = p.sources.select("package", F.col("id").alias("source_id"), "role", "page_count", "embedded_path", "sha256", "size")
    missing = src.join(per, ["package", "source_id"], "left").filter("n IS NULL OR d <> page_count OR low <> 1 OR high <> page_count OR n <> d")
    primary = g.join(src.filter("role = 'primary'").select("package", "source_id"), ["package", "source_id"]).filter(F.col("logical_page_id") != S.logical_page(F.col("physical_page")))
    kept = src.filter("embedded_path IS NOT NULL").join(p.files.filter("kind = 'file'").select("package", F.col("path").alias("embedded_path"), F.col("sha256").alias("s"), F.col("size").alias("z")), ["package", "embedded_path"], "left")
    facts = png_facts(g.join(real, ["package", "image"]).select("package", F.col("image").alias("path"), "content"))
    seen = g.withColumnRenamed("image", "path").join(facts, ["package", "path"])
    turned = F.col("rotation_degrees").isin(90, 270)
    wide, high = F.when(turned, F.col("height_pt")).otherwise(F.col("width_pt")), F.when(turned, F.col("width_pt")).otherwise(F.col("height_pt"))
    ppm = S.DPI / 0.0254
    good = seen.filter("error IS NULL")
    return [
        say(g.withColumn("n", nth).filter("n > 1"), "duplicate_physical_page", c, **at),
        say(g.withColumn("n", nth_logical).filter("n > 1"), "logical_page_conflict", c, **at),
        say(g.filter(F.col("image") != S.page_image(F.col("source_id"), F.col("physical_page"))), "page_image_path_mismatch", c, path="image", **at),
        say(g.filter("ocr_status = 'failed'"), "ocr_failed", c, **at),
        say(g.join(real.select("package", "image"), ["package", "image"], "left_anti"), "page_image_missing", c, path="image", **at),
        say(stray, "undeclared_page_image", c, path="path"),
        say(missing, "page_sequence", c, source_id="source_id"),
        say(primary, "primary_logical_page_id", c, **at),
        say(kept.filter("s IS NULL"), "embedded_source_missing", c, path="embedded_path", source_id="source_id"),
        say(kept.filter("s <> sha256 OR z <> size"), "embedded_source_integrity", c, path="embedded_path", source_id="source_id"),
        say(g.join(src.select("package", "source_id"), ["package", "source_id"], "left_anti").join(p.manifest.select("package"), "package", "left_semi"), "unknown_page_source", c, **at),
        say(seen.filter("error IS NOT NULL"), "image_decode", c, F.col("error"), path="path", **at),
        say(good.filter("width <> image_width_px OR height <> image_height_px"), "page_pixel_size_mismatch", c, path="path", **at),
        say(good.filter(~S.pixels_match(wide, F.col("width")) | ~S.pixels_match(high, F.col("height"))), "page_dpi_geometry", c, path="path", **at),
        say(good.filter(F.coalesce((F.abs(F.col("x_ppm") - ppm) > 40) | (F.abs(F.col("y_ppm") - ppm) > 40), F.lit(True))), "png_dpi_metadata", c, path="path", **at),
        say(good.filter("colour NOT IN (2, 6)"), "png_not_srgb_compatible", c, path="path", **at),
    ]


def _boxed(b: Column) -> Column:
    return S.bbox_is_valid(b[0], b[1], b[2], b[3])


def check_elements(p: Package) -> list[DataFrame]:
    """V8: J9, J10, J12, J13, W13 to W15, F17, F19."""
    c, e, out = "element_provenance", p.elements, []
    at = {"element_id": "element_id", "line": "line"}
    n = p.nodes.filter("error IS NULL AND id IS NOT NULL")
    wanted = n.filter(F.col("tag").isin(*profile.ADDRESSABLE))
    have = n.select("package", F.col("id").alias("element_id"), F.col("seq").alias("node"), "tag", F.col("full_text").alias("xml_text"))
    again = e.withColumn("n", F.row_number().over(Window.partitionBy("package", "element_id").orderBy("line"))).filter("n > 1")
    out += [
        say(again, "duplicate_element_provenance", c, **at),
        say(e.join(have, ["package", "element_id"], "left_anti"), "provenance_xml_id_missing", c, **at),
        say(e.filter(F.col("xml_path") != F.concat(F.lit("//*[@id='"), "element_id", F.lit("']"))), "xml_path_noncanonical", c, **at),
        say(wanted.select("package", F.col("id").alias("element_id"), "line", "path").join(e, ["package", "element_id"], "left_anti"), "element_provenance_missing", c, **at),
        say(e.join(have, ["package", "element_id"]).filter(~F.col("tag").isin(*profile.ADDRESSABLE)), "provenance_for_nonrequired_element", c, severity="warning", **at),
    ]
    order = F.row_number().over(Window.partitionBy("package").orderBy("line"))
    by_node = F.row_number().over(Window.partitionBy("package").orderBy("node"))
    ranked = e.join(have, ["package", "element_id"]).withColumns({"by_order": F.row_number().over(Window.partitionBy("package").orderBy("reading_order", "line")), "by_node": by_node})
    out += [
        say(e.withColumn("nth", order).groupBy("package").agg(F.count("*").alias("n"), F.countDistinct("reading_order").alias("d"), F.min("reading_order").alias("low"), F.max("reading_order").alias("high")).filter("n <> d OR low <> 1 OR high <> n"), "reading_order_sequence", c),
        say(ranked.filter("by_order <> by_node").select("package").distinct(), "reading_order_xml_mismatch", c),
    ]
    s = e.select("package", "line", "element_id", "decision", F.posexplode("sources").alias("nth", "s")).select("package", "line", "element_id", "decision", "nth", "s.*")
    here = {"source_id": "source_id", "physical_page": "physical_page", **at}
    one = Window.partitionBy("package", "line").orderBy("nth")
    key = F.struct("source_id", "physical_page")
    page = p.pages.select("package", "source_id", "physical_page", F.col("logical_page_id").alias("l2"), F.col("image").alias("i2"))
    paged = s.join(page, ["package", "source_id", "physical_page"], "left")
    kind = p.sources.select("package", F.col("id").alias("source_id"), "source_class", "extraction_modes")
    methods = F.transform("candidates", lambda x: x["method"])
    classed = s.join(kind, ["package", "source_id"], "left")
    native = (F.col("source_class") == "born-digital") | ((F.col("source_class") == "hybrid") & F.array_contains("extraction_modes", "native-pdf"))
    out += [
        say(s.withColumn("before", F.lag(key).over(one)).filter(key < F.col("before")), "element_sources_order", c, **here),
        say(s.withColumn("n", F.row_number().over(Window.partitionBy("package", "line", "source_id", "physical_page").orderBy("nth"))).filter("n > 1"), "duplicate_element_page", c, **here),
        say(paged.filter("l2 IS NULL"), "element_page_missing", c, **here),
        say(paged.filter("l2 <> logical_page_id OR i2 <> page_image"), "element_page_reference_mismatch", c, **here),
        say(classed.join(have.select("package", "element_id", "tag"), ["package", "element_id"], "left").filter((F.coalesce("tag", F.lit("")) != "fig") & ~F.array_contains(methods, "ocr")), "ocr_candidate_missing", c, **here),
        say(classed.join(have.select("package", "element_id", "tag"), ["package", "element_id"], "left").filter((F.coalesce("tag", F.lit("")) != "fig") & native & ~F.array_contains(methods, "native-pdf")), "native_candidate_missing", c, **here),
        say(s.groupBy("package", "line", "element_id", "decision").agg(F.flatten(F.collect_list(methods)).alias("m")).filter("decision.method <> 'reconciled' AND decision.method <> 'manual' AND NOT array_contains(m, decision.method)"), "decision_candidate_missing", c, **at),
    ]
    r = s.select("package", "line", "element_id", "source_id", "physical_page", "nth", F.posexplode("regions").alias("k", "r")).select("package", "line", "element_id", "source_id", "physical_page", "nth", "k", "r.*")
    rows = Window.partitionBy("package", "line", "nth").orderBy("k")
    place = F.struct(F.col("bbox")[1], F.col("bbox")[0])
    xs, ys = F.transform("polygon", lambda q: q[0]), F.transform("polygon", lambda q: q[1])
    hull = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    off = F.exists(F.zip_with(hull, "bbox", lambda a, b: F.abs(a - b)), lambda d: d > 1e-6)
    out += [
        say(r.withColumn("before", F.lag(place).over(rows)).filter(place < F.col("before")), "element_regions_order", c, **here),
        say(r.filter(~_boxed(F.col("bbox"))), "bbox_order", c, **here),
        say(r.filter(F.col("polygon").isNotNull() & off), "polygon_bbox_mismatch", c, **here),
    ]
    v = e.select("package", "line", "element_id", "decision", F.posexplode("revisions").alias("nth", "v")).select("package", "line", "element_id", "nth", "v.*")
    chain = Window.partitionBy("package", "line").orderBy("nth")
    v = v.withColumns({"earlier": F.lag("timestamp").over(chain), "said": F.lag("after").over(chain), "later": F.lead("timestamp").over(chain)})
    final = v.filter("later IS NULL").join(have, ["package", "element_id"])
    proof = v.select("package", "line", "element_id", F.explode("evidence").alias("x")).select("package", "line", "element_id", "x.*").join(page, ["package", "source_id", "physical_page"], "left")
    manual = e.filter("decision.method = 'manual'").filter(~F.exists(F.col("revisions"), lambda x: x["method"] == "manual"))
    flat = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    out += [
        say(manual, "manual_revision_missing", c, **at),
        say(v.filter("timestamp < earlier"), "revision_order", c, **at),
        say(v.filter("said <> before"), "revision_chain_broken", c, **at),
        say(final.filter(flat(F.col("after")) != flat(F.col("xml_text"))), "revision_final_mismatch", c, **at),
        say(proof.filter("l2 IS NULL OR l2 <> logical_page_id OR i2 <> page_image"), "revision_evidence_page_mismatch", c, **here),
        say(proof.filter(~_boxed(F.col("bbox"))), "revision_evidence_bbox", c, **here),
    ]
    a = "asset_integrity"
    q = e.select("package", "line", "element_id", F.explode("resources").alias("x")).select("package", "line", "element_id", "x.*").join(p.files.filter("kind = 'file'").select("package", "path", F.col("sha256").alias("real")), ["package", "path"], "left")
    guessed = S.mime_of(F.col("path"))
    with_source = q.filter("source_id IS NOT NULL").join(p.sources.select("package", F.col("id").alias("source_id")), ["package", "source_id"], "left_anti")
    out += [
        say(q.filter("real IS NULL"), "element_resource_missing", a, path="path", **at),
        say(q.filter("real <> sha256"), "element_resource_hash", a, path="path", **at),
        say(q.filter(guessed.isNotNull() & (guessed != F.col("media_type"))), "element_resource_mime", a, path="path", **at),
        say(with_source, "element_resource_source_missing", a, path="path", source_id="source_id", **at),
    ]
    return out


def check_omissions(p: Package) -> list[DataFrame]:
    """V9."""
    c, o = "element_provenance", p.omissions
    here = {"source_id": "source_id", "physical_page": "physical_page", "line": "line", "element_id": "id"}
    page = p.pages.select("package", "source_id", "physical_page", F.col("logical_page_id").alias("l2"), F.col("image").alias("i2"))
    paged = o.join(page, ["package", "source_id", "physical_page"], "left")
    nth = F.row_number().over(Window.partitionBy("package", "id").orderBy("line"))
    return [
        say(o.withColumn("n", nth).filter("n > 1"), "duplicate_omission_id", c, **here),
        say(paged.filter("l2 IS NULL OR l2 <> logical_page_id OR i2 <> page_image"), "omission_page_mismatch", c, **here),
        say(o.filter(~_boxed(F.col("bbox"))), "omission_bbox_order", c, **here),
    ]


#: Tags that an annotation's XML may hold.
INLINE = ("bold", "italic", "monospace", "sup", "sub", "underline", "ext-link", "xref")


def check_annotations(p: Package) -> list[DataFrame]:
    """V10, J17."""
    c = "cross_references"
    index = p.texts.filter("path = 'annotations/index.json'").select("package", "path", F.lit(None).cast("int").alias("line"), F.col("text").alias("json"))
    bad = check_records(index, "layers").withColumn("check", F.lit(c))
    layers = index.select("package", F.explode(F.from_json("json", "layers array<struct<id:string,kind:string,language:string,path:string>>")["layers"]).alias("l")).select("package", "l.*")
    again = layers.withColumn("n", F.row_number().over(Window.partitionBy("package", "id").orderBy("path"))).filter("n > 1")
    lines = p.texts.filter(F.col("path").rlike(r"^annotations/.*\.jsonl$")).select("package", "path", F.posexplode(F.split("text", "\n", -1)).alias("nth", "json")).filter("trim(json) <> ''").withColumn("line", F.col("nth") + 1)
    notes = lines.select("package", "path", "line", F.from_json("json", "target_id string, kind string, language string, content_text string, content_xml string").alias("r")).select("package", "path", "line", "r.*")
    ids = p.nodes.filter("id IS NOT NULL").select("package", F.col("id").alias("target_id")).distinct()
    at = {"path": "path", "line": "line", "element_id": "target_id"}
    typed = notes.join(layers.select("package", "path", F.col("kind").alias("k2"), F.col("language").alias("g2")), ["package", "path"])

    @F.pandas_udf("array<string>")
    def tags(xml: pd.Series) -> pd.Series:
        def one(x: str) -> list[str]:
            nodes, error, _ = P.parse_xml(f"<x xmlns:xlink='{P.XLINK}'>{x}</x>".encode())
            return ["!"] if error else [n["tag"] for n in nodes[1:] if n["tag"] not in INLINE]

        return xml.map(one)

    odd = notes.filter("content_xml IS NOT NULL").withColumn("odd", F.explode(tags(F.col("content_xml"))))
    return [
        _shaped(bad.unionByName(check_records(lines.select("package", "path", "line", "json"), "annotation").withColumn("check", F.lit(c)))),
        say(again, "annotation_layer_duplicate", c, path="path"),
        say(notes.join(ids, ["package", "target_id"], "left_anti"), "annotation_target_missing", c, **at),
        say(typed.filter("kind <> k2 OR language <> g2"), "annotation_layer_mismatch", c, **at),
        say(odd.filter("odd = '!'"), "annotation_xml_syntax", c, **at),
        say(odd.filter("odd <> '!'"), "annotation_xml_element", c, F.col("odd"), **at),
    ]


def check_coverage(p: Package, evidence: DataFrame | None) -> list[DataFrame]:
    """Evidence is (package, json), or None where nobody audited the pages."""
    c = "page_coverage"
    every = p.files.select("package").distinct()
    if evidence is None:
        return [say(every, "page_coverage_not_audited", c)]
    asked = evidence.select("package", F.lit("coverage").alias("path"), F.lit(None).cast("int").alias("line"), "json")
    bad = check_records(asked, "coverage").select("package").distinct()
    read = evidence.join(bad, "package", "left_anti").select("package", F.from_json("json", "reviewed_pages array<struct<source_id:string,physical_page:int>>, uncovered_objects array<struct<source_id:string,physical_page:int,description:string>>").alias("v"))
    reviewed = read.select("package", F.explode("v.reviewed_pages").alias("x")).select("package", "x.*").distinct()
    have = p.pages.select("package", "source_id", "physical_page").distinct().join(read.select("package"), "package", "left_semi")
    differ = have.subtract(reviewed).unionByName(reviewed.subtract(have)).select("package").distinct()
    left = read.select("package", F.explode("v.uncovered_objects").alias("x")).select("package", "x.*")
    return [
        say(every.join(evidence.select("package"), "package", "left_anti"), "page_coverage_not_audited", c),
        say(bad, "coverage_evidence_invalid", c),
        say(differ, "coverage_pages_incomplete", c),
        say(left, "uncovered_visible_object", c, F.col("description"), source_id="source_id", physical_page="physical_page"),
    ]


def _shaped(bad: DataFrame) -> DataFrame:
    return bad.select(*[(F.col(c) if c in ("package", "path", "line", "code", "message", "check") else F.lit("error") if c == "severity" else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def finding_groups(p: Package, *, name_prefix: str | None = None, evidence: DataFrame | None = None, has_xsd: bool = False) -> list[DataFrame]:
    """The findings in groups, each a plan of its own. Without a plug-in for XSD schemas that check fails with `jats_bits_engine_error`, as it must (V3)."""
    groups = [check_files(p), check_text(p), check_manifest(p, name_prefix), check_checksums(p), check_xml(p), check_pages(p), check_elements(p), check_omissions(p), check_annotations(p), check_coverage(p, evidence)]
    parts = [_shaped(p.bad), *[union(g) for g in groups]]
    rules = profile.violations(p.nodes.filter("error IS NULL"))
    code = F.when(F.col("severity") == "warning", "p2h_profile_warning").otherwise("p2h_profile_violation")
    made = {"package": F.col("package"), "code": code, "check": F.lit("p2h_profile"), "severity": F.col("severity"), "path": F.col("path"), "line": F.col("line"), "element_id": F.col("id"), "message": F.col("rule")}
    parts.append(rules.select(*[made.get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()]))
    if not has_xsd:
        parts.append(say(p.nodes.filter("error IS NULL AND depth = 0"), "jats_bits_engine_error", "jats_bits_schema", "no schema engine", path="path"))
    safe = F.when(F.col("path").isNull() | S.is_safe_path(F.col("path")), F.col("path")).otherwise(F.concat(F.lit("x-invalid-path/"), F.sha2("path", 256)))
    return [x.withColumn("path", safe) for x in parts]


def findings(p: Package, **options) -> DataFrame:
    """All findings (options as in finding_groups). Each group is kept by itself: one plan of a hundred branches would be planned anew at every stage."""
    return union([g.cache() for g in finding_groups(p, **options)])


OPERATIONAL = ("jats_bits_engine_error", "schematron_engine_error", "schema_engine_error", "formula_parser_unavailable", "formula_parser_engine_error", "package_not_directory", "validator_operational_error")


def reports(p: Package, found: DataFrame) -> DataFrame:
    """One row for each package: valid, checks, statistics, exit_code."""
    every = p.files.select("package").distinct()
    errors = found.filter("severity = 'error'").groupBy("package", "check").agg(F.bool_and(F.col("code") == "page_coverage_not_audited").alias("open"))
    grid = every.select("package", F.explode(F.array(*[F.lit(c) for c in CHECKS])).alias("check"))
    status = F.when(F.col("open"), "partial").when(F.col("open").isNotNull(), "failed").otherwise("passed")
    grid = grid.join(errors, ["package", "check"], "left").withColumn("status", status)
    checks = grid.groupBy("package").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("check", "status")))).alias("checks"), F.bool_and(F.col("status") == "passed").alias("passed"))
    numbers = found.groupBy("package").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.bool_or(F.col("code").isin(*OPERATIONAL)).alias("operational"))
    out = checks.join(numbers, "package", "left").na.fill(0, ["errors", "warnings"])
    for name, df in (("sources", p.sources), ("pages", p.pages), ("elements", p.elements), ("omissions", p.omissions)):
        out = out.join(df.groupBy("package").agg(F.count("*").alias(name)), "package", "left").na.fill(0, [name])
    stats = F.create_map(*[x for n in ("sources", "pages", "elements", "omissions", "errors", "warnings") for x in (F.lit(n), F.col(n))])
    valid = F.col("passed") & (F.col("errors") == 0)
    code = F.when(F.coalesce("operational", F.lit(False)), 2).when(valid, 0).otherwise(1)
    return out.select("package", valid.alias("valid"), "checks", stats.alias("statistics"), code.alias("exit_code"))


def report_json(row, at: str) -> str:
    """K1, K7: a report as its JSON text."""
    return json.dumps({"valid": row["valid"], "validated_at": at, "checks": row["checks"], "statistics": row["statistics"]}, ensure_ascii=False, indent=2) + "\n"
