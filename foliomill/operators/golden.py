"""Projections of packages for regression tests, their comparison with tolerance for images, and digests.

A projection is one row for each package; values inside it are canonical JSON texts, so that equal values are equal texts.
"""

from __future__ import annotations

import hashlib
import json
import shutil
import struct
from collections.abc import Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import images as I
from foliomill.functions import scalars as S
from foliomill.operators import quality, validation
from foliomill.operators.build import publish
from foliomill.operators.tools import descriptor_faults
from foliomill.sources.packages import json_lines


def canonical_digest(df: DataFrame, keys: Sequence[str], order: str, json: str) -> DataFrame:
    """SHA-256 of each group's records as one compact JSON list in order. A group is one package's record list."""
    rows = F.array_sort(F.collect_list(F.struct(order, json)))
    body = F.concat(F.lit("["), F.array_join(F.transform(rows, lambda x: x[json]), ","), F.lit("]"))
    return df.groupBy(*keys).agg(F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"))


def distinct_versions(df: DataFrame, key: str, version: str) -> DataFrame:
    """A9."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(version)).alias("versions"))


def criteria(*failed: Column) -> Column:
    """Failed if any criterion failed, else partial; never passed as a whole."""
    return F.when(F.coalesce(F.greatest(*[f.cast("int") for f in failed]), F.lit(0)) == 1, "failed").otherwise("partial")


#: What is compared as a whole, and what of each image; bits in which a perceptual hash may differ.
COMPARED = ("format", "format_version", "source", "package_id", "document_sha256", "pages_sha256", "elements_sha256", "omissions_sha256", "page_count", "element_count", "omission_count", "validation", "content_quality")
OF_IMAGES, MOST_BITS = ("path", "width", "height"), 6
NESTED = ("source", "validation", "content_quality")
IMAGES = "array<struct<path:string,width:int,height:int,rgb_sha256:string,dhash:string>>"
PROJECTION = (
    "format string, format_version string, notice string, source string, package_id string, document_sha256 string, pages_sha256 string, elements_sha256 string, omissions_sha256 string, page_count long, element_count long, omission_count long, "
    f"page_images {IMAGES}, engine_fingerprint struct<native:array<string>,recognised:array<string>>, validation string, content_quality string"
)
NOTICE = "A projection for regression tests; it is not a package."
RECORDS = {"pages": "provenance/pages.jsonl", "elements": "provenance/elements.jsonl", "omissions": "provenance/omissions.jsonl"}
#: The files that a package must have, and a golden folder keeps.
STRUCTURED = ("manifest.json", "content/document.xml", *RECORDS.values(), "validation/report.json")


def canonical(value: object) -> str:
    """Compact JSON with sorted names; texts stay as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def element_view(record: dict) -> dict:
    """What a projection keeps of an element: ids, order, places, a hash of its native text, whether text was recognised, never which."""

    def place(source: dict) -> dict:
        texts = {c.get("method"): c.get("text") for c in source.get("candidates") or []}
        native = hashlib.sha256(str(texts.get("native-pdf", "")).encode()).hexdigest()
        return {k: source[k] for k in ("source_id", "physical_page", "logical_page_id", "page_image", "regions")} | {"native_text_sha256": native, "ocr_present": "ocr" in texts, "ocr_nonempty": bool(texts.get("ocr"))}

    kept = {k: record[k] for k in ("element_id", "xml_path", "reading_order")}
    return kept | {"sources": [place(s) for s in record["sources"]], "decision_method": record["decision"]["method"], "revisions": record.get("revisions", []), "resources": record.get("resources", [])}


def report_view(report: dict) -> dict:
    codes = {f"{kind}_codes": sorted(x["code"] for x in report[f"{kind}s"]) for kind in ("error", "warning")}
    return {"valid": report["valid"], "checks": report["checks"], "statistics": report.get("statistics", {})} | codes


VIEWS = {"elements": element_view, "report": report_view, "source": lambda manifest: manifest["sources"][0]}


def canonical_json(text: Column, kind: Column) -> Column:
    """A JSON text's canonical form, or that of what a projection keeps of it (VIEWS); null for what is no such JSON."""

    @F.pandas_udf("string")
    def view(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        def one(text: str | None, kind: str) -> str | None:
            try:
                return canonical(VIEWS.get(kind, lambda x: x)(json.loads(text)))
            except (ValueError, KeyError, TypeError, IndexError, AttributeError):
                return None

        return pd.Series([one(t, k) for t, k in zip(texts, kinds, strict=True)], dtype=object)

    return view(text, kind)


def record_digests(records: DataFrame) -> DataFrame:
    """(package, n and digest of pages, elements and omissions) of records (package, kind, nth, json). A package's records must fit into one row."""

    def of(kind: Column, k: str) -> list[Column]:
        rows = F.array_sort(F.collect_list(F.when(kind, F.struct("nth", "json"))))
        return [F.count_if(kind).alias(f"{k}_n"), rows.alias(f"{k}_rows"), F.count_if(kind & F.col("json").isNull()).alias(f"{k}_bad")]

    viewed = records.select("package", "kind", "nth", canonical_json(F.col("json"), F.col("kind")).alias("json"))
    counted = viewed.groupBy("package").agg(*[c for k in RECORDS for c in of(F.col("kind") == k, k)])
    body = {k: F.concat(F.lit("["), F.array_join(F.transform(f"{k}_rows", lambda x: x["json"]), ","), F.lit("]")) for k in RECORDS}
    faults = F.array_compact(F.array(*[F.when(F.col(f"{k}_bad") > 0, F.lit(f"unreadable records: {k}")) for k in RECORDS]))
    return counted.select("package", *[f"{k}_n" for k in RECORDS], *[F.sha2(F.encode(body[k], "UTF-8"), 256).alias(f"{k}_sha256") for k in RECORDS], faults.alias("record_faults"))


def image_facts(images: DataFrame) -> DataFrame:
    """(package, nth, path, fact) of images (package, nth, path, content): size, a hash of the RGB pixels and a perceptual hash, or an error."""

    @F.pandas_udf("width int, height int, rgb_sha256 string, dhash string, error string")
    def facts(content: pd.Series) -> pd.DataFrame:
        def one(data: bytes | None) -> tuple:
            if data is None:
                return None, None, None, None, "missing"
            try:
                rgb = I.decoded(bytes(data)).rgb
            except (ValueError, struct.error) as e:
                return None, None, None, None, str(e)
            return rgb.shape[1], rgb.shape[0], hashlib.sha256(rgb.tobytes()).hexdigest(), I.perceptual_hash(rgb), None

        out = pd.DataFrame([one(x) for x in content], columns=["width", "height", "rgb_sha256", "dhash", "error"])
        return out.astype({"width": "Int32", "height": "Int32"})

    return images.select("package", "nth", "path", facts("content").alias("fact"))


def engine_versions(elements: DataFrame) -> DataFrame:
    """(package, native, recognised): the versions of the engines behind the candidates of each method, sorted."""
    c = elements.select("package", F.explode_outer(F.flatten(F.transform("sources", lambda s: s["candidates"]))).alias("c"))
    sides = {"native": "native-pdf", "recognised": "ocr"}
    return c.groupBy("package").agg(*[F.sort_array(F.collect_set(F.when(F.col("c.method") == m, F.col("c.engine_version")))).alias(k) for k, m in sides.items()])


def projection(manifests: DataFrame, documents: DataFrame, records: DataFrame, images: DataFrame, versions: DataFrame, reports: DataFrame, quality: DataFrame, *, format_name: str = "foliomill-golden-projection") -> DataFrame:
    """(package, PROJECTION, faults), one row for each manifest; every table is keyed by package.

    manifests (json), documents (document_sha256), records (kind, nth, json), images (nth, path, fact), versions (native, recognised), reports (json), quality (json). What a
    package lacks or what can't be read is named in faults.
    """
    m = manifests.select("package", canonical_json(F.col("json"), F.lit("source")).alias("source"), F.get_json_object("json", "$.package_id").alias("package_id"))
    told = images.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("nth", "path", "fact"))).alias("i"))
    pictures = F.transform("i", lambda x: F.struct(x["path"].alias("path"), *[x["fact"][c].alias(c) for c in ("width", "height", "rgb_sha256", "dhash")])).cast(IMAGES)
    unread = F.transform(F.filter("i", lambda x: x["fact"]["error"].isNotNull()), lambda x: F.concat(F.lit("image "), F.coalesce(x["path"], F.lit("?")), F.lit(": "), x["fact"]["error"]))
    told = told.select("package", pictures.alias("page_images"), unread.alias("image_faults"))
    out = m.join(documents, "package", "left").join(record_digests(records), "package", "left").join(told, "package", "left").join(versions, "package", "left")
    out = out.join(reports.select("package", canonical_json(F.col("json"), F.lit("report")).alias("validation")), "package", "left").join(quality.select("package", canonical_json(F.col("json"), F.lit("")).alias("content_quality")), "package", "left")
    no, none = F.sha2(F.lit("[]").cast("binary"), 256), F.array().cast("array<string>")
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"unreadable: {c}")) for c in ("source", "package_id", "document_sha256", "validation", "content_quality")]))
    values = {
        "format": F.lit(format_name), "format_version": F.lit("1"), "notice": F.lit(NOTICE), **{f"{k}_sha256": F.coalesce(f"{k}_sha256", no) for k in RECORDS}, **{f"{k[:-1]}_count": F.coalesce(f"{k}_n", F.lit(0)).cast("long") for k in RECORDS},
        "page_images": F.coalesce("page_images", F.array().cast(IMAGES)), "engine_fingerprint": F.struct(F.coalesce("native", none).alias("native"), F.coalesce("recognised", none).alias("recognised")),
        "faults": F.concat(lacking, F.coalesce("record_faults", none), F.coalesce("image_faults", none)),
    }
    names = [x.split()[0] for x in PROJECTION.replace(IMAGES, "i").replace("struct<native:array<string>,recognised:array<string>>", "s").split(", ")]
    return out.withColumns(values).select("package", *names, "faults")


def of_packages(p: validation.Package) -> DataFrame:
    """B10 of packages that validation.load has read."""
    text = p.texts.select("package", "path", "text")

    def whole(path: str) -> DataFrame:
        return text.filter(F.col("path") == path).select("package", F.col("text").alias("json"))

    lines = [json_lines(p.texts, path).select("package", F.lit(kind).alias("kind"), F.col("line").alias("nth"), "json") for kind, path in RECORDS.items()]
    records = lines[0].unionByName(lines[1]).unionByName(lines[2])
    held = p.files.filter("kind = 'file'").select("package", "path", "sha256", "content")
    images = lines[0].select("package", "nth", F.get_json_object("json", "$.image").alias("path")).join(held.select("package", "path", "content"), ["package", "path"], "left")
    document = held.filter("path = 'content/document.xml'").select("package", F.col("sha256").alias("document_sha256"))
    measured = quality.of_packages(p)
    report = measured.select("package", F.to_json(F.struct(*[c for c in measured.columns if c != "package"]), {"ignoreNullFields": "false"}).alias("json"))
    found = projection(whole("manifest.json"), document, records, image_facts(images), engine_versions(p.elements), whole("validation/report.json"), report)
    paths = p.files.filter("kind = 'file'").groupBy("package").agg(F.collect_set(F.when(F.col("path").isin(*STRUCTURED), F.col("path"))).alias("have"))
    lost = F.transform(F.array_except(F.array(*map(F.lit, STRUCTURED)), "have"), lambda x: F.concat(F.lit("missing: "), x))
    return paths.select("package", lost.alias("lost")).join(found, "package", "left").withColumn("faults", F.concat("lost", F.coalesce("faults", F.array().cast("array<string>")))).drop("lost")


def read_projections(texts: DataFrame) -> DataFrame:
    """(package, PROJECTION) of projections kept as JSON (package, json); values inside come as canonical JSON. What a text lacks is null."""
    p = texts.select("package", F.from_json("json", PROJECTION).alias("p")).select("package", "p.*")
    return p.withColumns({c: canonical_json(F.col(c), F.lit("")) for c in NESTED})


def as_json(row: dict) -> dict:
    """A projection's row as the value that is kept in a file."""
    kept = {k: v for k, v in row.items() if k not in ("package", "faults")}
    return kept | {k: json.loads(kept[k]) for k in NESTED if kept[k] is not None}


def _bits(a: Column, b: Column) -> Column:
    def half(h: Column, first: int) -> Column:
        return F.conv(F.substring(F.lpad(F.coalesce(h, F.lit("0")), 16, "0"), first, 8), 16, 10).cast("long")

    return S.hamming(half(a, 1), half(b, 1)) + S.hamming(half(a, 9), half(b, 9))


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(package, difference), one row for each key, count or image's value that differs; a package on one side only differs as `package`.

    Images go by position. With the same native engine the pixels must be equal, else perceptual hashes may differ in MOST_BITS bits.
    """
    e = expected.select("package", F.struct(*[c for c in expected.columns if c != "package"]).alias("e"))
    a = actual.select("package", F.struct(*[c for c in actual.columns if c != "package"]).alias("a"))
    both = e.join(a, "package", "full_outer")
    keys = [F.when(~F.col(f"e.{k}").eqNullSafe(F.col(f"a.{k}")), F.lit(k)) for k in COMPARED]
    wanted, seen = (F.coalesce(f"{x}.page_images", F.array().cast(IMAGES)) for x in "ea")
    same_engine = F.col("e.engine_fingerprint.native").eqNullSafe(F.col("a.engine_fingerprint.native"))

    def of_image(z: Column, i: Column) -> Column:
        w, o = z["w"], z["o"]
        plain = [F.when(~w[k].eqNullSafe(o[k]), F.lit(k)) for k in OF_IMAGES]
        pixels = F.when(same_engine, F.when(~w["rgb_sha256"].eqNullSafe(o["rgb_sha256"]), F.lit("rgb_sha256"))).when(_bits(w["dhash"], o["dhash"]) > MOST_BITS, F.lit("dhash"))
        return F.transform(F.array_compact(F.array(*plain, pixels)), lambda k: F.concat(F.lit("page_images["), (i + 1).cast("string"), F.lit("]."), k))

    least = F.least(F.size(wanted), F.size(seen))
    pairs = F.arrays_zip(F.slice(wanted, 1, least).alias("w"), F.slice(seen, 1, least).alias("o"))
    count = F.when(F.size(wanted) != F.size(seen), F.lit("page_images.count"))
    said = F.when(F.col("e").isNull() | F.col("a").isNull(), F.array(F.lit("package"))).otherwise(F.concat(F.array_compact(F.array(*keys, count)), F.flatten(F.transform(pairs, of_image))))
    return both.select("package", F.explode(said).alias("difference"))


def paths(expected: object, actual: object, at: str = "") -> list[str]:
    """Where two JSON values differ: paths of names and positions, each where it first parts."""
    if isinstance(expected, dict) and isinstance(actual, dict):
        return [x for k in sorted(expected.keys() | actual.keys()) for x in (paths(expected[k], actual[k], f"{at}.{k}".lstrip(".")) if k in expected and k in actual else [f"{at}.{k}".lstrip(".")])]
    if isinstance(expected, list) and isinstance(actual, list) and len(expected) == len(actual):
        return [x for i, (e, a) in enumerate(zip(expected, actual, strict=True), 1) for x in paths(e, a, f"{at}[{i}]")]
    return [] if type(expected) is type(actual) and expected == actual else [at]


def stated_source(golden: Path, case_id: str, confirmation: str) -> dict:
    """What a golden folder says of its source; ValueError where the case or the confirmation is another, or the folder is not what it should be."""
    if not case_id or confirmation != case_id or golden.name != case_id:
        raise ValueError(f"the confirmation and the folder's name must be the case id, not {confirmation!r} and {golden.name!r}")
    if golden.is_symlink() or not golden.is_dir():
        raise ValueError("the golden folder must be there, and no link")
    stated = (golden / "source.json").read_bytes()
    faults = descriptor_faults(stated)
    if faults or json.loads(stated)["case_id"] != case_id:
        raise ValueError(f"source.json: {faults or 'another case'}")
    return json.loads(stated)


def update(package: Path, golden: Path, kept: dict, case_id: str, confirmation: str) -> None:
    """Replace a golden folder's files and projection by a package's, as a whole or not at all; ValueError also where the package's source is another."""
    of, source = stated_source(golden, case_id, confirmation), kept["source"]
    origin = source.get("x-origin") or {}
    identity = {"id": "src-001", "role": "primary", "media_type": "application/pdf"} | {k: of[k] for k in ("original_name", "sha256", "size")}
    if any(source.get(k) != v for k, v in identity.items()) or (origin.get("kind"), origin.get("url"), origin.get("sha256")) != ("remote-url", of["url"], of["sha256"]):
        raise ValueError("the package's source is not the one that source.json names")

    def fill(stage: Path) -> None:
        shutil.copytree(golden, stage, dirs_exist_ok=True, ignore=lambda at, _: ["expected"] if Path(at) == golden else [])
        for path in STRUCTURED:
            (stage / "expected" / path).parent.mkdir(parents=True, exist_ok=True)
            shutil.copyfile(package / path, stage / "expected" / path)
        for name, value in (("projection.json", kept), ("quality.json", kept["content_quality"])):
            (stage / name).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8", newline="\n")

    publish(golden, fill, replace=True)


def difference_hash(pixels: Column) -> Column:
    """H17 on a grid of 9 by 8 grey values (an array of 72): bit row * 8 + column is set where the left value is larger; 16 hex digits.

    The resampling to the grid is the caller's; hashes compare only within one resampler.
    """
    def left_is_larger(i: Column) -> Column:
        at = (F.floor(i / 8) * 9 + i % 8).cast("int")
        return F.get(pixels, at) > F.get(pixels, at + 1)

    def half(first: int) -> Column:
        bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: left_is_larger(i + first))
        return F.lpad(F.lower(F.hex(F.aggregate(bits, F.lit(0).cast("long"), lambda acc, i: acc + F.pow(F.lit(2.0), i).cast("long")))), 8, "0")

    return F.concat(half(32), half(0))
