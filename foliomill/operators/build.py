"""Packages from blocks: ids, XML, provenance records, manifest, checksums, and sinks that write them.

Blocks are rows (doc_id, nth, kind, page, text, x0, y0, x1, y1); kinds are title, author, affiliation, abstract, heading, paragraph,
reference, figure, note, publication (`label|kind of id|id`), date (`day month year`) and contribution (a note on equal shares). An optional
column `marks` (array of strings) holds the labels of an author's affiliations and `†` for the note. Everything is keyed by doc_id; one
document's XML is one row.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
from collections import namedtuple
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.functions import scalars as S

PREFIX = {"author": "author", "affiliation": "aff", "abstract": "abstract", "heading": "sec", "paragraph": "p", "reference": "ref", "figure": "fig", "note": "p", "title": "title", "publication": "journal-id", "date": "date", "contribution": "fn"}


REVISION = "struct<actor:string,method:string,before:string,after:string,reason:string>"


def with_ids(blocks: DataFrame) -> DataFrame:
    """An id for each block, counted by kind in order; headings count sections, and their titles start at 3; notes and the abstract's paragraph count first."""
    kind = F.when(F.col("kind") == "note", "paragraph").otherwise(F.col("kind"))
    first = F.when(F.col("kind") == "note", 0).otherwise(1)
    nth = F.row_number().over(Window.partitionBy("doc_id", kind).orderBy(first, "nth"))
    has_abstract = F.max(F.when(F.col("kind") == "abstract", 1).otherwise(0)).over(Window.partitionBy("doc_id"))
    shifted = nth + F.when(kind == "paragraph", has_abstract).otherwise(0)
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv]), F.col("kind"))
    return blocks.withColumn("element_id", F.when(F.col("kind") == "title", F.lit("title-000002")).otherwise(F.concat(prefix, F.lit("-"), F.lpad(shifted.cast("string"), 6, "0"))))


def documents(blocks: DataFrame, *, journal: str = "Unknown publication", language: str = "en", texts: bool = False) -> DataFrame:
    """(doc_id, xml, nodes): each document's XML, and (element_id, nth block, part) of its addressable elements in document order; `texts`: with their blocks' texts."""
    fields = ["element_id", "nth", "part", *["text"] * texts]
    schema = f"doc_id long, xml string, nodes array<struct<{','.join(f'{c}:int' if c == 'nth' else f'{c}:string' for c in fields)}>>"

    def render(rows: list[tuple]) -> tuple[str, list[tuple]]:
        by: dict[str, list] = {}
        for r in rows:
            by.setdefault(r.kind, []).append(r)
        out, nodes = [], []

        def put(tag: str, ident: str | None, text: str, nth: int | None, part: str = "", attrs: str = "") -> str:
            if ident:
                nodes.append((ident, nth, part))
            return f"<{tag}{f' id={quoteattr(ident)}' if ident else ''}{attrs}>{escape(text)}</{tag}>"

        out.append('<?xml version="1.0" encoding="UTF-8"?>\n<article xmlns:xlink="http://www.w3.org/1999/xlink" id="doc-000001" dtd-version="1.3" xml:lang=' + quoteattr(language) + ">\n<front><journal-meta><journal-title-group>")
        at = by.get("publication", [None])[0]
        label, id_type, number = (at.text.split("|") + ["", ""])[:3] if at else (journal, "", "")
        known = at.nth if at else None
        if at:
            out.insert(1, put("journal-id", at.element_id, label, known, attrs=' journal-id-type="publisher-id"'))
            out[0], out[1] = out[0].removesuffix("<journal-title-group>"), out[1] + "<journal-title-group>"
        out.append(put("journal-title", "title-000001", label, known) + "</journal-title-group>")
        if at:
            preprint = label == "arXiv"
            out.append(put("issn", "issn-000001" if preprint else None, S.PREPRINT_ISSN if preprint else "", known, attrs=f' publication-format="electronic" specific-use="{"registry-derived" if preprint else "not-applicable"}"'))
        out.append("</journal-meta><article-meta>" + (put("article-id", "article-id-000001", number, known, attrs=f" pub-id-type={quoteattr(id_type)}") if number else "") + "<title-group>")
        title = by.get("title", [None])[0]
        out.append(put("article-title", "title-000002", title.text if title else "Untitled", title.nth if title else None) + "</title-group>")
        held = by.get("contribution", [None])[0]
        labels = {m[1]: r.element_id for r in by.get("affiliation", []) if (m := re.match(r"(\d+)", r.text))}
        if by.get("author"):
            out.append("<contrib-group>")
            for i, r in enumerate(by["author"], 1):
                given, _, surname = r.text.strip().rpartition(" ")
                marks = getattr(r, "marks", None)
                rids = [("aff", labels[x], x) for x in (marks if marks is not None else ()) if x in labels]
                rids += [("author-notes", held.element_id, "†")] if held is not None and marks is not None and "†" in marks else []
                seen = "".join(f'<xref ref-type="{kind}" rid="{rid}">{escape(x)}</xref>' for kind, rid, x in rids)
                nodes += [(r.element_id, r.nth, "contrib"), (f"name-{i:06d}", r.nth, "name")]
                out.append(f'<contrib id="{r.element_id}" contrib-type="author"><name id="name-{i:06d}" name-style="western"><surname>{escape(surname)}</surname>' + (f"<given-names>{escape(given)}</given-names>" if given else "") + f"</name>{seen}</contrib>")
            out.append("</contrib-group>")
        for r in by.get("affiliation", []):
            m = re.match(r"(\d+)\s*(.*)$", r.text, re.S)
            nodes.append((r.element_id, r.nth, ""))
            out.append(f'<aff id="{r.element_id}">' + (f"<label>{m[1]}</label> {escape(m[2])}" if m else escape(r.text)) + "</aff>")
        if held is not None:
            nodes.append((held.element_id, held.nth, "fn"))
            out.append(f'<author-notes><fn id="{held.element_id}" fn-type="equal"><label>†</label>' + put("p", None, re.sub(r"^†\s*", "", held.text), None) + "</fn></author-notes>")
        for r in by.get("date", [])[:1]:
            day, month, year = (r.text.split() + ["", "", ""])[:3]
            nodes.append((r.element_id, r.nth, ""))
            out.append(f'<pub-date id="{r.element_id}" date-type="preprint" publication-format="electronic"><day>{escape(day)}</day><month>{escape(month)}</month><year>{escape(year)}</year></pub-date>')
        for r in by.get("abstract", [])[:1]:
            nodes.append((r.element_id, r.nth, ""))
            out.append(f'<abstract id="{r.element_id}">' + put("p", "p-000001", r.text, r.nth) + "</abstract>")
        out.append("</article-meta></front>\n<body>")
        depth, heads = 0, 2
        for r in rows:
            if r.kind == "heading":
                level = 2 if re.match(r"[A-Z]\d+\.", r.text) and depth else 1
                out.append("</sec>" * max(0, depth - level + 1))
                depth, heads = level, heads + 1
                nodes.append((r.element_id, r.nth, "sec"))
                out.append(f'<sec id="{r.element_id}">' + put("title", f"title-{heads:06d}", r.text, r.nth))
            elif r.kind in ("paragraph", "note"):
                out.append(put("p", r.element_id, r.text, r.nth))
            elif r.kind == "figure":
                n = r.element_id.rpartition("-")[2]
                nodes += [(r.element_id, r.nth, "fig"), (f"caption-{n}", r.nth, "caption")]
                out.append(f'<fig id="{r.element_id}"><caption id="caption-{n}"><title>{escape(r.text)}</title></caption><graphic xlink:href="../assets/content/{r.element_id}.png"/></fig>')
        out.append("</sec>" * depth + "</body>\n<back>")
        if by.get("reference"):
            out.append("<ref-list>")
            for r in by["reference"]:
                m = re.match(r"\[(\d+)\]\s*(.*)$", r.text, re.S)
                nodes.append((r.element_id, r.nth, ""))
                out.append(f'<ref id="{r.element_id}">' + (f"<label>{m[1]}</label>" if m else "") + f"<mixed-citation>{escape(m[2] if m else r.text)}</mixed-citation></ref>")
            out.append("</ref-list>")
        out.append("</back>\n</article>\n")
        return "".join(out), nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = namedtuple("block", needed)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                xmls, ends, found = [], [0], []
                for held in part.column(1):
                    rows = [block(*r) for r in zip(*[c.to_pylist() for c in held.values.flatten()], strict=True)]
                    xml, nodes = render(rows)
                    said = {r.nth: r.text for r in rows} if texts else {}
                    found += [(*x, said.get(x[1])) for x in nodes] if texts else nodes
                    xmls.append(xml)
                    ends.append(len(found))
                columns = [pa.array(c, pa.int32() if name == "nth" else pa.string()) for name, c in zip(fields, zip(*found, strict=True) if found else [()] * len(fields), strict=True)]
                nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(xmls, pa.string()), nodes], ["doc_id", "xml", "nodes"])

    needed = ["nth", "kind", "text", "element_id", *[c for c in blocks.columns if c == "marks"]]
    gathered = blocks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(*needed))).alias("rows"))
    return gathered.mapInArrow(run, schema)


def page_records(pages: DataFrame, source: str = "src-001") -> DataFrame:
    """Page records of (doc_id, page, width_pt, height_pt, rotation, width_px, height_px, status); width and height change places on turned pages."""
    turned = F.col("rotation").isin(90, 270)
    return pages.select(
        "doc_id", F.lit(source).alias("source_id"), F.col("page").alias("physical_page"), S.logical_page(F.col("page")).alias("logical_page_id"), F.lit(None).cast("string").alias("printed_label"),
        F.when(turned, F.col("height_pt")).otherwise(F.col("width_pt")).alias("width_pt"), F.when(turned, F.col("width_pt")).otherwise(F.col("height_pt")).alias("height_pt"), F.col("rotation").alias("rotation_degrees"),
        S.page_image(F.lit(source), F.col("page")).alias("image"), F.col("width_px").alias("image_width_px"), F.col("height_px").alias("image_height_px"), F.lit(S.DPI).alias("render_dpi"), F.col("status").alias("ocr_status"),
    )


def element_records(documents_: DataFrame, boxes: DataFrame, recognised: DataFrame, engines: dict[str, tuple[str, str]], source: str = "src-001") -> DataFrame:
    """(doc_id, element_id, xml_path, reading_order, sources, decision, revisions). boxes and recognised carry `nth`, their block."""
    nodes = documents_.select("doc_id", F.posexplode("nodes").alias("at", "x")).select("doc_id", (F.col("at") + 1).alias("reading_order"), "x.element_id", "x.nth", "x.part").filter("nth IS NOT NULL")

    def side(df: DataFrame, method: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
        name, version = engines[method]
        candidate = F.struct(F.lit(method).alias("method"), F.lit(name).alias("engine"), F.lit(version).alias("engine_version"), F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.round(F.avg("confidence"), 6).alias("confidence"))
        return df.groupBy("doc_id", "nth", "page").agg(candidate.alias(method), *([F.array_sort(F.collect_list(F.struct("seq", F.array("x0", "y0", "x1", "y1").alias("bbox")))).alias("regions")] if method == "native-pdf" else []))

    both = side(boxes, "native-pdf").join(side(recognised, "ocr"), ["doc_id", "nth", "page"], "left")
    place = F.struct(
        F.lit(source).alias("source_id"), F.col("page").alias("physical_page"), S.logical_page(F.col("page")).alias("logical_page_id"), S.page_image(F.lit(source), F.col("page")).alias("page_image"),
        F.transform("regions", lambda r: F.struct(r["bbox"].alias("bbox"))).alias("regions"), F.array_compact(F.array(F.col("`native-pdf`"), F.col("ocr"))).alias("candidates"),
    )
    sources = both.groupBy("doc_id", "nth").agg(F.array_sort(F.collect_list(place), lambda a, b: a["physical_page"] - b["physical_page"]).alias("sources"))
    decision = F.struct(F.lit("reconciled").alias("method"), F.lit(0.8).alias("confidence"))
    none = F.when(F.col("part") == "fig", F.transform("sources", lambda s: s.withField("candidates", F.slice(s["candidates"], 1, 0)))).otherwise(F.col("sources"))
    return nodes.join(sources, ["doc_id", "nth"]).select("doc_id", "element_id", F.concat(F.lit("//*[@id='"), "element_id", F.lit("']")).alias("xml_path"), "reading_order", none.alias("sources"), decision.alias("decision"), F.array().cast(f"array<{REVISION}>").alias("revisions"))


def manifest(sources: DataFrame, name_prefix: str, format_name: str, schema_url: str, created_at: str, generator: tuple[str, str]) -> DataFrame:
    """(doc_id, json) from (doc_id, original_name, sha256, size, page_count, language)."""
    uid = F.concat(F.lit("urn:uuid:"), S.uuid5(S.PACKAGE_NAMESPACE, F.concat(F.lit(name_prefix), "sha256")))
    source = F.struct(
        F.lit("src-001").alias("id"), F.lit("primary").alias("role"), "original_name", F.lit("application/pdf").alias("media_type"), "sha256", "size", "page_count", F.lit("born-digital").alias("source_class"),
        F.array(F.lit("native-pdf"), F.lit("ocr")).alias("extraction_modes"), F.lit(None).cast("string").alias("embedded_path"),
    )
    body = F.struct(
        F.lit(schema_url).alias("$schema"), F.lit(format_name).alias("format"), F.lit("0.1").alias("format_version"), uid.alias("package_id"), F.lit(created_at).alias("created_at"),
        F.struct(F.lit(generator[0]).alias("name"), F.lit(generator[1]).alias("version")).alias("generator"),
        F.struct(F.lit("doc-000001").alias("id"), F.lit("article").alias("type"), F.lit("jats-1.3").alias("profile"), F.col("language").alias("language"), F.lit("content/document.xml").alias("content")).alias("document"),
        F.array(source).alias("sources"), F.struct(*[F.lit(f"provenance/{x}.jsonl").alias(x) for x in ("pages", "elements", "omissions")]).alias("provenance"), F.lit("validation/report.json").alias("validation"), F.lit("checksums.sha256").alias("checksums"),
    )
    return sources.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def json_lines(df: DataFrame, order: Column | str, *, nulls: bool = True) -> DataFrame:
    """K2: (doc_id, text): each document's records as JSON lines, in order."""
    fields = [c for c in df.columns if c != "doc_id"]
    row = F.to_json(F.struct(*fields), {"ignoreNullFields": str(not nulls).lower()})
    ordered = F.array_sort(F.collect_list(F.struct((F.col(order) if isinstance(order, str) else order).alias("o"), row.alias("j"))))
    return df.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["j"]), "\n"), F.lit("\n")).alias("text"))


def checksums(files: DataFrame) -> DataFrame:
    """K5: (package, text) from (package, path, content): all files but checksum lists, by the bytes of their paths."""
    rows = files.filter(~F.col("path").rlike(r"(^|/)checksums\.sha256$")).select("package", "path", F.concat(F.sha2("content", 256), F.lit("  "), "path", F.lit("\n")).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct(F.encode("path", "UTF-8").alias("o"), "line")))
    return rows.groupBy("package").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("text"))


def placeholder_report(checks: tuple[str, ...], at: str) -> str:
    """K6."""
    body = {"valid": False, "validated_at": at, "checks": dict.fromkeys(checks, "not-run"), "errors": [{"code": "validation_not_run", "message": "not validated yet"}], "warnings": []}
    return json.dumps(body, ensure_ascii=False, indent=2) + "\n"


def safe_output(output: Path, source: Path) -> None:
    """K9: no symbolic link on the way, and neither holds the other."""
    for p in [output, *output.parents]:
        if p.is_symlink():
            raise ValueError(f"{p} is a symbolic link")
    a, b = output.resolve(), source.resolve()
    if a == b or a in b.parents or b in a.parents:
        raise ValueError("output and input overlap")


def publish(output: Path, fill: Callable[[Path], None], *, replace: bool = False) -> None:
    """K8: fill a folder beside the output and rename it into place; an existing output stays unless it is to be replaced, and comes back on failure."""
    if output.exists() and not replace:
        raise FileExistsError(output)
    output.parent.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(prefix=f".{output.name}-", dir=output.parent))
    old = stage.with_name(stage.name + ".old")
    try:
        fill(stage)
        if output.exists():
            os.rename(output, old)
        try:
            os.rename(stage, output)
        except OSError:
            if old.exists():
                os.rename(old, output)
            raise
    finally:
        shutil.rmtree(stage, ignore_errors=True)
        shutil.rmtree(old, ignore_errors=True)


def seal(root: Path) -> None:
    """K5, K7 on one folder: write its checksum list by a temporary file and a rename."""
    paths = sorted((p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file() and p.name != "checksums.sha256"), key=str.encode)
    text = "".join(f"{hashlib.sha256((root / p).read_bytes()).hexdigest()}  {p}\n" for p in paths)
    tmp = root / ".checksums.tmp"
    tmp.write_text(text, newline="\n")
    os.replace(tmp, root / "checksums.sha256")
