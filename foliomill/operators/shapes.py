"""Record shapes: closed objects with typed fields, checked one record at a time (V1, V2).

A shape maps each field to a rule: a pattern, a set of words, a type, a nested shape in a list, or a function that says what is wrong. A
`?` after the name makes the field optional. Fields named `x-...` are always allowed. The shapes are fixed values of the format.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCE, LOGICAL, SHA = r"src-[0-9]{3}", r"lp-[0-9]{6}", r"[0-9a-f]{64}"
TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z"
PATH = r"(?!.*(^|/)\.\.(/|$))[a-z0-9._-]+(/[a-z0-9._-]+)*"
LANGUAGE = r"und|[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*"
ELEMENT = r"[a-z][a-z0-9]*(-[a-z0-9]+)*"
OMITTED = {"page-header", "page-footer", "page-number", "scanner-artifact", "duplicate", "decorative", "blank", "unreadable", "other"}
CHECKS = ("manifest_schema", "xml_well_formed", "jats_bits_schema", "p2h_profile", "id_uniqueness", "cross_references", "page_coverage", "element_provenance", "asset_integrity", "checksum_integrity")


def whole(least: int = 0) -> Callable:
    return lambda v: None if isinstance(v, int) and not isinstance(v, bool) and v >= least else f"is not a whole number of at least {least}"


def number(low: float = -math.inf, high: float = math.inf) -> Callable:
    return lambda v: None if isinstance(v, int | float) and not isinstance(v, bool) and low <= v <= high else f"is not a number from {low} to {high}"


def text(least: int = 0) -> Callable:
    return lambda v: None if isinstance(v, str) and len(v) >= least else "is not a text" + " with characters" * (least > 0)


def maybe(rule: Any) -> Callable:
    return lambda v: None if v is None else next(problems(v, rule, ""), None)


def bbox(v: Any) -> str | None:
    return None if isinstance(v, list) and len(v) == 4 and all(number(0, 1)(x) is None for x in v) else "is not a box of four numbers from 0 to 1"


def polygon(v: Any) -> str | None:
    return None if isinstance(v, list) and len(v) >= 3 and all(isinstance(p, list) and len(p) == 2 and all(number(0, 1)(x) is None for x in p) for p in v) else "is not a polygon"


PAGE_REF = {"source_id": SOURCE, "physical_page": whole(1), "logical_page_id": LOGICAL, "page_image": PATH}
PAGE = {
    "source_id": SOURCE, "physical_page": whole(1), "logical_page_id": LOGICAL, "printed_label": maybe(text()), "width_pt": number(1e-9), "height_pt": number(1e-9), "rotation_degrees": {0, 90, 180, 270},
    "image": PATH, "image_width_px": whole(1), "image_height_px": whole(1), "render_dpi": {300}, "ocr_status": {"completed", "no-text", "failed"},
}
CANDIDATE = {"method": {"native-pdf", "ocr", "manual"}, "engine": text(1), "engine_version": text(1), "text": text(), "confidence": number(0, 1)}
REVISION = {"timestamp": TIME, "actor": text(1), "method": {"automatic", "manual"}, "before": text(), "after": text(), "reason": text(1), "evidence": [PAGE_REF | {"bbox": bbox}]}
RESOURCE = {"role": {"normalized", "original", "fallback", "supplementary"}, "path": PATH, "media_type": text(1), "sha256": SHA, "source_id?": SOURCE}
ELEMENT_RECORD = {
    "element_id": ELEMENT, "xml_path": text(1), "reading_order": whole(1), "sources": [PAGE_REF | {"regions": [{"bbox": bbox, "polygon?": polygon}], "candidates": [CANDIDATE]}],
    "decision": {"method": {"native-pdf", "ocr", "manual", "reconciled"}, "confidence": number(0, 1)}, "revisions": [REVISION], "resources?": [RESOURCE],
}
OMISSION = {"id": r"omit-[0-9]{6}", **PAGE_REF, "bbox": bbox, "type": OMITTED, "reason": text(1)}
MANIFEST_SOURCE = {
    "id": SOURCE, "role": {"primary", "alternate", "supplementary"}, "original_name": text(1), "media_type": text(1), "sha256": SHA, "size": whole(), "page_count": whole(1),
    "source_class": {"born-digital", "scanned", "hybrid"}, "extraction_modes": lambda v: None if isinstance(v, list) and v and set(v) <= {"native-pdf", "ocr", "manual"} and len(set(v)) == len(v) else "is not a list of modes", "embedded_path": maybe(PATH),
}
MANIFEST = {
    "$schema": text(1), "format": text(1), "format_version": {"0.1"}, "package_id": r"urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "created_at": TIME, "generator": {"name": text(1), "version": text(1)},
    "document": {"id": r"doc-[0-9]{6}", "type": {"article", "book"}, "profile": {"jats-1.3", "bits-2.1"}, "language": LANGUAGE, "content": {"content/document.xml"}}, "sources": [MANIFEST_SOURCE],
    "provenance": {"pages": PATH, "elements": PATH, "omissions": PATH}, "annotations?": {"index": PATH}, "validation": PATH, "checksums": PATH,
}
LAYER = {"id": ELEMENT, "kind": {"translation", "definition", "commentary", "reading-note"}, "language": LANGUAGE, "path": r"annotations/[a-z][a-z0-9]*(-[a-z0-9]+)*\.jsonl"}
ANNOTATION = {"target_id": ELEMENT, "kind": LAYER["kind"], "language": LANGUAGE, "content_text?": text(), "content_xml?": text()}
COVERAGE = {"engine": text(1), "engine_version": text(1), "reviewed_pages": [{"source_id": SOURCE, "physical_page": whole(1)}], "uncovered_objects": [{"source_id": SOURCE, "physical_page": whole(1), "description": text(1)}]}
SHAPES = {"annotation": ANNOTATION, "layers": {"$schema": text(1), "format": text(1), "format_version": {"0.1"}, "layers": [LAYER]}, "coverage": COVERAGE, "page": PAGE, "element": ELEMENT_RECORD, "omission": OMISSION, "manifest": MANIFEST}


def problems(value: Any, rule: Any, at: str) -> Iterator[str]:
    """What is wrong with value, one text for each fault, with its place."""
    if isinstance(rule, str):
        if not isinstance(value, str) or not re.fullmatch(rule, value):
            yield f"{at or 'value'} does not match {rule}"
    elif isinstance(rule, set | frozenset):
        if isinstance(value, bool | list | dict) or value not in rule:
            yield f"{at or 'value'} is none of {sorted(map(str, rule))}"
    elif isinstance(rule, list):
        if not isinstance(value, list):
            yield f"{at or 'value'} is not a list"
        else:
            for i, x in enumerate(value):
                yield from problems(x, rule[0], f"{at}[{i}]")
    elif isinstance(rule, dict):
        if not isinstance(value, dict):
            yield f"{at or 'value'} is not an object"
            return
        names = {k.rstrip("?") for k in rule}
        for k, r in rule.items():
            if k.rstrip("?") in value:
                yield from problems(value[k.rstrip("?")], r, f"{at}.{k.rstrip('?')}".lstrip("."))
            elif not k.endswith("?"):
                yield f"{f'{at}.{k}'.lstrip('.')} is missing"
        for k in value:
            if k not in names and not re.fullmatch(r"x-[a-z0-9]+(?:-[a-z0-9]+)*", k):
                yield f"{f'{at}.{k}'.lstrip('.')} is not allowed"
    else:
        said = rule(value)
        if said:
            yield f"{at or 'value'} {said}"


def manifest_conditions(m: dict) -> Iterator[str]:
    """V2: rules that tie fields of a manifest together."""
    try:
        document, sources = m["document"], m["sources"]
        if (document["type"], document["profile"]) not in {("article", "jats-1.3"), ("book", "bits-2.1")}:
            yield "document.profile does not fit document.type"
        if sum(s["role"] == "primary" for s in sources) != 1:
            yield "sources do not have exactly one primary source"
        for i, s in enumerate(sources):
            modes = set(s["extraction_modes"])
            if s["media_type"] == "application/pdf" and "ocr" not in modes:
                yield f"sources[{i}].extraction_modes lacks ocr"
            if s["source_class"] == "born-digital" and not {"native-pdf", "ocr"} <= modes:
                yield f"sources[{i}].extraction_modes lacks native-pdf or ocr"
    except (KeyError, TypeError):
        return


def check_records(records: DataFrame, shape: str) -> DataFrame:
    """(package, path, line, code, message) for each fault of records (package, path, line, json)."""
    rule = SHAPES[shape]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for package, path, line, raw in zip(b["package"], b["path"], b["line"], b["json"], strict=True):
                try:
                    value = json.loads(raw)
                except ValueError as e:
                    rows.append((package, path, line, "json_syntax" if shape == "manifest" else "jsonl_syntax", str(e)))
                    continue
                if not isinstance(value, dict):
                    rows.append((package, path, line, "manifest_not_object" if shape == "manifest" else "jsonl_record_not_object", "not an object"))
                    continue
                said = list(problems(value, rule, ""))
                if shape == "manifest" and not said:
                    said += manifest_conditions(value)
                rows += [(package, path, line, "schema_violation", x) for x in said]
            yield pd.DataFrame(rows, columns=["package", "path", "line", "code", "message"])

    return records.select("package", "path", F.col("line").cast("int").alias("line"), "json").mapInPandas(run, "package string, path string, line int, code string, message string")
