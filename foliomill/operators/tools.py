"""Contracts of the pluggable tools (page inspection, rendering, text extraction) and source descriptors.

The tools themselves (PDF, OCR, formula checkers, XSD engines) are plug-ins: functions that return DataFrames of a fixed schema.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The fields of a source descriptor, and the largest source.
DESCRIPTOR = ("format", "format_version", "case_id", "url", "sha256", "size", "original_name")
MOST_BYTES = 100 << 20


@dataclass(frozen=True)
class Tools:
    """The plug-ins. Each gets the sources (doc_id, content) and returns a DataFrame; absent ones are None."""

    inspect: Callable[[DataFrame], DataFrame] | None = None
    render: Callable[[DataFrame], DataFrame] | None = None
    extract: Callable[[DataFrame], DataFrame] | None = None
    recognise: Callable[[DataFrame], DataFrame] | None = None
    parse: Callable[[DataFrame], DataFrame] | None = None


def check_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page, code) for each fault of (doc_id, page, width, height, rotation, dpi, status, n_boxes)."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    faults = {
        "page_size": ~((F.col("width") > 0) & (F.col("height") > 0)),
        "page_rotation": ~F.col("rotation").isin(0, 90, 180, 270),
        "render_dpi": F.col("dpi") != 300,
        "status_boxes": (F.col("status") != "completed") & (F.col("n_boxes") > 0),
        "page_numbers": F.col("page") != nth,
    }
    said = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in faults.items()]))
    return pages.withColumn("codes", said).select("doc_id", "page", F.explode("codes").alias("code"))


def check_boxes(boxes: DataFrame, n_pages: DataFrame) -> DataFrame:
    """(doc_id, seq, code) for boxes off their document's pages, with a bad box or a confidence outside 0 to 1. n_pages: doc_id, n."""
    from foliomill.functions.scalars import bbox_is_valid

    rows = boxes.join(n_pages, "doc_id", "left")
    faults = {
        "box_page": ~F.col("page").between(1, F.coalesce("n", F.lit(0))),
        "box_bounds": ~bbox_is_valid(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]),
        "box_confidence": ~F.col("confidence").between(0, 1),
    }
    said = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in faults.items()]))
    return rows.withColumn("codes", said).select("doc_id", "seq", F.explode("codes").alias("code"))


def is_pdf(content):
    """The magic bytes, as a column."""
    return F.substring(content, 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8")


def descriptor_faults(data: bytes) -> list[str]:
    """What is wrong with a source descriptor; nothing for a good one."""
    out = ["has a byte order mark"] * data.startswith(b"\xef\xbb\xbf") + ["has carriage returns"] * (b"\r" in data)
    try:
        d = json.loads(data.decode("utf-8-sig"))
    except ValueError:
        return [*out, "is not JSON"]
    if not isinstance(d, dict) or set(d) != set(DESCRIPTOR):
        return [*out, "does not have exactly the seven fields"]
    url = urlsplit(d["url"]) if isinstance(d["url"], str) else urlsplit("")
    rules = {
        "format_version": isinstance(d["format_version"], str),
        "case_id": isinstance(d["case_id"], str) and re.fullmatch(r"[a-z0-9]+(?:[-.][a-z0-9]+)*", d["case_id"]),
        "url": url.scheme in ("http", "https") and url.hostname and "@" not in url.netloc,
        "sha256": isinstance(d["sha256"], str) and re.fullmatch("[0-9a-f]{64}", d["sha256"]),
        "size": isinstance(d["size"], int) and not isinstance(d["size"], bool) and 1 <= d["size"] <= MOST_BYTES,
        "original_name": isinstance(d["original_name"], str) and re.fullmatch(r"[^/\\]+\.pdf", d["original_name"]) and not d["original_name"].startswith("."),
    }
    return out + [f"{k} is not valid" for k, ok in rules.items() if not ok]
