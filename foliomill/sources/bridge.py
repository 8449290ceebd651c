"""Positioned text boxes from plain documents, by a rule that Spark and the oracle both follow.

The layout is ours and synthetic: a page has 40 rows, one for each line of the text; long lines are full-width, others alternate between
two columns. Every line is kept whole: some get a caption's, table's, reference's, affiliation's or heading's start or a hyphen at
their end, and beside some stand boxes of our own (page numbers, formulas with numbers, fragments, an abstract label, stamps, markers).
All coordinates are thousandths, divided once. seq is 8 times the line's number plus the kind of box (0 for the line itself).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 40

#: Texts by kind and line number; the same words in Spark and in the oracle.
TEXTS = [
    """CASE WHEN pos % 29 = 7 THEN concat('Table ', CAST(pos AS STRING), ' ', line)
 WHEN pos % 13 = 4 THEN concat('Fig. ', CAST(pos AS STRING), ' ', line)
 WHEN pos % 19 = 6 THEN concat('[', CAST(pos AS STRING), '] ', line)
 WHEN pos % 37 = 12 THEN concat(CAST(1 + pos % 9 AS STRING), ' Institute ', line)
 WHEN pos % 34 = 17 THEN concat('A', CAST(pos AS STRING), '. ', line)
 WHEN pos % 11 = 3 THEN concat(line, '-')
 ELSE line END""",
    "CASE WHEN pos % 40 = 37 THEN CAST(page AS STRING) END",
    "CASE WHEN pos % 23 = 9 THEN concat('E = 2 m + ', CAST(pos AS STRING), ' < z') END",
    "CASE WHEN pos % 46 = 9 THEN concat('(', CAST(pos AS STRING), ')') END",
    "CASE WHEN pos % 31 = 11 THEN '− | x' END",
    "CASE WHEN pos % 53 = 20 THEN 'Abstract' END",
    "CASE WHEN pos % 97 = 5 THEN concat('preprint:2103.', CAST(10000 + pos AS STRING), 'v1 [q] 3 mar 2021') END",
    "CASE WHEN pos % 17 = 0 AND pos > 0 THEN concat(CAST(1 + pos % 9 AS STRING), ',†') END",
]
GEOMETRY = {
    "x0": "CASE kind WHEN 0 THEN (CASE WHEN length(text) >= 400 OR pos % 2 = 0 THEN 100 ELSE 550 END) WHEN 1 THEN 480 WHEN 2 THEN 460 WHEN 3 THEN 905 WHEN 4 THEN 905 WHEN 5 THEN 460 WHEN 6 THEN 40 ELSE 455 END",
    "y0": "CASE WHEN kind = 6 THEN 180 ELSE 50 + 20 * (pos % 40) END",
    "x1": "CASE kind WHEN 0 THEN (CASE WHEN length(text) >= 400 THEN 900 WHEN length(text) <= 12 THEN (CASE WHEN pos % 2 = 0 THEN 190 ELSE 640 END) WHEN pos % 2 = 0 THEN 450 ELSE 900 END) WHEN 1 THEN 500 WHEN 2 THEN 600 WHEN 3 THEN 930 WHEN 4 THEN 930 WHEN 5 THEN 540 WHEN 6 THEN 80 ELSE 465 END",
    "y1": "CASE WHEN kind = 6 THEN 860 WHEN pos % 9 = 5 THEN 53 + 20 * (pos % 40) ELSE 65 + 20 * (pos % 40) END",
    "font": "CASE WHEN kind = 7 THEN 8 WHEN kind <> 0 THEN 10 WHEN pos = 0 THEN 20 WHEN pos % 17 = 0 THEN 14 WHEN pos % 7 = 3 THEN 7 ELSE 10 END",
    "conf": "900 + pos % 100",
}
COLUMNS = ["doc_id", "page", "seq", "text", "x0", "y0", "x1", "y1", "font_size", "confidence"]


def boxes_of(documents: DataFrame) -> DataFrame:
    """(doc_id, page, seq, text, x0, y0, x1, y1, font_size, confidence): one row for each line that is not blank, and our own boxes beside them."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter("trim(line) <> ''")
    lines = lines.withColumn("page", F.expr(f"CAST(pos DIV {ROWS} + 1 AS INT)"))
    rows = lines.select("doc_id", "page", "pos", F.posexplode(F.array(*[F.expr(t) for t in TEXTS])).alias("kind", "text")).filter("text IS NOT NULL")
    rows = rows.withColumns({k: F.expr(f"CAST({v} AS INT)") for k, v in GEOMETRY.items()}).withColumn("seq", F.expr("8 * pos + kind"))
    scaled = [(F.col(c) / F.lit(1000.0)).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return rows.select("doc_id", "page", "seq", "text", *scaled, F.col("font").cast("double").alias("font_size"), (F.col("conf") / F.lit(1000.0)).alias("confidence"))


def sheets_of(documents: DataFrame) -> DataFrame:
    """(doc_id, sheets): the same boxes in each document's row, as an array of (page, boxes) in order: nothing is gathered again."""
    page = f"CAST(pos DIV {ROWS} + 1 AS INT)"
    values = {"seq": "8 * pos + kind", "text": "text", **{c: f"CAST({GEOMETRY[c]} AS INT) / 1000.0D" for c in ("x0", "y0", "x1", "y1")}, "font_size": f"CAST(CAST({GEOMETRY['font']} AS INT) AS DOUBLE)", "confidence": f"CAST({GEOMETRY['conf']} AS INT) / 1000.0D"}
    each = f"transform(array({', '.join(re.sub('[(]page ', f'({page} ', t) for t in TEXTS)}), (text, kind) -> CASE WHEN text IS NOT NULL THEN named_struct({', '.join(f"'{k}', {v}" for k, v in values.items())}) END)"
    whole = documents.select("doc_id", F.transform(F.split("text", "\n", -1), lambda line, at: F.struct(line.alias("line"), at.alias("pos"))).alias("lines"))
    parts = whole.select("doc_id", F.expr(f"transform(sequence(0, size(lines) - 1, {ROWS}), at -> filter(slice(lines, at + 1, {ROWS}), l -> trim(l.line) <> ''))").alias("parts"))
    inner = re.sub(r"\bpos\b", "l.pos", re.sub(r"\bline\b", "l.line", each))
    return parts.select("doc_id", F.expr(f"filter(transform(parts, (part, at) -> named_struct('page', at + 1, 'boxes', array_compact(flatten(transform(part, l -> {inner}))))), s -> size(s.boxes) > 0)").alias("sheets"))


def page_numbers() -> Column:
    """The pages of a document's `text` that hold boxes: each line that is not blank has one."""
    return F.array_distinct(F.array_compact(F.transform(F.split("text", "\n", -1), lambda line, i: F.when(F.trim(line) != "", (F.floor(i / ROWS) + 1).cast("int")))))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes_of(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _duck(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")


#: The same boxes for the oracle.
BOXES = (
    "lines AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)), "
    f"paged AS (SELECT doc_id, CAST(pos AS INT) AS pos, line, CAST(pos // {ROWS} + 1 AS INT) AS page FROM lines WHERE trim(line) <> ''), "
    f"kinds AS (SELECT doc_id, page, pos, unnest(range({len(TEXTS)})) AS kind, unnest([{', '.join(_duck(t) for t in TEXTS)}]) AS text FROM paged), "
    f"placed AS (SELECT doc_id, page, CAST(8 * pos + kind AS INT) AS seq, text, {', '.join(f'{v} AS {k}_i' for k, v in GEOMETRY.items())} FROM kinds WHERE text IS NOT NULL), "
    "boxes AS (SELECT doc_id, page, seq, text, x0_i / 1000.0::DOUBLE AS x0, y0_i / 1000.0::DOUBLE AS y0, x1_i / 1000.0::DOUBLE AS x1, y1_i / 1000.0::DOUBLE AS y1, font_i::DOUBLE AS font_size, conf_i / 1000.0::DOUBLE AS confidence FROM placed)"
)
