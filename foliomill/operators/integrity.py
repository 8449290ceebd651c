"""Generic integrity operators: keys, sequences, references, chains, sets. Each yields findings, one row for each violation.

A finding has the columns code, key (the violating key as text) and detail.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.operators.prose import flat
from foliomill.sources.written import written

#: Items, bytes and rows that meet at a time, and pairs that go back to Spark at a time.
ITEMS_A_BLOCK, BUNDLE_BYTES, BUNDLE_ROWS, PAIRS_A_BATCH = 512, 1 << 18, 512, 1 << 16


def key_text(*columns: Column | str) -> Column:
    return F.concat_ws("/", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


def finding(df: DataFrame, code: str, key: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(code).alias("code"), key.alias("key"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A10: keys that occur more than once, with the number of surplus rows. Partial counts, then one row for each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys, (F.col("n") - 1).alias("surplus"))


def sequence_gaps(df: DataFrame, group: Sequence[str], number: str, first: int = 1) -> DataFrame:
    """Groups whose numbers are not exactly first, first+1, ..., n. No list is gathered: four aggregates tell."""
    d = df.groupBy(*group).agg(F.count("*").alias("n"), F.countDistinct(number).alias("n_distinct"), F.min(number).alias("low"), F.max(number).alias("high"))
    broken = (F.col("n") != F.col("n_distinct")) | (F.col("low") != first) | (F.col("high") != first + F.col("n") - 1)
    return d.filter(broken).select(*group, "n", "n_distinct", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


def missing_references(df: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """Rows whose reference has no target; null references are no violation."""
    return df.filter(F.col(column).isNotNull()).join(target.select(F.col(target_column).alias(column)).distinct(), column, "left_anti")


def full_difference(left: DataFrame, right: DataFrame, key: str, compare: str | None = None) -> DataFrame:
    """Keys that only one side has, and, with `compare`, keys whose values differ."""
    a = left.select(F.col(key).alias("key"), F.lit(True).alias("in_left"), (F.col(compare) if compare else F.lit(None)).alias("a"))
    b = right.select(F.col(key).alias("key"), F.lit(True).alias("in_right"), (F.col(compare) if compare else F.lit(None)).alias("b"))
    both = a.join(b, "key", "full_outer")
    state = F.when(F.col("in_right").isNull(), "only_left").when(F.col("in_left").isNull(), "only_right").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return both.withColumn("state", state).filter("state IS NOT NULL").select("key", "state")


def chain_breaks(df: DataFrame, group: Sequence[str], order: str, before: str, after: str) -> DataFrame:
    """Links of a chain whose `before` is not the previous link's `after`."""
    w = Window.partitionBy(*group).orderBy(order)
    linked = df.withColumns({"nth": F.row_number().over(w), "previous": F.lag(after).over(w)})
    return linked.filter((F.col("nth") > 1) & ~F.col(before).eqNullSafe(F.col("previous"))).drop("nth")


def order_violations(df: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value is under the one before it in the group."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).filter(F.col(value) < F.col("previous"))


def set_difference(expected: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Values that are expected but not found, and the other way round."""
    e, f = expected.select(column).distinct(), found.select(column).distinct()
    return e.subtract(f).withColumn("state", F.lit("missing")).unionByName(f.subtract(e).withColumn("state", F.lit("unexpected")))


def status_rollup(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """The status of every check (failed if it has an error) and its number of findings; checks is (check, ran)."""
    n = findings.groupBy("check").agg(F.count("*").alias("n"), F.bool_or(F.col("severity") == "error").alias("bad"))
    status = F.when(~F.col("ran"), "not-run").when(F.coalesce("bad", F.lit(False)), "failed").otherwise("passed")
    return checks.join(n, "check", "left").select("check", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_findings"))


def is_valid(statuses: DataFrame) -> DataFrame:
    """V2: valid if all checks passed."""
    return statuses.agg(F.bool_and(F.col("status") == "passed").alias("valid"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "not-run").alias("n_not_run"))


def tokens(text: str) -> list[str]:
    return re.findall(r"\w+", flat(text))


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) as rows of lists, each of at most BUNDLE_ROWS texts and, but for a single one, about BUNDLE_BYTES."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        start = taken = 0
        for end, n in enumerate(size):
            if end > start and (taken + n > BUNDLE_BYTES or end - start == BUNDLE_ROWS):
                yield _one_row(batch.slice(start, end - start))
                start, taken = end, 0
            taken += n
        if start < batch.num_rows:
            yield _one_row(batch.slice(start))


def _one_row(rows: pa.RecordBatch) -> pa.RecordBatch:
    ends = pa.array([0, rows.num_rows], pa.int32())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.concat_arrays([c])) for c in rows.columns], ["ids", "texts"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, block, item_ids, item_texts) as rows of lists for `_shared`. A block's items stand in its first row of a task only and are held."""
    names, blocks = ["ids", "texts", "item_ids", "item_texts"], {}
    for batch in batches:
        numbers = batch.column(2)
        for at in np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False)):
            blocks[numbers[at].as_py()] = [pa.array([c[at].as_py()], c.type) for c in batch.columns[3:]]
        for block in pc.unique(numbers).to_pylist():
            own = pc.equal(numbers, block)
            rows = batch.select([0, 1])
            for bundle in _bundles(iter([rows if pc.all(own).as_py() else rows.filter(own)])):
                yield pa.RecordBatch.from_arrays([*bundle.columns, *blocks[block]], names)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _shared(_met(batches))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, doc_id, shared, size) of all pairs of rows (ids, texts, item_ids, item_texts) of lists."""
    block, held = None, {}
    for batch in batches:
        for at in range(batch.num_rows):
            ids, texts, item_ids, item_texts = (c[at].values for c in batch.columns)
            if block is None or not (item_ids.equals(block[0]) and item_texts.equals(block[1])):
                block, held = (item_ids, item_texts), {}
                sizes = np.zeros(len(item_ids), np.int32)
                for i, text in enumerate(item_texts):
                    said = tokens(text.as_py())
                    sizes[i] = len(said)
                    # the k-th copy of a token is a symbol of its own, so that a lesser count is a number of shared symbols
                    for token, n in Counter(said).items():
                        holders = held.setdefault(token, [])
                        holders.extend([] for _ in range(n - len(holders)))
                        for k in range(n):
                            holders[k].append(i)
                held = {t: [np.array(x, np.int32) for x in holders] for t, holders in held.items()}
            made, seen = [], 0
            for i, text in enumerate(texts):
                have = Counter(t for t in tokens(text.as_py()) if t in held)
                found = [x for t, n in have.items() for x in held[t][:n]]
                made.append(np.bincount(np.concatenate(found), minlength=len(sizes)) if found else np.zeros(len(sizes), np.int64))
                seen += len(sizes)
                if seen >= PAIRS_A_BATCH or i + 1 == len(texts):
                    docs = np.repeat(ids.to_numpy()[i + 1 - len(made) : i + 1], len(sizes))
                    columns = [np.tile(item_ids.to_numpy(), len(made)), docs, np.concatenate(made).astype(np.int32), np.tile(sizes, len(made))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item_id", "doc_id", "shared", "size"])
                    made, seen = [], 0


def overlaps(items: DataFrame, docs: DataFrame, tenths: int | None = None) -> DataFrame:
    """A8 of every item (item_id, text) with the whole text of every document (doc_id, text): item_id, doc_id, overlap; with `tenths` (1 to 10) only
    of items with tokens, and the pairs where the document holds at least so many tenths of the item's tokens.

    Tokens are runs of word characters of the case-folded text; null texts are left out, and an item without tokens has no overlap. Documents
    meet blocks of items: these are written first, so that the planner knows their size and broadcasts them only below its threshold. Python gets a
    document's text once for each block, and a block's items with the first document of a partition.
    """
    asked = items.filter("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = F.pmod(F.xxhash64("item_id"), F.lit(max(-(-n // ITEMS_A_BLOCK), -(-size // BUNDLE_BYTES), 1)))
    each = F.sort_array(F.collect_list(F.struct("item_id", "text")))
    blocks = written(asked.groupBy(share.alias("block")).agg(each.alias("i")).select("block", F.col("i.item_id").alias("item_ids"), F.col("i.text").alias("item_texts")))
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in its partition, from 0
    met = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text", nth.alias("nth")).crossJoin(blocks)
    first = [F.when(F.col("nth") == 0, F.col(c)).alias(c) for c in ("item_ids", "item_texts")]
    made = met.select("doc_id", "text", "block", *first).mapInArrow(_pairs, "item_id long, doc_id long, shared int, size int")
    if tenths is not None:
        made = made.filter((F.col("size") > 0) & (10 * F.col("shared") >= tenths * F.col("size")))
    return made.select("item_id", "doc_id", F.round(F.col("shared") / F.greatest("size", F.lit(1)), 6).alias("overlap"))


def text_hygiene(df: DataFrame, text: str = "text") -> DataFrame:
    """Columns has_bom, has_cr, has_odd_line_ends (U+0085, U+2028, U+2029)."""
    t = F.col(text)
    return df.withColumns({"has_bom": t.startswith("\ufeff"), "has_cr": F.contains(t, F.lit("\r")), "has_odd_line_ends": t.rlike(r"[\x{85}\x{2028}\x{2029}]")})


def grid_occupancy(cells: DataFrame) -> DataFrame:
    """W18 for tables without row spans: (table, row, width) where a row's width is not the widest row's. cells: table, row, colspan."""
    rows = cells.groupBy("table", "row").agg(F.sum("colspan").alias("width"))
    widest = F.max("width").over(Window.partitionBy("table"))
    return rows.withColumn("widest", widest).filter("width <> widest")
