"""Queries do their whole job: every row, the whole text."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

import __spark_entry__ as entry
from foliomill.operators import integrity as I
from foliomill.operators import prose


def tokens(text):
    return re.findall(r"\w+", text.casefold())


def overlap(a, b):
    x, y = tokens(a), tokens(b)
    return round(sum((Counter(x) & Counter(y)).values()) / max(len(x), 1), 6)


def test_token_overlap_of_all_pairs(spark, sf):
    items = [r for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r["text"] is not None]
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"] is not None]
    found = {(r["item_id"], r["doc_id"]): r["overlap"] for r in entry.queries()["token_overlap"](spark, sf).collect()}
    every = {(b["item_id"], d["doc_id"]): overlap(b["text"], d["text"]) for b in items for d in docs}
    assert len(found) == len(items) * len(docs) and found == pytest.approx(every, abs=1e-6)


def test_overlaps_of_all_pairs_of_bundles_and_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(1, "a a b"), (2, ""), (3, None), (4, "x\ny")], "item_id long, text string")
    docs = spark.createDataFrame([(900, "z " * 500 + "a b a"), (901, "a"), (902, None), (903, " \t ")], "doc_id long, text string").coalesce(1)
    every = {(1, 900): 1.0, (1, 901): 0.333333, (1, 903): 0.0, (2, 900): 0.0, (2, 901): 0.0, (2, 903): 0.0, (4, 900): 0.0, (4, 901): 0.0, (4, 903): 0.0}
    for a_block in (512, 1):
        monkeypatch.setattr(I, "ITEMS_A_BLOCK", a_block)
        rows = I.overlaps(items, docs).collect()
        assert len(rows) == len(every) and {(r["item_id"], r["doc_id"]): r["overlap"] for r in rows} == every


def test_overlap_of_late_passages_ties_and_odd_texts(spark):
    items = spark.createDataFrame([(1, "a a b"), (2, ""), (3, None), (4, "x\ny"), (5, "a a b")], "item_id long, text string")
    docs = spark.createDataFrame([(900, "z " * 5000 + "a b a"), (901, "a"), (902, None), (903, " \t "), (904, "A, B; a!"), (905, "a a a b"), (906, "a b b")], "doc_id long, text string")

    def found(tenths):
        return {(r["item_id"], r["doc_id"]): r["overlap"] for r in I.overlaps(items, docs, tenths).collect()}

    whole = {(i, d): 1.0 for i in (1, 5) for d in (900, 904, 905)}
    assert found(9) == whole == found(10)
    assert found(6) == whole | {(1, 906): 0.666667, (5, 906): 0.666667}
    assert found(3) == found(6) | {(1, 901): 0.333333, (5, 901): 0.333333}
    assert I.overlaps(items.limit(0), docs).count() == 0 == I.overlaps(items, docs.limit(0)).count()


def test_overlaps_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(1, 25)))) for i in range(40)]
    docs = [(i, " ".join(r.choices(words, range(1, 13), k=r.randrange(1, 90)))) for i in range(60)]
    for tenths in (9, 7):
        found = {(x["item_id"], x["doc_id"]) for x in I.overlaps(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), tenths).collect()}
        assert found == {(i, d) for i, a in items for d, b in docs if 10 * sum((Counter(tokens(a)) & Counter(tokens(b))).values()) >= tenths * len(tokens(a))}


def test_candidates_of_all_pairs(spark, sf):
    items = [r for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r["text"] is not None]
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"] is not None]
    found = {(r["item_id"], r["doc_id"]): r["ratio"] for r in entry.queries()["candidate_consistency"](spark, sf).collect()}
    held = {(b["item_id"], d["doc_id"]) for b in items for d in docs if prose.flat(b["text"]) in prose.flat(d["text"])}
    assert held and held <= set(found)
    for b in items:
        for d in docs:
            if len(d["text"]) < 800:  # the matcher takes long for longer ones
                ratio, accepted = prose.comparable(b["text"], d["text"])
                assert found.get((b["item_id"], d["doc_id"])) == (ratio if accepted else None)


def test_close_candidates_are_kept(spark):
    a = "the quick brown fox jumps over the lazy dog and runs home"
    texts = [a.replace("quick", "quiet"), a.replace(" ", ""), a[:40], "z " * 900 + a, "nothing of this", " ", "Fox"]
    items = spark.createDataFrame([(41, a)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    found = {r["doc_id"]: r["ratio"] for r in prose.supported(items, docs).collect()}
    both = {i: prose.comparable(a, t) for i, t in enumerate(texts)}
    assert found == {i: ratio for i, (ratio, accepted) in both.items() if accepted}
    assert {0, 3} <= set(found) and 4 not in found


def test_overlaps_hold_bounded_portions(monkeypatch):
    monkeypatch.setattr(I, "BUNDLE_BYTES", 1000)
    monkeypatch.setattr(I, "PAIRS_A_BATCH", 64)
    texts = ["w " * (1 + i % 90) for i in range(2000)] + ["z " * 5000, "w"]
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    bundles = list(I._bundles(iter([docs])))
    assert [t for b in bundles for t in b.column(1)[0].as_py()] == texts and [i for b in bundles for i in b.column(0)[0].as_py()] == list(range(len(texts)))
    assert all(len(b.column(1)[0]) == 1 or len(b.column(1)[0]) <= I.BUNDLE_ROWS and sum(map(len, b.column(1)[0].as_py())) <= 1000 for b in bundles)
    items = [pa.array([list(range(10))], pa.list_(pa.int64())), pa.array([["w w"] * 10], pa.list_(pa.string()))]
    pairs = list(I._shared(pa.RecordBatch.from_arrays([*b.columns, *items], ["ids", "texts", "item_ids", "item_texts"]) for b in bundles))
    assert sum(p.num_rows for p in pairs) == 10 * len(texts) and max(p.num_rows for p in pairs) < 64 + 10
    assert sum(sum(p.column(2).to_pylist()) for p in pairs) == sum(10 * min(2, t.count("w")) for t in texts)


@pytest.mark.parametrize(("threshold", "join"), [("10m", "BuildRight"), ("-1", "CartesianProduct"), ("-1", "BuildLeft")])
def test_overlaps_send_texts_through_python_once(spark, monkeypatch, threshold, join):
    r = random.Random(7)
    words = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(0, 9)))) for i in range(7)]
    docs = [(i, None if i % 8 == 3 else " ".join(r.choices(words, k=r.randrange(0, 30)))) for i in range(50)]
    monkeypatch.setattr(I, "ITEMS_A_BLOCK", 2)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        texts = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        made = I.overlaps(spark.createDataFrame(items, "item_id long, text string"), texts.hint("broadcast") if join == "BuildLeft" else texts)
        rows = made.collect()
        assert join in made._jdf.queryExecution().executedPlan().toString()
        assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # two held a task's texts twice
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    every = {(i, d): overlap(a, b) for i, a in items for d, b in docs if b is not None}
    assert len(rows) == len(every) and {(x["item_id"], x["doc_id"]): x["overlap"] for x in rows} == pytest.approx(every, abs=1e-6)


def test_items_are_sent_once_in_a_task():
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())))], ["doc_id", "text", "block", "item_ids", "item_texts"])

    first = batch([(1, "a b", 0, [10, 11], ["a", "b c"]), (1, "a b", 1, [12], ["b b"]), (2, "c", 0, None, None), (2, "c", 1, None, None)])
    pairs = list(I._pairs(iter([first, batch([(3, "b b", 1, None, None)]), batch([(3, "b b", 0, None, None)])])))
    assert sorted(tuple(x.values()) for p in pairs for x in p.to_pylist()) == [(10, 1, 1, 1), (10, 2, 0, 1), (10, 3, 0, 1), (11, 1, 1, 2), (11, 2, 1, 2), (11, 3, 1, 2), (12, 1, 1, 2), (12, 2, 0, 2), (12, 3, 2, 2)]
    with pytest.raises(KeyError):  # never a pair without its items
        list(I._pairs(iter([batch([(3, "b b", 1, None, None)])])))
