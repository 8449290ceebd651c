"""The pipeline: each stage against brute force on what its predecessor kept."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from foliomill.llm.common import settle

from .test_operators import clusters, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        made = settle(stage(spark, docs, sf))
        kept[name] = made
        if name != "packing":
            assert made.columns == COLUMNS
            docs = made
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {r["doc_id"]: r["text"] for r in kept["language ID"].collect()}
    assert known == {i: t for i, t in start.items() if any(c.isalpha() for c in t)}
    lined = {r["doc_id"]: r for r in kept["line dedup"].collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in lined.values())
    whole = {i: known[i] for i in lined}
    assert sum(lined[i]["text"] != whole[i] for i in lined) > 0 or len(lined) < len(known)
    apart = {r["doc_id"]: r["text"] for r in kept["MinHash near-dedup"].collect()}
    groups = clusters({i: r["text"] for i, r in lined.items()})
    assert set(apart) == {i for i in groups if groups[i] == i}
    mixed = Counter(r["doc_id"] for r in kept["mixing"].collect())
    assert set(mixed) <= set(apart) and max(mixed.values()) <= 2
    taken, size = sum(len(words(apart[i])) * n for i, n in mixed.items()), sum(len(words(t)) for t in apart.values())
    assert abs(taken / size - 1.5) < 0.1
    pieces = kept["packing"]
    tokens = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"]: r["n"] for r in tokens} == {r["doc_id"]: r["t"] * mixed[r["doc_id"]] for r in tokens} and len(tokens) == len(mixed)


def test_run_equals_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "sequence_id", "ids"}
