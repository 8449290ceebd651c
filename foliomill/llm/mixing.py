"""Mixing sources to target weights by pivotal dependent rounding (operator 1). DataFrame functions only.

Each document of a source wants target/size copies. Whole copies are given; the fractions of a source's documents are
settled in pairs: word mass moves at random between two documents until one fraction becomes 0 or 1, so that expected
copies stay what they were and the words taken by a source change by at most one document. Groups of bounded size settle
in parallel and leave one residual each; residuals are grouped again, up a tree, until one is left for each source.

Defined results: null text has size 0; the null source is a source of its own, last in order; documents of size 0 are
taken like others but add no words; identical rows share their copies as evenly as whole copies go; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.llm.common import aside, n_words, own, settle, table

#: Units settled one after the other in a group of the reduction tree.
FAN_IN = 64
#: Fractions nearer than this to 0 or 1 are whole.
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources by code point, null last, get the weights in turn and share `share` of all words; a target stops at `most` times its
    source's size and the excess goes to the others by weight, again until none is above. Each round is one small aggregate.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = settle(_ordered(sources))
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(n)) + 1).cast("int"))
    rows = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.col("cap") <= F.col("weight") * level * (1 + 1e-12)
        got = rows.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count(F.when(above, 1))).first()
        if got[2] == full or not got[1]:
            break
        full, level = got[2], (share * total - got[0]) / got[1]
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _ordered(sources: DataFrame) -> DataFrame:
    """sources with a rank from 0 by code point, null last; ranks come from range partitions and their counts, not from one task."""
    parts = settle(sources.repartitionByRange(16, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    # at most as many rows as range partitions
    bases, base = [(-1, 0)], 0
    for r in sorted(parts.groupBy("part").count().collect()):
        bases.append((r["part"], base))
        base += r["count"]
    before = sources.sparkSession.createDataFrame(bases, "part int, before long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("within", within).join(F.broadcast(before), "part").select("source", "source_size", (F.col("before") + F.col("within")).alias("rank"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash, so that reruns agree."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _pivot(held: Column, unit: Column, seed: int) -> Column:
    """One transfer between the residual and the next unit: a struct of the new residual and the list of settled units."""
    r = held["rest"]
    a, wa, b, wb = r["p"], r["w"], unit["p"], unit["w"]
    mass = a * wa + b * wb
    # mass moves to b until a is 0 or b is 1 (down), or to a until a is 1 or b is 0 (up)
    down, up = F.least(a * wa, (1 - b) * wb), F.least((1 - a) * wa, b * wb)
    take_down = _uniform(r["id"], unit["id"], F.lit(seed)) * (down + up) < up
    a_whole = F.when(take_down, a * wa <= (1 - b) * wb).otherwise((1 - a) * wa <= b * wb)
    a_end = F.when(take_down, 0.0).otherwise(1.0)
    b_end = F.when(take_down, 1.0).otherwise(0.0)
    settled = F.when(a_whole, F.struct(r["id"].alias("id"), a_end.alias("p"))).otherwise(F.struct(unit["id"].alias("id"), b_end.alias("p")))
    rest = F.when(
        a_whole, F.struct(unit["id"].alias("id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mass - a_end * wa) / wb)).alias("p"), wb.alias("w"))
    ).otherwise(F.struct(r["id"].alias("id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mass - b_end * wb) / wa)).alias("p"), wa.alias("w")))
    return F.struct(rest.alias("rest"), F.concat(held["done"], F.array(settled)).alias("done"))


def round_copies(units: DataFrame, seed: int = 7, fan_in: int = FAN_IN) -> DataFrame:
    """(source, id, up) for units (source, id struct or value, p in (0, 1), w over 0): up is 1 where the fraction became 1, else 0.

    A group settles its largest units first, so that the residual it leaves is likely a small one.
    A source's rows are dealt over as many groups as it needs by a hash of the id, so a source that holds most rows fills many tasks.
    """
    level, done = settle(units.select("source", "id", "p", "w")), None
    first = level
    turn = 0
    while True:
        counts = level.groupBy("source").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most == 0:
            break
        last = most <= fan_in
        groups = counts.select("source", F.ceil(F.col("n") / F.lit(fan_in / 2 if not last else fan_in)).alias("groups"))
        groups = groups.withColumn("groups", F.when(F.lit(last), F.lit(1)).otherwise(F.col("groups")))
        right = groups.withColumnRenamed("source", "of")
        dealt = level.join(F.broadcast(right) if counts.count() <= 100_000 else right, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        dealt = dealt.withColumn("g", F.pmod(F.xxhash64("id", F.lit(seed + turn)), F.col("groups")))
        packed = dealt.groupBy("source", "g").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("o"), F.xxhash64("id", F.lit(seed)).alias("r"), "id", "p", "w"))).alias("u"))
        start = F.struct(F.element_at("u", 1)["id"].alias("id"), F.element_at("u", 1)["p"].alias("p"), F.element_at("u", 1)["w"].alias("w"))
        none = F.slice(F.transform("u", lambda x: F.struct(x["id"].alias("id"), F.lit(0.0).alias("p"))), 1, 0)
        s = seed + turn
        folded = F.aggregate(F.slice("u", 2, F.greatest(F.size("u") - 1, F.lit(0))), F.struct(start.alias("rest"), none.alias("done")), lambda acc, x: _step(acc, x, s))
        out = settle(packed.select("source", folded.alias("f")))
        settled = out.select("source", F.explode("f.done").alias("d")).select("source", F.col("d.id").alias("id"), F.col("d.p").alias("up"))
        done = settled if done is None else done.unionByName(settled)
        level = out.select("source", F.col("f.rest.id").alias("id"), F.col("f.rest.p").alias("p"), F.col("f.rest.w").alias("w"))
        turn += 1
        if last:
            draw = F.when(_uniform(F.col("id"), F.lit(seed + 1000)) < F.col("p"), 1.0).otherwise(0.0)
            done = done.unionByName(level.select("source", "id", draw.alias("up")))
            break
    if done is None:
        done = first.select("source", "id", F.col("p").alias("up"))
    return done.select("source", "id", F.col("up").cast("long").alias("up"))


def _step(held: Column, unit: Column, seed: int) -> Column:
    """Whole residuals are set aside as they are; else mass moves."""
    r = held["rest"]
    whole = (r["p"] <= EPS) | (r["p"] >= 1 - EPS)
    aside = F.struct(
        F.struct(unit["id"].alias("id"), unit["p"].alias("p"), unit["w"].alias("w")).alias("rest"),
        F.concat(held["done"], F.array(F.struct(r["id"].alias("id"), F.round(r["p"]).alias("p")))).alias("done"),
    )
    return F.when(whole, aside).otherwise(_pivot(held, unit, seed))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """docs' distinct rows (doc_id, source, size, row_hash) with n_rows, source_size, target and the copies that all these rows get together."""
    row_hash = F.xxhash64(*[F.col(c) for c in docs.columns])
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash.alias("row_hash"))
    rows = settle(rows.groupBy("doc_id", "source", "size", "row_hash").agg(F.count("*").alias("n_rows")))
    targets = settle(source_targets(rows.select("source", (F.col("size") * F.col("n_rows")).alias("size")), weights, share, most))
    right = targets.withColumnRenamed("source", "of")
    few = targets.count() <= 100_000
    rows = rows.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("n_rows")
    rows = rows.withColumn("want", F.when(want - F.floor(want) > 1 - EPS, F.ceil(want)).otherwise(want)).withColumn("whole", F.floor("want"))
    rows = rows.withColumn("id", F.struct("doc_id", "size", "row_hash"))
    open_ = rows.filter((F.col("size") > 0) & (F.col("want") - F.col("whole") > EPS))
    ups = round_copies(open_.select("source", "id", (F.col("want") - F.col("whole")).alias("p"), F.col("size").cast("double").alias("w")), seed)
    ups = ups.select(F.col("source").alias("of"), F.col("id").alias("unit"), "up")
    out = rows.join(ups, F.col("source").eqNullSafe(F.col("of")) & F.col("id").eqNullSafe(F.col("unit")), "left")
    return out.select("doc_id", "source", "size", "row_hash", "n_rows", "source_size", "target", (F.col("whole") + F.coalesce("up", F.lit(0))).cast("long").alias("copies"))


def _each_row(mixed: DataFrame) -> DataFrame:
    """One row for each row of the documents: identical rows share their copies as evenly as they go."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)).alias("k")
    rows = mixed.select("*", k)
    copies = F.floor(F.col("copies") / F.col("n_rows")) + F.when(F.col("k") < F.col("copies") % F.col("n_rows"), 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("long")).drop("k", "n_rows")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return _each_row(mix(docs)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, with all its columns."""
    mixed = mix(docs).select("doc_id", "row_hash", "copies", "n_rows").filter("copies > 0")
    mixed, x = aside(mixed, docs)
    h = own(docs, "this_hash")
    rows = docs.withColumn(h, F.xxhash64(*[F.col(c) for c in docs.columns]))
    on = F.col("doc_id").eqNullSafe(F.col(x["doc_id"])) & (F.col(h) == F.col(x["row_hash"]))
    once = rows.join(mixed.filter(F.col(x["n_rows"]) == 1), on)
    # rows that occur more than once are gathered with partial sums, as they are the same in all columns
    again = rows.join(mixed.filter(F.col(x["n_rows"]) > 1), on)
    again = again.groupBy(x["doc_id"], x["row_hash"]).agg(*[F.first(c).alias(c) for c in docs.columns], F.first(x["copies"]).alias(x["copies"]))
    both = once.select(*docs.columns, x["copies"]).unionByName(again.select(*docs.columns, x["copies"]))
    return both.withColumn(h, F.explode(F.sequence(F.lit(1).cast("long"), F.col(x["copies"])))).select(*docs.columns)
