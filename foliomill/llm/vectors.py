"""Near-duplicate embeddings by int8 tile products with error bounds (operator 8).

Equal vectors become one. Unit vectors are quantised to int8 with the exact norm of what quantisation lost; tiles of them are
multiplied, and a pair can only reach the threshold if its product is above it less the pair's error bound. Such pairs, and no
others, are computed again in double precision. A tile pair yields link counts and a spanning forest of its links, never pairs.

Other columns are not read; vectors may have any length. Defined results: null or zero vectors and such with null or non-finite components link with nothing; vectors of different length do
not link; rows of equal vectors link with each other; repeated rows each have a row; component_id is null only where every vec_id is; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.common import components, fold, lean, settle, table, unsettle

TILE = 8192
STRIPE = 1024
#: Vectors of a tile that are not dealt further for the sake of idle cores.
SMALL = 1024
#: Dimensions whose int8 products float32 adds exactly (127 * 127 * 1024 < 2^24).
EXACT = 1024
#: Covers rounding of the double and float operations in a bound.
SLACK = 1e-6


def in_range(x: np.ndarray) -> np.ndarray:
    """x, but rows whose squares would leave the range of doubles scaled by a power of two, which no cosine sees."""
    top = np.abs(x).max(1)
    odd = (top < 1e-100) | (top > 1e100)
    if odd.any():
        x = x.copy()
        x[odd] = np.ldexp(x[odd], -np.frexp(top[odd])[1][:, None])
    return x


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q int8, scale, error): |unit - scale * q| = error exactly, row by row."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - scale[:, None] * q, axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, by float32 multiplication in slices that it adds exactly."""
    out = None
    for d in range(0, a.shape[1], EXACT):
        part = a[:, d : d + EXACT].astype(np.float32) @ b[:, d : d + EXACT].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine of at least threshold in double precision; of one tile with itself only i < j."""
    a, b = in_range(a), in_range(b)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ua, ub = a / na[:, None], b / nb[:, None]
    (qa, sa, ea), (qb, sb, eb) = quantise(ua), quantise(ub)
    for i0 in range(0, len(a), STRIPE):
        i1 = min(i0 + STRIPE, len(a))
        j0 = i0 if same else 0
        if j0 >= len(b):
            continue
        got = _products(qa[i0:i1], qb[j0:])
        # |cos - sa sb q.q| <= (1 + ea) eb + ea; with the stripe's worst eb and sb this gives one limit for each row
        worst_e, worst_s = eb[j0:].max(), sb[j0:].max()
        room = threshold - ((1 + ea[i0:i1]) * worst_e + ea[i0:i1]) - SLACK
        limit = np.where(room > 0, room / (sa[i0:i1] * worst_s), -np.inf)
        limit = np.nextafter(limit.astype(np.float32), np.float32(-np.inf)) if got.dtype == np.float32 else limit
        i, j = np.nonzero(got >= limit[:, None])
        dots = got[i, j].astype(np.float64)
        i, j = i + i0, j + j0
        if same:
            up = i < j
            i, j, dots = i[up], j[up], dots[up]
        near = sa[i] * sb[j] * dots >= threshold - ((1 + ea[i]) * eb[j] + ea[i]) - SLACK
        i, j = i[near], j[near]
        for k in range(0, len(i), 100_000):
            x, y = i[k : k + 100_000], j[k : k + 100_000]
            exact = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y])
            yes = exact >= threshold
            yield x[yes], y[yes]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", *, threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
    # two hashes tell vectors apart; a class's own number stands for it from then on
    hashes = [F.when(F.col("ok"), F.xxhash64("v", *seed)).alias(c) for c, seed in (("h1", []), ("h2", [F.lit(1)]))]
    rows = settle(rows.select("vec_id", *hashes, F.when(F.col("ok"), F.col("v")).alias("v")))
    classes = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = settle(classes.withColumns({"dim": F.size("v"), "h": F.monotonically_increasing_id()}))
    n = classes.count()
    # tiles of bounded size, and enough of them for all cores
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, -(-n // tile), min(math.ceil(math.sqrt(2 * cores)), -(-n // SMALL)))
    mine = F.pmod(F.xxhash64("h"), F.lit(tiles)).cast("int")
    sent = classes.select("dim", "h", "n", "v", mine.alias("t"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("o"))
    sent = sent.select("dim", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "t", "h", "n", "v")

    def multiply(group: pa.Table) -> pa.Table:
        first, second = group["a"][0].as_py(), group["b"][0].as_py()
        t, h, n = (group[c].to_numpy() for c in ("t", "h", "n"))
        v = group["v"].combine_chunks()
        x = v.flatten().to_numpy().reshape(len(v), -1)
        order = np.argsort(h)
        left, right = order[t[order] == first], order[t[order] == second]
        links, root = np.zeros(len(h), np.int64), np.arange(len(h))
        if len(left) and len(right):
            for i, j in tile_links(x[left], x[right], threshold, first == second):
                p, q = left[i], right[j]
                np.add.at(links, p, n[q])
                np.add.at(links, q, n[p])
                root = fold(root, p, q)  # links go into the forest at once and are not kept
        lean()
        on = links > 0
        return pa.table({"h": h[on], "links": links[on], "root": h[root[on]]})

    made = settle(sent.groupBy("dim", "a", "b").applyInArrow(multiply, "h long, links long, root long"))
    links = made.groupBy("h").agg(F.sum("links").alias("links"))
    parts = components(made.select(F.col("h").alias("a"), F.col("root").alias("b")))
    of = classes.select("h", "h1", "h2", "first", "n").join(links, "h", "left").join(parts.withColumnRenamed("node", "h"), "h", "left")
    of = settle(of.select("h1", "h2", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "h").alias("component")))
    for used in (classes, made, parts):
        unsettle(used)
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of = of.join(least, "component").select("h1", "h2", "n_links", "component_id")
    out = rows.select("vec_id", "h1", "h2").join(of, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
