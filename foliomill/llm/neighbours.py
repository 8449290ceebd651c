"""Nearest neighbours by multi-index hashing (operator 13).

A rotation learned on a bounded sample turns each vector into a binary code, which is split into substrings. Every row is indexed, in
blocks that tasks hold one at a time; in a block each substring has a table from its value to the rows that have it. By the
pigeonhole principle a code within `radius` bits of a query's agrees with it in some substring up to radius // substrings bits, so
probing the tables that far retrieves every such code; what is retrieved is measured on the original vectors. The radius is that
within which the sample's own nearest neighbours lie. Queries that found fewer than k are asked again with a larger one, up to all bits.

A block meets the queries in groups: a task holds one block and streams a group's queries past it, and returns each query's k best,
so neither a hot region nor many equal vectors make pairs. Rows are dealt to blocks by hash, so that a hot region spreads over all.

Other columns are not read. Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a
null vec_id; vectors of different length are no candidates of each other; equal rows (vec_id and vector) count once; rows that share
a vec_id with the query are its own and no candidates; no rows, or a query alone, give no rows. Vectors may be of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.llm.common import lean, settle, table, unsettle

#: Bits of a code are PIECES substrings of PIECE_BITS bits.
PIECES, PIECE_BITS = 8, 16
BITS = PIECES * PIECE_BITS
#: Rows on which rotations and radius are learned, at most, for each length of vectors.
SAMPLE = 4096
#: Lengths of vectors, the most frequent first and none over LONGEST, for which rotations are learned; others get random directions.
LEARNED, LONGEST = 16, 1024
#: Components that random directions are made for at a time.
SLICE = 4096
#: The share of the sample's nearest neighbours that the radius must reach.
REACH = 0.98
#: Bits by which the radius grows, in turn, for queries that found too few; the last covers all codes.
WIDER = (0, 16, BITS)
BLOCK, GROUP = 16_384, 32_768
#: Blocks of fewer rows are not made for the sake of idle cores.
SMALL = 1024
#: Tasks of a search at most; each takes its cells in turn.
MOST_PARTITIONS = 50_000
_POP = np.array([bin(i).count("1") for i in range(1 << PIECE_BITS)], np.uint8)
#: The differences of two substrings, by their number of bits.
_MASKS = np.argsort(_POP, kind="stable").astype(np.uint16)
_UP_TO = np.cumsum(np.bincount(_POP))


@dataclass
class Model:
    """Codes for vectors of one length: the signs of the centred vectors under each rotation, and the radius to search."""

    mean: np.ndarray | float
    rotations: np.ndarray | None
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, PIECES) of uint16."""
        y = _sized(x) - self.mean
        if self.rotations is not None:
            turned = y @ self.rotations
        else:
            turned = np.zeros((len(x), BITS))
            for at in range(0, x.shape[1], SLICE):
                part = y[:, at : at + SLICE]
                turned += part @ np.random.default_rng([x.shape[1], at]).normal(size=(part.shape[1], BITS))
        return np.packbits(turned > 0, axis=1, bitorder="little").view("<u2").astype(np.uint16)


def _sized(x: np.ndarray) -> np.ndarray:
    """x, but rows out of a range in which squares stay in that of doubles are scaled into it."""
    top = np.abs(x).max(1, keepdims=True)
    return np.where((top < 1e-100) | (top > 1e100), x / top, x)


def distances(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of v from q in double precision; out of the range of squares they are scaled by a power of two."""
    with np.errstate(over="ignore", invalid="ignore"):
        diff = v - q
        top = np.abs(diff).max(1)
        out = np.sqrt((diff * diff).sum(1))
        for i in np.nonzero((top > 0) & ~((top > 1e-140) & (top < 1e140)))[0]:
            most = top[i] if np.isfinite(top[i]) else max(np.abs(v[i]).max(), np.abs(q).max())
            by = math.frexp(most)[1]
            part = np.ldexp(v[i], -by) - np.ldexp(q, -by)
            out[i] = np.ldexp(np.sqrt((part * part).sum()), by)
    return out


def _turned(z: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """A rotation under which the signs of z lose little: alternately the signs, then the rotation that fits them best."""
    dim = z.shape[1]
    r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    for _ in range(rounds if len(z) >= dim else 0):
        u, _, vt = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
        r = (u @ vt).T
    return r


def learned(sample: np.ndarray, k: int, reach: float = REACH) -> Model:
    """Rotations and radius from a sample; the same for the same sample."""
    dim, rng = sample.shape[1], np.random.default_rng(sample.shape[1])
    x = _sized(sample)
    mean = x.mean(0)
    z = x - mean
    parts = [_turned(z, rng) for _ in range(-(-BITS // dim))]
    made = Model(mean, np.concatenate(parts, axis=1)[:, :BITS], BITS)
    codes, far = made.codes(sample), []
    for i in range(0, len(x), max(1, len(x) // 256)):  # of 256 rows and more the distance, in bits, to each of the k nearest
        d = distances(sample, sample[i])
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        far += _POP[codes[near] ^ codes[i]].sum(1).tolist()
    if far:
        made.radius = int(np.quantile(far, reach, method="higher"))
    return made


class Index:
    """A block's rows by the values of each substring."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, codes: np.ndarray):
        self.ids, self.v, self.codes = ids, v, codes
        self.tables = []
        for s in range(PIECES):
            rows = np.argsort(codes[:, s], kind="stable")
            values, starts, counts = np.unique(codes[rows, s], return_index=True, return_counts=True)
            slot = np.full(1 << PIECE_BITS, -1, np.int32)
            slot[values] = np.arange(len(values))
            self.tables.append((rows, values, starts, counts, slot))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose code differs from `code` in at most `radius` bits."""
        found = np.zeros(len(self.ids), bool)
        each = min(radius // PIECES, PIECE_BITS)
        for (rows, values, starts, counts, slot), key in zip(self.tables, code, strict=True):
            # probe all values that near, or look through those that there are if these are fewer
            if _UP_TO[each] < len(values):
                at = slot[_MASKS[: _UP_TO[each]] ^ key]
                at = at[at >= 0]
            else:
                at = np.nonzero(_POP[values ^ key] <= each)[0]
            n = counts[at]
            found[rows[np.repeat(starts[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]] = True
        rows = np.nonzero(found)[0]
        return rows[_POP[self.codes[rows] ^ code].sum(1) <= radius]

    def nearest(self, vec_id: int, q: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest rows of those within the radius, ties to the smaller id; rows of the query's id aside."""
        rows = self.within(code, radius)
        rows = rows[self.ids[rows] != vec_id]
        d = distances(self.v[rows], q) if len(rows) else np.zeros(0)
        if len(rows) > k:
            near = d <= np.partition(d, k - 1)[k - 1]
            rows, d = rows[near], d[near]
        by = np.lexsort((self.ids[rows], d))[:k]
        return self.ids[rows[by]], d[by]


def _model(models: dict[int, Model], dim: int) -> Model:
    if dim not in models:
        models[dim] = Model(0.0, None, BITS // 4)  # random directions
    return models[dim]


def _search(index: DataFrame, asked: DataFrame, learned_models: dict[int, Model], k: int, extra: int, n_rows: dict[int, int]) -> DataFrame:
    """(q, query_id, vec_id, score): each block's k best for each asked row (q, vec_id, v, dim), `extra` bits beyond the radius."""
    cores = index.sparkSession.sparkContext.defaultParallelism
    # blocks by length: of bounded size, and enough for all cores
    n_blocks = {d: max(1, -(-n // BLOCK), min(cores, -(-n // SMALL))) for d, n in n_rows.items()}
    several = {d: n for d, n in n_blocks.items() if n > 1}
    sizes = F.create_map(*[x for d, n in several.items() for x in (F.lit(d), F.lit(n))]) if several else None
    n_asked = asked.count()
    groups = max(1, -(-n_asked // GROUP))
    blocks = F.coalesce(sizes[F.col("dim")], F.lit(1)) if several else F.lit(1)
    base = index.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), blocks).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    query = asked.withColumn("grp", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    columns = ["dim", "block", "grp", "kind", "q", "vec_id", "v"]
    both = base.withColumns({"kind": F.lit(0), "q": F.lit(None).cast("long")}).select(*columns).unionByName(query.withColumn("kind", F.lit(1)).select(*columns))
    models = dict(learned_models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, built = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            ids, q = batch.column(5).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1, len(keys)] if len(keys) else np.zeros(1, int)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if (key := tuple(keys[lo, :3])) != cell:
                    cell, held, built = key, [], None
                dim = int(key[0])
                v = batch.column(6).slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, dim)
                if keys[lo, 3] == 0:
                    held.append((ids[lo:hi].copy(), v.copy()))
                    continue
                if not held:
                    continue
                model = _model(models, dim)
                if built is None:
                    all_ids, all_v = (np.concatenate(x) for x in zip(*held, strict=True))
                    built, held = Index(all_ids, all_v, model.codes(all_v)), [()]
                codes, out = model.codes(v), []
                for i in range(hi - lo):
                    near, d = built.nearest(ids[lo + i], v[i], codes[i], min(BITS, model.radius + extra), k)
                    out.append((np.full(len(near), q[lo + i], np.int64), np.full(len(near), ids[lo + i]), near, d))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["q", "query_id", "vec_id", "score"])
        lean()

    cells = groups * sum(n_blocks.values())
    dealt = both.repartition(max(1, min(cells, MOST_PARTITIONS)), "dim", "block", "grp").sortWithinPartitions("dim", "block", "grp", "kind")
    return dealt.mapInArrow(run, "q long, query_id long, vec_id long, score double")


def neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", *, k: int = 10, sample: int = SAMPLE, reach: float = REACH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row for which is_query (a condition on vec_id) holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter("vec_id IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    index = settle(rows.filter(F.coalesce(fine, F.lit(False))).distinct().withColumn("dim", F.size("v")))
    n_rows = {r["dim"]: r["count"] for r in index.groupBy("dim").count().orderBy(F.desc("count"), "dim").collect()}
    models: dict[int, Model] = {}
    for dim in [d for d in n_rows if d <= LONGEST][:LEARNED]:
        drawn = index.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("v").collect()
        models[dim] = learned(np.array([r["v"] for r in drawn], np.float64), k, reach)
    left, found = settle(index.filter(is_query).withColumn("q", F.monotonically_increasing_id())), []
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    for extra in WIDER:
        made = settle(_search(index, left, models, k, extra, n_rows).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
        if extra == WIDER[-1]:
            found.append(made)
            break
        # those that found fewer than k are asked again; their answers so far are left out
        few = settle(left.join(made.filter(F.col("rank") == k).select("q"), "q", "left_anti"))
        found.append(made.join(few.select("q"), "q", "left_anti"))
        left = few
        if left.isEmpty():
            break
    unsettle(index)
    return reduce(DataFrame.unionByName, found).select("query_id", "rank", "vec_id", "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
