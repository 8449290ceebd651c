"""Centroid clustering with partial-distance search (operator 11).

Vectors become integers, floor(256 * x). Every round reads them in tasks that keep no more than a batch: squared differences are added
over the dimensions of highest variance first, each vector's most promising centroid is finished early, and a centroid is abandoned for
a vector once its partial sum is strictly above the vector's best whole distance; what survives finishes all dimensions. Tasks return
sums for each centroid and dimension, in limbs of 30 bits, so sums are exact at any size; only these go to the driver. No row is shuffled.

Other columns are not read. Defined results: null vectors, vectors of another length and such with null or non-finite components are
left out; a row with a null vec_id is assigned but starts no centroid; rows that share a vec_id start centroids in the order of their
components; repeated rows each have a row; with fewer rows than centroids there are fewer centroids; without any there are no rows. A distance or
an inertia beyond 64 bits is null. Texts do not occur; a vector of any other length, however long, is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.common import lean, settle, table, unsettle

SCALE = 256
DIM, CENTROIDS, ROUNDS, SALT = 64, 40, 5, "2:"
#: Dimensions that are added before a check for centroids to abandon.
STEPS = (8, 8, 16, 32)
#: int64 holds the sums of 64 squared differences of integers up to this.
SAFE = 1 << 27
LIMB = 30
BATCH = 8192
#: The "dimension" that counts a centroid's vectors.
COUNT = -1


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) exactly: int64, or Python integers where those could overflow a sum."""
    if not x.size or np.abs(x).max() <= SAFE // SCALE:
        return np.floor(SCALE * x).astype(np.int64)
    out = np.empty(x.shape, object)
    for i, v in np.ndenumerate(x):
        p, q = float(v).as_integer_ratio()
        out[i] = SCALE * p // q
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 if each is, else both as Python integers."""
    return (a, b) if a.dtype == b.dtype else (a.astype(object), b.astype(object))


def nearest(v: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row of v, ties to the smaller number, and how many differences were computed. order: dimensions, those to add first."""
    v, c = _alike(v[:, order], centroids[:, order])
    n, k = len(v), len(c)
    steps = [STEPS[0]]
    while steps[-1] < v.shape[1]:
        steps.append(min(v.shape[1], steps[-1] + STEPS[min(len(steps), len(STEPS) - 1)]))
    partial = np.zeros((n, k), v.dtype)
    for d in range(min(steps[0], v.shape[1])):
        diff = v[:, d, None] - c[None, :, d]
        partial += diff * diff
    # the most promising centroid gives each vector a whole distance to hold the others against
    best_at = partial.argmin(1)
    rows = np.arange(n)
    diff = v[:, steps[0] :] - c[best_at, steps[0] :]
    best = partial[rows, best_at] + (diff * diff).sum(1)
    done = v.shape[1] * n + steps[0] * n * (k - 1)
    i, j = np.nonzero(partial <= best[:, None])
    other = j != best_at[i]
    i, j = i[other], j[other]
    sums = partial[i, j]
    for lo, hi in zip(steps, steps[1:], strict=False):
        diff = v[i, lo:hi] - c[j, lo:hi]
        done += diff.size
        sums = sums + (diff * diff).sum(1)
        stay = (sums <= best[i]).astype(bool)
        i, j, sums = i[stay], j[stay], sums[stay]
    # survivors have their whole distance; ties go to the smaller number
    if len(i):
        by = np.lexsort((j, sums.astype(np.int64), i)) if sums.dtype != object else np.array(sorted(range(len(i)), key=lambda t: (i[t], sums[t], j[t])))
        i, j, sums = i[by], j[by], sums[by]
        first = np.r_[True, i[1:] != i[:-1]]
        i, j, sums = i[first], j[first], sums[first]
        better = ((sums < best[i]) | ((sums == best[i]) & (j < best_at[i]))).astype(bool)
        best[i[better]], best_at[i[better]] = sums[better], j[better]
    return best_at, best, done


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """total as sum of value << (LIMB * limb), each value below 2^30 in size."""
    sign, rest, limb = (-1 if total < 0 else 1), abs(total), 0
    while rest:
        yield limb, sign * (rest & ((1 << LIMB) - 1))
        rest >>= LIMB
        limb += 1


def _rows(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part, integers(part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim))


def _sums(kept: DataFrame, centroids: np.ndarray, order: np.ndarray) -> dict[tuple[int, int], int]:
    """The exact sums of each (centroid, dimension), with the numbers of vectors (COUNT), of one assignment of all vectors."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for _, v in _rows(batches, 0, dim):
            at, _, _ = nearest(v, centroids, order)
            for c in np.unique(at):
                mine = v[at == c]
                for d, x in enumerate(mine.sum(0)):
                    sums[int(c), d] = sums.get((int(c), d), 0) + int(x)
                sums[int(c), COUNT] = sums.get((int(c), COUNT), 0) + len(mine)
        out = [(c, d, limb, x) for (c, d), total in sums.items() for limb, x in _limbs(total)]
        lean()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["c", "d", "limb", "x"])

    made = kept.select("v").mapInArrow(run, "c int, d int, limb int, x long").groupBy("c", "d", "limb").agg(F.sum("x").alias("x"))
    total: dict[tuple[int, int], int] = {}
    for r in made.collect():  # one row for each centroid, dimension and limb
        total[r["c"], r["d"]] = total.get((r["c"], r["d"]), 0) + (r["x"] << (LIMB * r["limb"]))
    return total


def _as_array(rows: list[list[int]]) -> np.ndarray:
    wide = any(abs(x) > SAFE for row in rows for x in row)
    return np.array(rows, dtype=object if wide else np.int64).reshape(len(rows), -1)


def _long(x: int | None) -> int | None:
    return x if x is not None and x < 1 << 63 else None


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", *, dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each vector kept. k and dim bound what the driver and each task hold."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = settle(rows.filter(F.coalesce(fine, F.lit(False))))
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    starts = kept.filter("vec_id IS NOT NULL").orderBy(hashed, "vec_id", "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not starts:
        none = vectors.sparkSession.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
        unsettle(kept)
        return none
    centroids = _as_array([list(x) for x in integers(np.array([r["v"] for r in starts], np.float64))])
    # dimensions by variance: only the order of adding depends on it
    spread = kept.agg(*[F.variance(F.col("v")[d]).alias(f"d{d}") for d in range(dim)]).first()
    order = np.argsort([-(x if x is not None and np.isfinite(x) else 0) for x in spread], kind="stable")
    for _ in range(rounds):
        total = _sums(kept, centroids, order)
        centroids = _as_array([[total.get((c, d), 0) // total[c, COUNT] for d in range(dim)] if (c, COUNT) in total else [int(x) for x in centroids[c]] for c in range(len(centroids))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _rows(batches, 1, dim):
            at, distance, _ = nearest(v, centroids, order)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at.astype(np.int32)), pa.array([_long(int(x)) for x in distance], pa.int64())], ["vec_id", "cluster", "distance"])
        lean()

    made = settle(kept.select("vec_id", "v").mapInArrow(assign, schema))
    whole = {r["cluster"]: r for r in made.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()}
    inertia = {c: None if r["lost"] else int(r["s"]) for c, r in whole.items()}
    every = _long(None if None in inertia.values() else sum(inertia.values()))
    said = [(c, _long(x), every, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, x in inertia.items()]
    about = vectors.sparkSession.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    unsettle(kept)
    return made.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _round(i: int) -> str:
    """One round: every vector to its nearest centroid (c{i}), then the floors of the means."""
    return f"""a{i} AS (SELECT vec_id, v, c, d FROM (SELECT e.rid, vec_id, e.v, c, list_sum(list_transform(list_zip(e.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d, row_number() OVER (PARTITION BY rid ORDER BY list_sum(list_transform(list_zip(e.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c) AS n FROM kept e CROSS JOIN c{i} m) WHERE n = 1),
    s{i} AS (SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, {DIM + 1})) AS j FROM a{i}) GROUP BY c, j),
    c{i + 1} AS MATERIALIZED (SELECT m.c, coalesce(f.v, m.v) AS v FROM c{i} m LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{i} GROUP BY c) f ON m.c = f.c)"""


SQL = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
    c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SALT}' || vec_id::VARCHAR)) - 1)::INT AS c, v FROM kept QUALIFY c < {CENTROIDS}),
    {", ".join(_round(i) for i in range(ROUNDS))},
    last AS (SELECT * FROM (SELECT rid, vec_id, m.c, m.v AS cv, list_sum(list_transform(list_zip(e.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept e CROSS JOIN c{ROUNDS} m) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)
    SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(cv, ',')) AS centroid_sha256 FROM last"""
