"""What several operators share: tables in the shared folder, row keys, connected components, global order."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word is a run of characters that are neither a space nor one of tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. It must be set: a local folder would differ from machine to machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        found = _local_dir()
    return found


@cache
def _local_dir() -> str:
    """In local mode, where driver and executors are one process, a folder of its own."""
    return "file://" + tempfile.mkdtemp(prefix="foliomill-")


def settle(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table to the shared folder and read it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def unsettle(df: DataFrame | None) -> None:
    """Delete a table made by settle() that nothing reads any more."""
    path = getattr(df, "_settled_at", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def lean() -> None:
    """Give freed memory back, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def fold(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root (of each node the least node that it reaches) after more edges (x, y)."""
    root = root.copy()
    while len(x):
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            break
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have, so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def aside(right: DataFrame, left: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """right with its columns renamed so that none clashes with one of left, and the new names."""
    names = {c: own(left, f"other_{c}") for c in right.columns}
    return right.withColumnsRenamed(names), names


def with_fields(schema: StructType, fields: dict[str, str]) -> StructType:
    """schema with more fields; their types are given as SQL has them."""
    return StructType([*schema.fields, *[StructField(c, StructType.fromDDL(f"x {kind}")["x"].dataType) for c, kind in fields.items()]])


def n_words(text: Column) -> Column:
    """Words in text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def components(edges: DataFrame) -> DataFrame:
    """(node long, component long): the least node that each node of the edges (a long, b long) reaches.

    Alternates large-star and small-star rounds. A node's least neighbour comes from an aggregate with partial sums and a join,
    so a node with very many neighbours is never gathered in one task. Every round is a table in the shared folder.
    Self-loops give a component of one node; null ends are dropped; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    nodes = now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = settle(small.filter("a > b").distinct())
        # the edges are the same as before when their number and two sums of hashes are
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a", F.lit(1)).cast("decimal(38,0)"))).first()
        if now is not nodes:
            unsettle(now)
        now = new
        if state == before:
            break
        before = state
    every = nodes.select(F.col("a").alias("node")).unionByName(nodes.select(F.col("b").alias("node"))).distinct()
    root = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return settle(every.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def joined_components(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """parts (node, component) after more edges (a, b): only the components that these join are labelled anew."""
    of = parts.select(F.col("node"), F.col("component").alias("c"))
    ends = edges.join(of.withColumnRenamed("node", "a"), "a", "left").withColumn("x", F.coalesce("c", "a")).drop("c")
    ends = settle(ends.join(of.withColumnRenamed("node", "b"), "b", "left").select("a", "b", "x", F.coalesce("c", "b").alias("y")))
    root = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("root"))
    fresh = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct().join(parts, "node", "left_anti")
    every = parts.unionByName(fresh.withColumn("component", F.col("node")))
    return settle(every.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
