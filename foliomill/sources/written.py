"""Tables that a job writes for itself and reads several times, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="foliomill-")


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder, which only local mode may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    return found or _local()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table: what follows reads it instead of planning and computing it again, and survives lost executors."""
    path = f"{folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
