"""The corpus pipeline: five of the llm operators in a row, each stage written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliomill.llm.common import settle, table
from foliomill.llm.language import keep_identified
from foliomill.llm.lines import without_repeated_lines
from foliomill.llm.mixing import mixed_documents
from foliomill.llm.near_dups import one_of_each_group
from foliomill.llm.packing import packed_sequences

STAGES = [
    ("language ID", keep_identified),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("mixing", mixed_documents),
    ("packing", packed_sequences),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs
