"""The corpus pipeline: five stages over documents, each written as Parquet and read as the next one's documents.

A stage takes (spark, docs, sf_dir) and gives the documents that go on, in their own columns; the last one says
where each goes. Stages keep repeated rows, null columns and empty tables as their operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import settle, table, text_or_empty
from barspark.llm.decontamination import find_leaks
from barspark.llm.mixing import mixed_documents
from barspark.llm.near_copies import near_copy_groups
from barspark.llm.quality_rules import quality_rules
from barspark.llm.sharding import shard_documents
from barspark.llm.simhash_dedup import keep_one

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, carry=COLUMNS).filter("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of smallest doc_id."""
    docs = docs.select(*COLUMNS)
    return keep_one(docs, near_copy_groups(docs))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(text_or_empty()) == F.col("_tie"))
    return docs.select(*COLUMNS).join(found, same, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each as often as it is taken."""
    return mixed_documents(docs.select(*COLUMNS))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document of the mix."""
    return shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


STAGES = [("quality rules", quality), ("near copies", near_copies), ("decontamination", leaks), ("mixing", mix), ("sharding", shards)]

#: SQL can express neither near copies nor edits; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
