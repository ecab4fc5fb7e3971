"""What the text operators share: words, row keys, and tables kept in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts (space, tab to carriage return), as a class for Java and Python.
GAP = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Lower-cases A to Z only.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order. An empty text has none."""
    return F.array_remove(F.split(text, GAP), "")


def with_key(docs: DataFrame, name: str = "_key") -> DataFrame:
    """Add a digest of doc_id and text.

    Rows that agree in both get the same key: operators judge them once and give all of them the answer.
    """
    mark = F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.lit("+"))
    )
    return docs.withColumn(name, F.md5(F.concat(mark, text_or_empty())))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a local one only where none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="llm-steps-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back, so lost executors do not repeat what came before."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
