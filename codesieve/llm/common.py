"""Helpers shared by the operators: the shared work folder, written tables, row keys."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
ROW = "__row"
_own: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named."""
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if shared:
        return shared
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="llm-work-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_key(docs: DataFrame) -> DataFrame:
    """Adds ``__row``, a key that tells any two rows apart, repeated rows included.

    For a plain scan of files (columns may be selected) it is the hash of the file's path and the
    row's place in the file, so two scans give the same keys. Other frames are written first.
    """
    key = F.struct(
        F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("index")
    )
    try:
        return docs.select("*", key.alias(ROW))
    except AnalysisException:
        return write_table(docs, "rows").select("*", key.alias(ROW))


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the facts of their key, which may be held by a large part of all rows.

    ``facts`` is a written table with one row per key; its column ``n`` is the number of rows that have
    the key. Keys with more than a thousandth of the sum of ``n`` are fewer than a thousand: their facts
    are broadcast, and their rows stay where they are. Only rows of other keys are shuffled. ``rows`` is
    read twice.
    """
    share = (facts.agg(F.sum("n")).first()[0] or 0) / 1000
    heavy = F.broadcast(facts.where(F.col("n") > share).drop("n"))
    rare = facts.where(F.col("n") <= share).drop("n")
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(*keys), keys, "left_anti").join(rare, keys, how))
