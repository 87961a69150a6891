"""Corpora from files and from text tables, as files(file_id, path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .listing import list_files, read_files

# Extensions of C and C++ sources, any case.
SOURCE_EXTENSIONS = ("c", "cpp", "cc", "cxx", "h", "hpp")
REPLACEMENT = "�"


def is_source_path(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(SOURCE_EXTENSIONS) + ")$")


def clean_text(raw: Column) -> Column:
    """Bytes or text as UTF-8 with invalid bytes dropped and newlines as ``\\n``."""
    valid = F.replace(F.make_valid_utf8(raw.cast("string")), F.lit(REPLACEMENT), F.lit(""))
    return F.regexp_replace(valid, "\r\n?", "\n")


def read_source_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Source files below ``path``, empty ones too; other files are left out by their extension, unread.

    For repeated scans of many small files write the result to parquet once and use ``text_corpus`` on it.
    """
    listed = list_files(spark, path, recursive).where(is_source_path(F.col("path")))
    return read_files(listed, path).select(
        F.col("path").alias("file_id"), "path", clean_text(F.col("content")).alias("content")
    )


def text_corpus(table: DataFrame, id_column: str, text_column: str, path: Column | None = None) -> DataFrame:
    """Any table with an id and a text column as a corpus; only these columns are read."""
    key = F.col(id_column)
    return table.select(
        key.alias("file_id"),
        (key.cast("string") if path is None else path).alias("path"),
        F.col(text_column).alias("content"),
    )


def spread(texts: DataFrame, partitions: int | None = None, always: bool = False) -> DataFrame:
    """Texts dealt by ``file_id`` over a fixed number of tasks, by default the shuffle partitions.

    For corpora in few files or row groups: scanning costs far more than moving the text once. Where the
    scan has as many splits as the cluster has cores, no text is moved, unless ``always`` is set.
    """
    spark = texts.sparkSession
    if not always and texts.rdd.getNumPartitions() >= (partitions or spark.sparkContext.defaultParallelism):
        return texts
    return texts.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), "file_id")


def source_rows(files: DataFrame) -> DataFrame:
    """Only the rows whose path names a C or C++ source."""
    return files.where(is_source_path(F.col("path")))


def split_counts(files: DataFrame) -> DataFrame:
    """How many rows are sources and how many are skipped."""
    return files.agg(
        F.count_if(is_source_path(F.col("path"))).alias("accepted"),
        F.count_if(~is_source_path(F.col("path"))).alias("skipped"),
    )


def to_lines(files: DataFrame) -> DataFrame:
    """files to lines(file_id, line_no, line), split at ``\\n`` only, empty tail kept."""
    return files.select(
        "file_id", F.posexplode(F.split("content", "\n", -1)).alias("at", "line")
    ).select("file_id", (F.col("at") + 1).alias("line_no"), "line")
