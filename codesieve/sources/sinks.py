"""Writers for findings and reports, and the reader of written reports; all work in the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def write_findings(findings: DataFrame, path: str) -> None:
    """Flat findings as parquet."""
    findings.write.mode("errorifexists").parquet(path)


def _bucket(file_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(file_id.cast("string")), F.lit(buckets)).cast("int")


def write_reports(reports: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """JSON or plain-text documents of reports(file_id, report): one line of JSON per document, with its key.

    Documents lie in folders by a hash of the key, so that one of them is found without reading all. The
    number of buckets is in the folders' names. File ids are written as text.
    """
    key = F.col("file_id").cast("string").alias("file_id")
    lines = reports.select(
        F.to_json(F.struct(key, "report")).alias("value"), F.lit(buckets).alias("buckets"), _bucket(F.col("file_id"), buckets).alias("bucket")
    )
    lines.repartition("buckets", "bucket").write.mode("errorifexists").partitionBy("buckets", "bucket").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All written reports(file_id string, report)."""
    lines = spark.read.schema("value string, buckets int, bucket int").text(path)
    return lines.select(F.from_json("value", "file_id string, report string").alias("r"), "buckets", "bucket").select(
        "r.*", "buckets", "bucket"
    )


def read_report(spark: SparkSession, path: str, file_id) -> str | None:
    """The report of one file, read from its bucket only; None if there is none."""
    reports = read_reports(spark, path)
    key = F.lit(str(file_id))
    number = spark.read.schema("value string, buckets int, bucket int").text(path).select("buckets").first()
    if number is None:
        return None
    bucket = spark.range(1).select(_bucket(key, number.buckets)).first()[0]
    row = reports.where((F.col("bucket") == bucket) & (F.col("file_id") == key)).select("report").first()
    return None if row is None else row.report
