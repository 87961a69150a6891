"""Token ids of a corpus in Parquet files from which single columns, rows or spans can be read.

The files of ``tokens`` hold one row per document in ascending id order: ``doc_id``, ``part`` (the file's
place among the files), ``at`` (ids before it in the file), ``n_tokens``, the list column ``ids`` and the
struct ``meta`` of further columns. ``ids`` and the strings are dictionary encoded; a vocabulary fits a
dictionary page, so an id takes as many bits as the vocabulary asks for. The ascending numbers are delta
encoded. Row groups and pages have set sizes, and every file has column and offset indexes, so a filter on
``doc_id`` or ``part`` reads few pages and a projection reads no ids. ``index`` has one row per file: its
ids and documents, and ``first``, the place of its first id in the corpus.

Null texts are empty; every document ends with the end id, so an empty one has one id. Rows without an id
come first; rows with equal ids, repeated rows too, follow each other by their place in the input. Extra
columns are ignored unless named as ``meta``, where they cannot clash. An empty table gives empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ROW, new_path, with_row_key
from .pieces import byte_encoder, cut, flat_take, sums_of
from .words import slices

END_ID = 2
BLOCK_OF_PARTS = 1000


def _encoder(tokenizer_path: str, end_id: int, schema: pa.Schema):
    """Arrow batches of (doc_id, text, meta) in order to rows of a token file."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = byte_encoder(tokenizer_path, False), TaskContext.get().partitionId(), 0
        for batch in (piece for whole in batches for piece in slices(whole, 1)):
            pieces = cut(batch.column(1).cast(pa.large_binary()), at_marks=True)
            flat, per_piece = encoder.tokens(pieces.different)
            body = flat_take(flat, np.cumsum(per_piece), pieces.code)
            counts = sums_of(per_piece[pieces.code], pieces.per_text)
            ended = np.insert(body, np.cumsum(counts), end_id).astype(np.int32)
            ends = np.cumsum(counts + 1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ended))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(batch), part, np.int32)), pa.array(at + ends - counts - 1),
                 pa.array(counts + 1), lists.cast(schema.field("ids").type), batch.column(2)],
                schema=schema,
            )
            at += int(ends[-1])

    return encode


def _with_first(parts: DataFrame) -> DataFrame:
    """Adds ``first``, the ids in all parts before; a running sum in two steps, so no task sees all parts."""
    blocked = parts.withColumn("block", F.floor(F.col("part") / BLOCK_OF_PARTS))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("block").agg(F.sum("n_tokens").alias("block_tokens")).select(
        F.col("block").alias("of_block"),
        F.coalesce(F.sum("block_tokens").over(before(Window.orderBy("block"))), F.lit(0)).alias("before_block"),
    )
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("block").orderBy("part"))), F.lit(0))
    joined = blocked.withColumn("inside", inside).join(blocks, F.col("block") == F.col("of_block"))
    return joined.withColumn("first", (F.col("before_block") + F.col("inside")).cast("long")).select(*parts.columns, "first")


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, meta: tuple[str, ...] = (), end_id: int = END_ID,
    row_group_bytes: int = 32 << 20, page_rows: int = 2000, page_bytes: int = 256 << 10,
) -> None:
    """Encode ``text`` of all documents and write ``tokens`` and ``index`` below ``folder``.

    Texts are moved once, to their place in id order, and encoded there.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = F.struct(*[F.col(c) for c in meta]) if meta else F.struct(F.lit(None).cast("string").alias("none"))
    rows = with_row_key(docs).select("doc_id", text.alias("text"), kept.alias("meta"), ROW)
    keys = ["doc_id", f"{ROW}.file", f"{ROW}.index"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(ROW)
    schema = T.StructType([
        ordered.schema["doc_id"], T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        ordered.schema["meta"],
    ])
    encoded = ordered.mapInArrow(_encoder(tokenizer_path, end_id, to_arrow_schema(schema)), schema)
    writer = encoded.write.options(**{
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows),
        "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20),
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "at", "n_tokens")},
    })
    writer.parquet(f"{folder}/tokens")
    parts = spark.read.parquet(f"{folder}/tokens").groupBy("part").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"),
        F.min("doc_id").alias("least_id"), F.max("doc_id").alias("greatest_id"),
    )
    _with_first(parts).write.parquet(f"{folder}/index")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The rows as written; a filter or projection of it reads what it needs only."""
    return spark.read.parquet(f"{folder}/tokens")


def read_places(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """Metadata of every document with ``start``, its place in the corpus; no ids are read.

    ``rows`` may be any narrow rows that kept ``part`` and ``at``.
    """
    narrow = read_tokens(spark, folder).drop("ids") if rows is None else rows
    first = spark.read.parquet(f"{folder}/index").select(F.col("part").alias("of_part"), "first")
    placed = narrow.join(first, F.col("part") == F.col("of_part"))
    return placed.withColumn("start", F.col("first") + F.col("at")).drop("of_part", "first", "part", "at")


def read_span(spark: SparkSession, folder: str, start: int, end: int) -> DataFrame:
    """(doc_id, start, ids) of the corpus places from ``start`` to before ``end``, cut at both ends.

    The files and rows that hold the span are found in the index, and only their pages are read.
    """
    index = spark.read.parquet(f"{folder}/index").where((F.col("first") < end) & (F.col("first") + F.col("n_tokens") > start))
    least, greatest = index.agg(F.min("part"), F.max("part")).first()
    rows = read_tokens(spark, folder).where(F.col("part").between(-1 if least is None else least, -1 if greatest is None else greatest))
    first = index.select(F.col("part").alias("of_part"), "first")
    placed = rows.join(first, F.col("part") == F.col("of_part")).withColumn("start", F.col("first") + F.col("at"))
    inside = placed.where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > start))
    skipped = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    upto = F.least(F.col("n_tokens"), F.lit(end) - F.col("start"))
    return inside.select(
        "doc_id", (F.col("start") + skipped).alias("start"),
        F.slice("ids", (skipped + 1).cast("int"), (upto - skipped).cast("int")).alias("ids"),
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, at, n_tokens, ids) to the same with the checksum and number of the ids that were read."""
    for batch in batches:
        ids = batch.column(4)
        ends = ids.offsets.to_numpy()
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4"))
        sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
            names=["doc_id", "part", "at", "n_tokens", "ids_crc32"],
        )


def round_trip(docs: DataFrame, tokenizer_path: str, meta: tuple[str, ...] = ()) -> DataFrame:
    """Write all documents, read all ids back: doc_id, start, n_tokens, ids_crc32 of each."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")
    write_tokens(docs, folder, tokenizer_path, meta)
    read = read_tokens(spark, folder).select("doc_id", "part", "at", "n_tokens", "ids")
    schema = T.StructType([*read.schema.fields[:4], T.StructField("ids_crc32", T.LongType())])
    return read_places(spark, folder, read.mapInArrow(_checksums, schema)).select("doc_id", "start", "n_tokens", "ids_crc32")
