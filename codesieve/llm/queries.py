"""The registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format, conversation_repair, decontamination, line_dedup, mixing, quality_classifier, quality_rules, sharding, simhash,
    token_files, tokenizer_alignment, toxicity, warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of line runs of 25 words or more."""
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by both views, and whether it is kept."""
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page to an archive and back."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, 3 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of all documents, counts at most one apart, equal texts together."""
    placed = sharding.assigned(table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, ledger bits and verdict of every document."""
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each rule of both policies rejects, and rejects alone."""
    return quality_rules.ablated(table(spark, sf_dir, "documents"))


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted and read back."""
    added = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_format.digests(chat_format.format_conversations(rows))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by the square root of their source's size, in shuffled order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs).withColumnsRenamed({"__copy": "copy", "__rate": "rate", "__mix_key": "mix_key"})


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark spans of ten words in every document."""
    return decontamination.matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def vocabulary(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to token files and read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), ("source", "lang"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return conversation_repair.digests(table(spark, sf_dir, "conversations"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two tokenizers in every document, with corpus-wide counts."""
    docs = table(spark, sf_dir, "documents")
    return tokenizer_alignment.aligned(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_format": op8_chat_format,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_token_files": op11_token_files,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "quality_ablations": quality_ablations,
}
ORACLE: dict[str, str] = {
    "op1_line_dedup": line_dedup.DEDUPLICATED_SQL,
    "op4_warc": warc.ROUND_TRIP_SQL,
    "op7_quality_rules": quality_rules.JUDGED_SQL,
    "op8_chat_format": chat_format.DIGEST_SQL,
    "op9_mixing": mixing.MIXED_SQL,
    "op10_decontamination": decontamination.MATCHED_SQL,
    "quality_ablations": quality_rules.ABLATED_SQL,
}
