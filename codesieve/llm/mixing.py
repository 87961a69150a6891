"""Mixing sources to target weights by Poisson replication.

The rate of a source is the mean number of copies of its documents that gives the source its share of
the budget. Each document's number of copies is the inverse of the Poisson distribution with that
mean at a uniform number hashed from seed and document, so it is the same on every run. Means over 16
are drawn as sums of equal smaller ones. The copies are then shuffled globally: rows go to the
partition of a hashed key and are sorted by it.

Sizes are bytes of UTF-8 over all documents. Null and empty texts have no bytes but are replicated at
their source's rate; a source without bytes, or without a weight, has rate zero. Null sources are one
source. Repeated rows share their number of copies; documents without an id are hashed by their text.
Extra columns are kept. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_table

MOST_MEAN = 16
# P(X > 79) is below 1e-30 for a mean of 16.
TERMS = 80
SEED = 17
SOURCE, RATE, COPIES, DISTRIBUTION = "__source", "__rate", "__copies", "__distribution"


def _size() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")


def source_rates(docs: DataFrame, weights: DataFrame | None = None, budget: float = 1.0, power: float = 0.5) -> DataFrame:
    """(source, size, weight, rate) for every source.

    ``weights`` holds (source, weight); without it the weight is the source's size to ``power``.
    ``budget`` is the size of the mixture as a multiple of the corpus.
    """
    sizes = docs.groupBy("source").agg(F.sum(_size()).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        given = weights.groupBy(F.col("source").alias("of")).agg(F.max("weight").cast("double").alias("weight"))
        weighed = sizes.join(given, sizes["source"].eqNullSafe(given["of"]), "left").drop("of")
    usable = F.when(F.col("size") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(F.lit(0.0))
    weighed = write_table(weighed.withColumn("weight", usable), "source-weights")
    size, weight = weighed.agg(F.sum("size").cast("double"), F.sum("weight")).first()
    scale = budget * (size or 0.0) / weight if weight else 0.0
    rate = F.when(F.col("size") > 0, F.lit(scale) * F.col("weight") / F.col("size")).otherwise(F.lit(0.0))
    return weighed.withColumn("rate", rate)


def _distribution(mean: Column) -> Column:
    """P(X <= k) for k from 0 on."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("sums"))

    def add(at: Column, k: Column) -> Column:
        p = at["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(at["sums"], F.array(F.element_at(at["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, add)["sums"]


def _uniform(name: Column, draw: Column, seed: int) -> Column:
    """52 bits of a hash as a number in [0, 1)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), name, draw.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds the number of copies of each document, ``__copies``, and its source's ``__rate``."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("int")
    table = write_table(
        rates.select(
            F.col("source").alias(SOURCE), F.col("rate").alias(RATE), draws.alias("__draws"),
            _distribution(F.col("rate") / draws).alias(DISTRIBUTION),
        ),
        "source-rates",
    )
    joined = docs.join(table, docs["source"].eqNullSafe(table[SOURCE]), "left")
    # Each draw's number is an element of its own, so it is hashed once and not once per sum.
    numbers = F.transform(F.sequence(F.lit(0), F.col("__draws") - 1), lambda d: _uniform(_name(), d, seed))
    drawn = F.transform(numbers, lambda u: F.size(F.filter(DISTRIBUTION, lambda sums: sums <= u)))
    total = F.aggregate(drawn, F.lit(0), lambda n, x: n + x)
    return joined.withColumn(COPIES, F.coalesce(total, F.lit(0))).drop(SOURCE, "__draws", DISTRIBUTION)


def _name() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def mixed(docs: DataFrame, weights: DataFrame | None = None, budget: float = 1.0, power: float = 0.5, seed: int = SEED) -> DataFrame:
    """All copies in shuffled order, with ``__copy`` (from 0), ``__rate`` and ``__mix_key``."""
    counted = with_copies(docs, source_rates(docs, weights, budget, power), seed)
    copies = counted.where(F.col(COPIES) > 0).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col(COPIES) - 1))).drop(COPIES)
    key = F.substring(F.md5(F.concat_ws("|", F.lit(f"order {seed}"), _name(), F.col("__copy").cast("string"))), 1, 16)
    return copies.withColumn("__mix_key", key).repartition("__mix_key").sortWithinPartitions("__mix_key")


MIXED_SQL = r"""
WITH s AS (
  SELECT source, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS size FROM documents GROUP BY source
), w AS (SELECT source, size, sqrt(size::DOUBLE) AS weight FROM s),
r AS (
  SELECT source, CASE WHEN size > 0 THEN (SELECT sum(size)::DOUBLE / sum(weight) FROM w) * weight / size ELSE 0 END AS rate FROM w
), m AS (SELECT *, greatest(1, ceil(rate / 16))::INTEGER AS draws FROM r),
p AS (
  SELECT source, rate, draws, k,
         sum(exp(k * ln(rate / draws) - rate / draws - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
  FROM m, (SELECT unnest(range(0, 80)) AS k) WHERE rate > 0
), u AS (
  SELECT d.doc_id, d.source, m.rate,
         ('0x' || substr(md5('17|' || doc_id || '|' || draw), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN m USING (source), LATERAL (SELECT unnest(range(0, m.draws)) AS draw)
), c AS (
  SELECT u.doc_id, any_value(u.rate) AS rate, count(*) FILTER (p.upto <= u.u) AS copies FROM u JOIN p USING (source) GROUP BY u.doc_id
)
SELECT d.doc_id, d.source, d.text, copy::INTEGER AS copy, c.rate,
       substr(md5('order 17|' || d.doc_id || '|' || copy), 1, 16) AS mix_key
FROM documents d JOIN c USING (doc_id), LATERAL (SELECT unnest(range(0, c.copies)) AS copy)
"""
