"""Poisson replication: distribution, shares, repeatability."""

from math import exp, factorial

import pytest
from pyspark.sql import functions as F

from codesieve.llm import mixing as M

SCHEMA = "doc_id long, source string, text string, copy int, rate string"


def documents(spark, n=4000):
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "small").otherwise("large").alias("source"),
        F.lit("0123456789").alias("text"), F.lit(1).alias("copy"), F.lit("x").alias("rate"),
    )


def test_counts_follow_the_poisson_distribution(spark):
    rates = spark.createDataFrame([("small", 2.5), ("large", 0.4)], "source string, rate double")
    counted = M.with_copies(documents(spark, 20_000), rates).groupBy("source", M.COPIES).count().collect()
    for source, mean in (("small", 2.5), ("large", 0.4)):
        n = {r[M.COPIES]: r["count"] for r in counted if r["source"] == source}
        total = sum(n.values())
        for k in range(4):
            expected = exp(-mean) * mean**k / factorial(k)
            assert abs(n.get(k, 0) / total - expected) < 0.02, (source, k)


def test_large_means_are_sums(spark):
    rates = spark.createDataFrame([("small", 300.0)], "source string, rate double")
    row = M.with_copies(documents(spark).where("source = 'small'"), rates).agg(F.mean(M.COPIES), F.variance(M.COPIES)).first()
    assert row[0] == pytest.approx(300, rel=0.01) and row[1] == pytest.approx(300, rel=0.2)


def test_shares_reach_the_target_weights(spark):
    weights = spark.createDataFrame([("small", 3.0), ("large", 1.0), ("absent", 5.0)], "source string, weight double")
    mixed = M.mixed(documents(spark), weights, budget=2.0)
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert n["small"] == pytest.approx(6000, rel=0.05) and n["large"] == pytest.approx(2000, rel=0.08)


def test_same_rows_on_every_run_and_shuffled(spark):
    docs = documents(spark)
    first, second = (M.mixed(d).select("doc_id", "__copy", "__mix_key").collect() for d in (docs, docs.repartition(7)))
    assert sorted(first) == sorted(second) and [r["doc_id"] for r in first] != sorted(r["doc_id"] for r in first)
    assert len({r["__mix_key"] for r in first}) == len(first)


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(1, None, "a", 1, "x")] * 3 + [(None, None, "b", 1, "x"), (None, "s", None, 1, "x"), (2, "s", "", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    counted = M.with_copies(docs, M.source_rates(docs)).collect()
    assert len(counted) == 6 and len({r[M.COPIES] for r in counted if r["doc_id"] == 1}) == 1
    assert {r[M.COPIES] for r in counted if r["source"] == "s"} == {0}
    mixed = M.mixed(docs)
    assert mixed.columns == [*docs.columns, "__rate", "__copy", "__mix_key"]
    assert M.mixed(docs.limit(0)).count() == 0
    assert M.mixed(docs, spark.createDataFrame([], "source string, weight double")).count() == 0
