"""The join of rows with facts of keys, hot keys included."""

from pyspark.sql import functions as F

from codesieve.llm.common import join_counted, write_table


def counted(spark, rows):
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    return write_table(facts, "facts")


def test_join_counted_keeps_all_rows(spark):
    """One key has a third of all rows, many have one; the heavy part is broadcast and small."""
    rows = write_table(spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")), "rows")
    facts = counted(spark, rows)
    joined = join_counted(rows, facts, ["k"])
    assert joined.columns == ["k", "v", "least"]
    plain = rows.join(facts.drop("n"), "k")
    assert joined.exceptAll(plain).count() == plain.exceptAll(joined).count() == 0
    assert facts.where(F.col("n") > 9).count() == 1


def test_join_counted_left_and_empty(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (None, 4)], "k int, v int")
    facts = write_table(spark.createDataFrame([(1, 2, 7)], "k int, n long, fact int"), "facts")
    got = join_counted(rows, facts, ["k"], "left").collect()
    assert sorted((r["v"], r["fact"]) for r in got if r["fact"]) == [(1, 7), (2, 7)]
    assert sorted(r["v"] for r in got if r["fact"] is None) == [3, 4]
    assert join_counted(rows, facts, ["k"]).count() == 2
    assert join_counted(rows, facts.limit(0), ["k"]).count() == 0
    assert join_counted(rows, facts.limit(0), ["k"], "left").count() == 4
