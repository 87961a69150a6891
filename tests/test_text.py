from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from codesieve.functions.text import MARK, match_spans, running_max, running_sum


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 200, 5000])
def test_prefix_scans(spark, size):
    values = [(i * 7919) % 23 for i in range(size)]
    frame = spark.createDataFrame([(values,)], "v array<int>")
    row = frame.select(F.expr(running_sum("v")).alias("s"), F.expr(running_max("v")).alias("m")).first()
    assert row.s == list(accumulate(values))
    assert row.m == list(accumulate(values, max))


@pytest.mark.parametrize("mark", ["", MARK])
def test_match_spans_count_lines(spark, mark):
    text = f"a{mark}\nfree(x\n)\n\nfree(y) free(z)"
    frame = spark.createDataFrame([(text,)], "t string")
    spans = frame.select(F.expr(match_spans("t", r"free\([^)]+\)")).alias("s")).first().s
    assert [(s.text, s.first, s.last) for s in spans] == [("free(x\n)", 1, 2), ("free(y)", 4, 4), ("free(z)", 4, 4)]


def test_no_match_gives_no_spans(spark):
    frame = spark.createDataFrame([("",), ("plain",)], "t string")
    assert [r.s for r in frame.select(F.expr(match_spans("t", "x+")).alias("s")).collect()] == [[], []]
