import os

import pytest

from codesieve.operators.post import finish_findings
from codesieve.operators.scan import line_findings, raw_findings
from codesieve.sources.tables import to_lines
from codesieve.streaming.line_stream import scan_each_batch, stream_line_findings, stream_raw_findings

TEXTS = ["gets(a);\nmd5(b);\n", "void f(int a) {\n  p = malloc(8);\n  p->x = 1;\n}", "int a;"]


@pytest.fixture
def source(files, spark, fresh_dir):
    path = f"{fresh_dir}/in"
    files(*TEXTS).repartition(3).write.parquet(path)
    batch = spark.read.parquet(path)
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, fresh_dir):
    query = (
        stream.writeStream.format("memory").queryName(name)
        .option("checkpointLocation", os.path.join(fresh_dir, "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return sorted(map(str, stream.sparkSession.table(name).collect()))


def test_line_rules_on_a_stream_equal_the_batch(source, fresh_dir):
    batch, stream = source
    rules = {"M1", "H1", "X3", "M8"}
    expected = sorted(map(str, line_findings(to_lines(batch), rules).collect()))
    assert expected and run(stream_line_findings(stream, rules), "line_rules", fresh_dir) == expected


def test_whole_files_on_a_stream_equal_the_batch(source, fresh_dir):
    batch, stream = source
    expected = sorted(map(str, raw_findings(batch).collect()))
    assert run(stream_raw_findings(stream), "whole_files", fresh_dir) == expected


def test_each_batch_is_finished(source, fresh_dir):
    batch, stream = source
    query = (
        scan_each_batch(stream, lambda found, n: found.write.parquet(f"{fresh_dir}/out/batch={n}"))
        .option("checkpointLocation", f"{fresh_dir}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    written = batch.sparkSession.read.parquet(f"{fresh_dir}/out").drop("batch")
    expected = finish_findings(raw_findings(batch))
    assert sorted(map(str, written.collect())) == sorted(map(str, expected.collect()))
