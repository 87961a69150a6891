import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codesieve.operators import model_text as MT
from codesieve.operators.segment import chunk_files
from codesieve.plans.corpus_scan import scan_corpus


def parsed(spark, *texts, start=10):
    rows = [(n, start, t) for n, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "file_id int, start_line int, text string")
    found = MT.parse_model_text(frame).orderBy("file_id", "seq")
    return [tuple(r) for r in found.select("line", "severity", "type", "description", "source").collect()]


def test_main_format(spark):
    text = "noise\nline 3:  [Critical] Stack  Smash -  gets() used\nLine 4: [odd] A/B - x - y"
    assert parsed(spark, text) == [
        (13, "CRITICAL", "Stack  Smash", "gets() used", "llm"),
        (14, "MEDIUM", "A/B", "x - y", "llm"),
    ]


def test_fallback_formats_only_without_main(spark):
    assert parsed(spark, "5: high : use after free of p\nLine 7: shell injection") == [
        (15, "HIGH", "Use After Free", "use after free of p", "llm_alt"),
        (17, "MEDIUM", "Command Injection", "shell injection", "llm_alt"),
    ]
    both = "Line 1: [LOW] T - d\n5: high : ignored"
    assert [p[0] for p in parsed(spark, both)] == [11]


def test_nothing_found(spark):
    assert parsed(spark, "", "No obvious vulnerabilities detected.", None) == []


def test_line_numbers_too_large_are_null_not_errors(spark):
    assert parsed(spark, "Line 99999999999: [LOW] T - d")[0][0] is None


def test_dot_stops_only_at_newlines(spark):
    assert parsed(spark, "Line 1: [LOW] T - a\x85b c")[0][3] == "a\x85b c"


def test_prompt_names_the_file(files):
    prompts = MT.with_prompt(files("int a;"), path=F.col("path")).first().prompt
    assert "code from file 'src/0.c' and identify" in prompts and "```c\nint a;\n```" in prompts
    assert "code and identify" in MT.with_prompt(files("int a;")).first().prompt


def test_annotate_survives_failing_predictors(files):
    def predict(prompts: pd.Series) -> pd.Series:
        if prompts.str.contains("boom").any():
            raise RuntimeError("model failed")
        return pd.Series(["Line 2: [HIGH] Kind - text"] * len(prompts))

    chunks = chunk_files(files("int boom;", "\n\nint fine;"))
    answers = MT.annotate(MT.with_prompt(chunks), predict)
    found = MT.parse_model_text(answers).collect()
    assert [(r.file_id, r.line) for r in found] == [(1, 5)]


def test_blank_types_and_dashes_on_later_lines(spark):
    assert parsed(spark, "Line 1: [HIGH]   - told")[0][1:4] == ("HIGH", "", "told")
    assert parsed(spark, "Line 1: [HIGH] one\nLine 2: [LOW] two - three") == [
        (11, "HIGH", "one\nLine 2: [LOW] two", "three", "llm")
    ]
    assert parsed(spark, "Line 1: [LOW] kind -\n told")[0][2:4] == ("kind", "told")
    assert [r[4] for r in parsed(spark, "Line 1: [HIGH] kind -")] == ["llm_alt"]


@pytest.mark.parametrize("text", ["Line 1: [HIGH] foo\n" * 200_000, "Line 1: [HIGH] " * 60_000, "Line 1: [HIGH] a - b " * 40_000])
def test_long_answers_take_linear_time(spark, text):
    frame = spark.createDataFrame([(1, 1, text)], "file_id int, start_line int, text string")
    start = time.perf_counter()
    MT.parse_model_text(frame).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - start < 20


def test_a_loader_runs_once_per_worker_and_batches_are_bounded(files, fresh_dir):
    def load():
        with open(f"{fresh_dir}/loads", "a") as out:
            out.write(f"{os.getpid()}\n")

        def predict(prompts):
            with open(f"{fresh_dir}/sizes", "a") as out:
                out.write(f"{prompts.map(len).sum()} {len(prompts)}\n")
            return prompts.map(lambda p: "Line 0: [HIGH] Kind - text")

        return predict

    corpus = files(*[f"int v{n};" * 50 for n in range(40)]).repartition(6)
    prompts = MT.with_prompt(chunk_files(corpus))
    assert MT.annotate(prompts, load=load, batch_bytes=4000).where("text IS NOT NULL").count() == 40
    loads = open(f"{fresh_dir}/loads").read().split()
    assert len(loads) == len(set(loads))
    sizes = [tuple(map(int, line.split())) for line in open(f"{fresh_dir}/sizes")]
    assert all(size <= 4000 or n == 1 for size, n in sizes) and max(n for _, n in sizes) > 1
    assert scan_corpus(corpus, load=load).findings.where("source = 'llm' AND rule_id IS NULL").count() == 40


def test_failing_batches_are_halved():
    calls = []

    def model(prompts):
        calls.append(len(prompts))
        if (prompts == "bad").any():
            raise ValueError
        return prompts

    assert MT._answers_of(model, ["x"] * 31 + ["bad"]) == ["x"] * 31 + [None]
    assert len(calls) <= 11
