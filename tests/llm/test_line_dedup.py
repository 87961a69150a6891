"""Removed line runs against a brute-force search for earlier copies."""

import random
import re

import pytest

from codesieve.llm import line_dedup as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, line int, rank string"


def brute(texts, least):
    """Lines covered by any run of ``least`` words that occurs at an earlier place."""
    docs = [t.split("\n") for t in texts]
    gone = [set() for _ in texts]
    first = {}
    for d, lines in enumerate(docs):
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                first.setdefault(tuple(lines[s:e]), (d, s))
    for d, lines in enumerate(docs):
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                run = lines[s:e]
                if sum(len(WORD.findall(x)) for x in run) >= least and first[tuple(run)] != (d, s):
                    gone[d].update(range(s, e))
    return [(len(x), len(g), "\n".join(y for n, y in enumerate(x) if n not in g)) for x, g in zip(docs, gone)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("least", [1, 4, 9])
def test_equals_brute_force(spark, least):
    rng = random.Random(least)
    lines = ["a b c", "d", "", "e f", "g h i j", " ", "k"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14))) for _ in range(25)]
    texts += ["\n".join(rng.choice(lines) + rng.choice(["", "", "x"]) for _ in range(rng.randint(1, 12))) for _ in range(15)]
    found = L.deduplicated(frame(spark, texts), least).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_removed"], r["text"]) for r in found] == brute(texts, least)


def test_long_runs_short_lines_and_overlaps(spark):
    block = "\n".join(f"w{i}" for i in range(70))
    texts = [block, "start\n" + block + "\nend", "z\n" * 200, block.replace("w35", "other")]
    found = L.deduplicated(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_removed"], r["text"]) for r in found] == brute(texts, 25)


def test_nulls_empty_texts_and_repeated_rows(spark):
    long = "one two three four " * 10
    rows = spark.createDataFrame([(1, None, 0, ""), (2, "", 0, ""), (3, long, 0, ""), (3, long, 0, ""), (None, long, 0, "")], SCHEMA)
    found = sorted((str(r["doc_id"]), r["n_lines"], r["n_removed"], r["text"]) for r in L.deduplicated(rows).collect() if r["text"] is not None)
    assert found == [("2", 1, 0, ""), ("3", 1, 1, ""), ("3", 1, 1, ""), ("None", 1, 0, long)]
    null = L.deduplicated(rows).where("doc_id = 1").first()
    assert (null["n_lines"], null["n_removed"], null["text"]) == (0, 0, None)
    assert L.deduplicated(rows.limit(0)).count() == 0


def test_repeated_passage_goes_and_clean_text_stays(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    clean = "\n".join(f"line {i} of its own" for i in range(30)) + "\nshort shared line"
    texts = [clean, clean.replace("own", "kind") + "\n" + passage, passage + "\nafter"]
    found = [r["text"] for r in L.deduplicated(frame(spark, texts)).orderBy("doc_id").collect()]
    assert found == [texts[0], texts[1], "after"]
