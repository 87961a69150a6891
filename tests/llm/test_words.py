"""The vectorised tokenizer against regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from codesieve.llm import words as W

WORD = {id(W.ALNUM): re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), id(W.SPACED): re.compile(rb"[^\x00\x20\x09-\x0D]+")}


@pytest.fixture(params=[7, 64, 1 << 20])
def block(request, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", request.param)
    monkeypatch.setattr(W, "_powers", {})


@pytest.mark.parametrize("table", [W.ALNUM, W.SPACED], ids=["alnum", "spaced"])
def test_words_equal_regex(block, table):
    rng = random.Random(1)
    fold = (lambda x: x.lower()) if table is W.ALNUM else (lambda x: x)
    for _ in range(80):
        texts = [
            rng.choice([None, "", "".join(rng.choice("ab É. \n9Z") for _ in range(rng.randint(0, 300))), "x" * rng.randint(0, 400)])
            for _ in range(rng.randint(0, 9))
        ]
        found = W.words_of(pa.array(texts, pa.string()), table)
        expected = [(i, x) for i, t in enumerate(texts) if t for x in WORD[id(table)].findall(fold(t.encode()))]
        got = [(int(i), fold(bytes(found.data[s:e]))) for i, s, e in zip(found.text, found.start, found.end)]
        assert got == expected
        known = {}
        for (_, word), value in zip(expected, found.hash, strict=True):
            assert known.setdefault(word, value) == value
        assert len(set(known.values())) == len(known)


def test_slices_cover_the_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (0, 5, 50, 3, 3)])], names=["t"])
    parts = list(W.slices(batch, 0, 8))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert [len(p) for p in parts] == [2, 1, 2]
    assert not list(W.slices(batch.slice(0, 0), 0))


def test_first_of_text_counts_every_text():
    found = W.words_of(pa.array(["a b", None, "", "c"]))
    assert np.array_equal(found.first_of_text(), [0, 2, 2, 2, 3])
