"""Alignment against plain Python over whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from codesieve.llm import tokenizer_alignment as A

SIDES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, run long, docs string, records binary"
ZERO = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "n_best": 0, "count_sum": 0, "groups_sha256": ""}


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(SIDES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=SIDES[1])
    letters = A.byte_letters()
    a_bytes = {i: A.letter_bytes(e, letters) for e, i in a.get_vocab().items()}
    b_bytes = [A.piece_bytes(b.id_to_piece(i)) for i in range(b.get_piece_size())]
    return a, b, a_bytes, b_bytes


def expected(texts, sides):
    """Numbers per text, from the definition: whole texts, sets of byte ends, all pairs."""
    a, b, a_bytes, b_bytes = sides
    rows, seen, holders = [], [], Counter()

    def ends(ids, sizes):
        out, at = [], 0
        for i in ids:
            at += len(sizes[i])
            out.append(at)
        return out

    for text in texts:
        rows.append(dict(ZERO))
        seen.append(Counter())
        if not text:
            continue
        x, y, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        if b"".join(a_bytes[i] for i in x) != raw or b"".join(b_bytes[i] for i in y) != raw:
            continue
        x_ends, y_ends = ends(x, a_bytes), ends(y, b_bytes)
        groups, last = [], 0
        for place in sorted(set(x_ends) & set(y_ends)):
            groups.append(([i for i, e in zip(x, x_ends) if last < e <= place], [i for i, e in zip(y, y_ends) if last < e <= place]))
            last = place
        links = Counter((p, q) for left, right in groups for p in left for q in right)
        shown = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in groups)
        rows[-1].update(n_a=len(x), n_b=len(y), n_groups=len(groups), n_links=sum(links.values()), groups_sha256=hashlib.sha256(shown.encode()).hexdigest())
        seen[-1] = links
        holders.update(links.keys())
    highest = defaultdict(int)
    for (p, _), n in holders.items():
        highest[p] = max(highest[p], n)
    for row, links in zip(rows, seen):
        row["n_best"] = sum(n for k, n in links.items() if holders[k] == highest[k[0]])
        row["count_sum"] = sum(n * holders[k] for k, n in links.items())
    return rows


TEXTS = [
    None, "", "the cat", "the the the cat sat", "don't <|endoftext|> stop", "a▁b the", "double  blanks  here ", " leading", "é è ü the",
    "日本語 と the cat", "tab\tnew\nline", "Unbelievable antidisestablishmentarianism 1234567", "<s> </s> <0x41>", "🙂🙂 emoji the cat", "\x00 zero",
]


def run(spark, rows):
    frame = spark.createDataFrame([(i, t, 1, "clash", b"x") for i, t in rows], SCHEMA)
    return sorted((r.asDict() for r in A.aligned(frame, *SIDES).collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["n_a"]))


def check(spark, sides, texts):
    found = run(spark, list(enumerate(texts)))
    for row, want in zip(found, expected(texts, sides), strict=True):
        assert row == {"doc_id": row["doc_id"], **want}


def test_against_whole_texts(spark, sides):
    check(spark, sides, TEXTS * 3)


def test_many_runs_and_merge_levels(spark, sides, monkeypatch):
    monkeypatch.setattr(A, "RUN_BYTES", 40)
    monkeypatch.setattr(A, "FAN_IN", 4)
    monkeypatch.setattr(A, "RADICES", 3)
    texts = [f"the {w} cat{n}" for n in range(7) for w in ("quick", "lazy")] + ["the"] * 10
    check(spark, sides, texts)


def test_repeated_rows_null_ids_long_text_and_empty_table(spark, sides):
    texts = ["same text", "same text", "same text", "x " * 100_000 + "日本" * 3000]
    want = expected(texts, sides)
    found = run(spark, [(None, texts[0]), (None, texts[1]), (5, texts[2]), (6, texts[3])])
    assert [{k: v for k, v in r.items() if k != "doc_id"} for r in found] == want
    assert run(spark, []) == []


def test_large_groups_count_equal_pairs():
    a, b = np.array([1, 1, 2] * 40), np.array([7, 8] * 30)
    group, keys, links = A._linked(a, b, np.zeros(120, np.int64), np.zeros(60, np.int64), 1)
    found = {(int(k) >> A.SIDE, int(k) & (1 << A.SIDE) - 1): int(n) for k, n in zip(keys, links)}
    assert found == {(1, 7): 80 * 30, (1, 8): 80 * 30, (2, 7): 40 * 30, (2, 8): 40 * 30} and not group.any()
