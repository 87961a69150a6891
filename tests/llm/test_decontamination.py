"""Winnowed matching against brute force."""

import hashlib
import random
import re

from codesieve.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    doc, hit, ids = words(text), set(), set()
    for item, content in items:
        w = words(content)
        width = min(10, len(w))
        grams = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if width else set()
        for i in range(len(doc) - width + 1) if width else ():
            if tuple(doc[i : i + width]) in grams:
                hit.update(range(i, i + width))
                if item is not None:
                    ids.add(str(item))
    return len(doc), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def check(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, fp string, n_hit int")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, ctx string")
    found = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in D.matched(docs, bench).collect()}
    assert found == {i: brute(t, items) for i, t in enumerate(texts)}
    return found


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["a", "B", "cé", "d1", "Z"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, text(rng.choice([10, 11, 15, 30]))) for i in range(25)] + [(90, items_text := text(40)), (10, items_text)]
    texts = [text(rng.randint(0, 120)) for _ in range(30)]
    texts += [f"x y {items[k][1]} z" for k in range(10)] + [items[3][1].upper(), " ".join(items_text.split()[5:15]), " ".join(items_text.split()[5:14])]
    assert any(f[1] for f in check(spark, texts, items).values())


def test_short_items_are_whole_windows(spark):
    items = [(1, "alpha"), (2, "beta gamma"), (3, "p q r s t u v w x"), (4, "..."), (5, None), (None, "lone item"), (2, "beta gamma")]
    texts = ["alpha beta gamma", "beta, GAMMA! alpha", "gamma beta", "p q r s t u v w x y", "p q r s t u v w", "a lone item", None, "", "." * 5000]
    check(spark, texts, items)


def test_repeated_words_and_long_texts(spark):
    items = [(1, "same " * 12), (2, "k " * 10), (3, " ".join(f"u{i}" for i in range(300)))]
    texts = ["same " * 5000, "k " * 9, "k " * 11, "n " * 100_000 + " ".join(f"u{i}" for i in range(100, 130))]
    check(spark, texts, items)


def test_no_items_no_documents_and_cleaning(spark):
    check(spark, ["a b c"], [])
    check(spark, [], [(1, "a b c")])
    docs = spark.createDataFrame([(1, "one two three", "c"), (1, "one two three", "c"), (2, "three two one", "c")], "doc_id long, text string, extra string")
    bench = spark.createDataFrame([(7, "two three")], "item_id long, text string")
    assert [tuple(r) for r in D.clean_documents(docs, bench).collect()] == [(2, "three two one", "c")]
