"""Quality and toxicity on documents whose classes are known, and on odd tables."""

import random

import numpy as np
import pytest

from codesieve.llm import quality_classifier as Q
from codesieve.llm import toxicity as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, severity string"
VOCABULARY = [f"w{i}" for i in range(300)]


def documents(spark, texts):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t), "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    texts, quality, toxic = [], {}, {}
    for i in range(600):
        text = sentence(rng, rng.randint(20, 120))
        quality[i], toxic[i] = int(i % 6 != 0), int(i % 5 == 0)
        if not quality[i]:
            text = text.replace(" ", rng.choice(["!! ", "*** "]))
        if toxic[i]:
            for _ in range(1 + i % 8):
                text += rng.choice([" vile", " scumbag", " awful"]) + " " + rng.choice(VOCABULARY)
        texts.append((i, text))
    return texts, quality, toxic


def labels(spark, quality, toxic, ids):
    return spark.createDataFrame([(i, quality[i], toxic[i]) for i in ids], "doc_id long, quality int, toxic int")


def test_quality_of_unlabelled_documents(spark, corpus):
    texts, quality, toxic = corpus
    found = Q.scored(documents(spark, texts), labels(spark, quality, toxic, range(300))).collect()
    rest = [(r["kept"], bool(quality[r["doc_id"]])) for r in found if r["doc_id"] >= 300]
    assert np.mean([a == b for a, b in rest]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_rounds_teach_words_that_no_label_has(spark, corpus):
    """Documents without labels move the models: counts come from the whole table."""
    texts, quality, toxic = corpus
    few = labels(spark, quality, toxic, range(120))
    models = [Q.co_trained(Q.typed(documents(spark, texts)), few, rounds=r, sure_good=0.9, sure_bad=0.2) for r in (0, 1)]
    assert np.abs(models[1].text - models[0].text).max() > 0.1
    assert np.abs(models[1].meta - models[0].meta).max() > 0.01


def test_quality_of_odd_rows(spark, corpus):
    texts, quality, toxic = corpus
    odd = [(None, None), (5000, ""), (5001, "word " * 100_000), (5002, "\x00 \x01"), (1, "again"), (1, "again")]
    docs = documents(spark, texts + odd)
    contradicting = labels(spark, quality, toxic, range(300)).union(spark.createDataFrame([(2, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"))
    assert Q.scored(docs, contradicting).count() == 606
    good = Q.good_documents(docs, contradicting)
    assert good.columns == docs.columns and 400 < good.count() < 606
    none = labels(spark, quality, toxic, []).limit(0)
    assert {r["score"] for r in Q.scored(docs, none).collect()} == {0.5}
    assert Q.scored(docs.limit(0), contradicting).count() == 0


def test_platt_is_monotone_and_finite():
    slope, offset = Q.platt(np.array([-3.0, -2, 2, 3]), np.array([0, 0, 1, 1]))
    assert slope > 0 and np.isfinite(offset)
    assert Q.platt(np.array([1.0, 2]), np.array([1, 1]))[0] == 0


def test_cut_has_the_best_f1():
    rng = np.random.default_rng(5)
    for _ in range(50):
        total, toxic = rng.integers(0, 12, 40) / 4, rng.integers(0, 2, 40)
        f1 = lambda cut: 2 * (toxic[total >= cut]).sum() / ((total >= cut).sum() + toxic.sum())
        assert f1(T.best_cut(total, toxic)) == max(f1(c) for c in np.arange(0.125, max(total), 0.25))
    assert T.best_cut(np.array([0.0, 1.0, 3.0]), np.array([0, 0, 1])) == 2.0
    assert T.best_cut(np.zeros(3), np.array([0, 1, 1])) is None
    assert T.best_cut(np.arange(3.0), np.zeros(3, int)) is None
    assert T.best_cut(np.zeros(0), np.zeros(0, int)) is None


def test_toxic_documents_are_found(spark, corpus):
    texts, quality, toxic = corpus
    found = T.scored(documents(spark, texts), labels(spark, quality, toxic, range(300))).collect()
    rest = [(r["toxic"], bool(toxic[r["doc_id"]])) for r in found if r["doc_id"] >= 300]
    assert np.mean([a == b for a, b in rest]) > 0.98
    by_words = {k: np.mean([r["severity"] for r in found if toxic[r["doc_id"]] and r["doc_id"] % 8 == k]) for k in (0, 7)}
    assert by_words[7] > by_words[0] + 0.5


def test_severity_of_odd_rows(spark, corpus):
    texts, quality, toxic = corpus
    docs = documents(spark, texts + [(None, None), (5000, ""), (5001, "vile " * 50_000), (1, "again"), (1, "again")])
    known = labels(spark, quality, toxic, range(300))
    rows = T.scored(docs, known).collect()
    assert len(rows) == 605 and next(r for r in rows if r["doc_id"] == 5001)["grade"] == 3
    assert {r["severity"] for r in T.scored(docs, known.limit(0)).collect()} == {0.0}
    assert T.scored(docs.limit(0), known).count() == 0


def test_ordinal_fit_shares_weights_and_orders_thresholds():
    rng = np.random.default_rng(3)
    n = 4000
    value = rng.random(n) * 4
    total = 1.5 * value + rng.logistic(size=n)
    grade = (total > 1).astype(int) + (total > 3) + (total > 5)
    weights, thresholds = T.fit_ordinal(np.arange(n), np.zeros(n, int), value, grade, 1, 4, decay=0.0)
    assert weights[0] == pytest.approx(1.5, abs=0.15)
    assert np.allclose(thresholds, [1, 3, 5], atol=0.3) and (np.diff(thresholds) > 0).all()
