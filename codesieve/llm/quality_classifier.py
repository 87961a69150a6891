"""Quality by co-training: a classifier of the text and one of the metadata teach each other.

Both views are naive Bayes models: the text view over words, word shapes and repeated neighbours, the
metadata view over language, source and length. The first models come from a bounded sample of
labelled rows. In each round one pass over all documents scores both views; where one is confident,
its verdict is counted as a label for the other. At the end the views are calibrated on held-out
labelled rows and their log-odds added.

A pass keeps one dense vector of counts per task and returns its sums, so what is shuffled and
collected is bounded by the number of features, and no text moves. Documents without an id, or in
the sample, get no pseudo-labels. Null texts are empty; an empty text has no words and a text score at
the calibrated middle. Null metadata is a value of its own. Repeated rows score alike; extra columns
are kept. Without usable labels all scores are 0.5 and all documents are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import Sample, labelled_sample, sampled_documents
from .words import SPACED, slices, words_of

WORD_BITS, SHAPE_BITS, META_BITS = 16, 12, 12
SHAPES_AT = 1 << WORD_BITS
REPEATS_AT = SHAPES_AT + (1 << SHAPE_BITS)
TEXT_SIZE = REPEATS_AT + 2
META_SIZE = 1 << META_BITS
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
FAMILIES = (slice(0, SHAPES_AT), slice(SHAPES_AT, REPEATS_AT), slice(REPEATS_AT, TEXT_SIZE))

# Classes of bytes: lower, upper, digit, other letters; any other byte is a class of its own.
_CLASS = np.array(
    [1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b >= 128 else b for b in range(256)],
    np.int64,
)


@dataclass(frozen=True)
class Model:
    """Log-odds of good quality by feature, for both views, with their calibration (slope, offset)."""

    text: np.ndarray
    meta: np.ndarray
    text_line: tuple[float, float] = (1.0, 0.0)
    meta_line: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.0


@dataclass(frozen=True)
class Views:
    """Features of a batch: (row, feature) of words, the number of words, (row, feature) of metadata."""

    row: np.ndarray
    feature: np.ndarray
    words: np.ndarray
    meta: np.ndarray


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashed classes of the first two and the last three bytes."""
    code = np.zeros(len(start), np.int64)
    for at in (start, np.minimum(start + 1, end - 1), end - 1, np.maximum(end - 2, start), np.maximum(end - 3, start)):
        code = code * 131 + _CLASS[data[at]]
    return (code ^ (code >> 13)) & ((1 << SHAPE_BITS) - 1)


def views_of(batch: pa.RecordBatch) -> Views:
    """Both views of rows with the columns text, lang, source, n_chars."""
    words = words_of(batch.column("text"), SPACED)
    repeat = np.zeros(len(words.hash), np.int64)
    repeat[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    features = [
        (words.hash & np.uint64(SHAPES_AT - 1)).astype(np.int64),
        SHAPES_AT + _shapes(words.data, words.start, words.end) if len(words.hash) else np.zeros(0, np.int64),
        REPEATS_AT + repeat,
    ]
    hashed = lambda *parts: zlib.crc32("|".join(map(str, parts)).encode()) & (META_SIZE - 1)
    meta = [
        (hashed("lang", lang), hashed("source", source), hashed("both", lang, source), hashed("size", None if n is None else max(0, n).bit_length()))
        for lang, source, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)
    ]
    return Views(
        np.tile(words.text, 3), np.concatenate(features), words.per_text, np.array(meta, np.int64).reshape(-1, 4)
    )


def _raw_scores(views: Views, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-odds of the words, and the sum over the metadata."""
    total = np.bincount(views.row, model.text[views.feature], len(views.words))
    return total / (views.words + 3.0), model.meta[views.meta].sum(1)


def _odds(raw: np.ndarray, line: tuple[float, float]) -> np.ndarray:
    return np.clip(line[0] * raw + line[1], -30, 30)


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, 1)


def _counter(sample: Sample, model: Model | None, sure_good: float, sure_bad: float):
    """Counts features under true labels (no model) or under the other view's confident verdicts too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, meta = np.zeros((2, TEXT_SIZE)), np.zeros((2, META_SIZE))
        for part in _parts(batches):
            ids = part.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            at = np.where(known, sample.find(ids), -1)
            train = (at >= 0) & ~sample.held_out[at] if len(sample.ids) else np.zeros(len(ids), bool)
            truth = np.where(train, sample.labels[at] if len(sample.ids) else 0, -1)
            views = views_of(part)
            for_text, for_meta = truth.copy(), truth.copy()
            if model is not None:
                by_text, by_meta = (
                    _chance(_odds(raw, line)) for raw, line in zip(_raw_scores(views, model), (model.text_line, model.meta_line), strict=True)
                )
                free = known & (at < 0)
                for labels, chance in ((for_meta, by_text), (for_text, by_meta)):
                    labels[free & (chance >= sure_good)] = 1
                    labels[free & (chance <= sure_bad)] = 0
            weight = 100.0 / np.maximum(views.words, 100)
            for label in (0, 1):
                mine = for_text[views.row] == label
                text[label] += np.bincount(views.feature[mine], weight[views.row[mine]], TEXT_SIZE)
                meta[label] += np.bincount(views.meta[for_meta == label].ravel(), minlength=META_SIZE)
        for view, sums in enumerate((text, meta)):
            some = np.flatnonzero(sums.any(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), view)), pa.array(some), pa.array(sums[0][some]), pa.array(sums[1][some])],
                names=["view", "feature", "bad", "good"],
            )

    return count


def _log_odds(bad: np.ndarray, good: np.ndarray, families: tuple[slice, ...]) -> np.ndarray:
    """Smoothed log-odds of good against bad, each family of features by itself."""
    out = np.zeros(len(bad))
    for part in families:
        b, g = bad[part], good[part]
        smooth = 1.0
        out[part] = np.log((g + smooth) / (g.sum() + smooth * len(g))) - np.log((b + smooth) / (b.sum() + smooth * len(b)))
        out[part][(b + g) == 0] = 0.0
    return out


def _fitted(docs: DataFrame, sample: Sample, model: Model | None, sure_good: float, sure_bad: float) -> Model:
    source = docs.select(*COLUMNS)
    counts = source.mapInArrow(_counter(sample, model, sure_good, sure_bad), "view long, feature long, bad double, good double")
    sums = counts.groupBy("view", "feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    dense = []
    for view, size, families in ((0, TEXT_SIZE, FAMILIES), (1, META_SIZE, (slice(0, META_SIZE),))):
        mine = sums[sums["view"] == view]
        sides = [np.bincount(mine["feature"].to_numpy(np.int64), mine[side].to_numpy(), size) for side in ("bad", "good")]
        dense.append(_log_odds(*sides, families))
    return Model(*dense)


def platt(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log-odds of label 1; targets are smoothed, so a clean split stays finite."""
    ones, n = label.sum(), len(label)
    if not 0 < ones < n:
        return 0.0, float(np.log((ones + 1) / (n - ones + 1)))
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (n - ones + 2))
    scale = raw.std() or 1.0
    x = np.stack([(raw - raw.mean()) / scale, np.ones(n)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = _chance(np.clip(x @ w, -30, 30))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(hessian, x.T @ (target - p) - 1e-3 * w)
    slope = w[0] / scale
    return float(slope), float(w[1] - slope * raw.mean())


def _calibrated(docs: DataFrame, sample: Sample, model: Model) -> Model:
    """Fits both lines on the held-out rows, whose number is bounded by the sample."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            at = sample.find(part.column(0).to_numpy(zero_copy_only=False))
            text, meta = _raw_scores(views_of(part), model)
            held = sample.held_out[at]
            yield pa.RecordBatch.from_arrays([pa.array(c[held]) for c in (text, meta, sample.labels[at])], names=["text", "meta", "label"])

    rows = sampled_documents(docs.select(*COLUMNS), sample).mapInArrow(score, "text double, meta double, label long").toPandas()
    label = rows["label"].to_numpy()
    lines = [platt(rows[c].to_numpy(), label) for c in ("text", "meta")]
    prior = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
    return Model(model.text, model.meta, *lines, prior)


def co_trained(
    docs: DataFrame, labels: DataFrame, rounds: int = 2, most_labelled: int = 20_000, sure_good: float = 0.98, sure_bad: float = 0.05
) -> Model | None:
    """The model after ``rounds`` exchanges; at most ``most_labelled`` labelled rows are used, or None without."""
    sample = labelled_sample(labels, "quality", most_labelled)
    if len(np.unique(sample.labels)) < 2:
        return None
    model = _calibrated(docs, sample, _fitted(sampled_documents(docs, sample), sample, None, sure_good, sure_bad))
    for _ in range(rounds):
        model = _calibrated(docs, sample, _fitted(docs, sample, model, sure_good, sure_bad))
    return model


def quality(model: Model | None) -> Column:
    """struct(text_score, meta_score, score): chances of good quality by view and combined."""
    kind = "text_score double, meta_score double, score double"

    def score(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        if model is None:
            sides = [np.full(len(text), 0.5)] * 3
        else:
            batch = pa.RecordBatch.from_arrays([text, text, lang, source, n_chars], names=["of", "text", "lang", "source", "n_chars"])
            raw = [_raw_scores(views_of(part), model) for part in slices(batch, 1)]
            by_text, by_meta = (np.concatenate(x) if raw else np.zeros(0) for x in (zip(*raw) if raw else ((), ())))
            text_odds, meta_odds = _odds(by_text, model.text_line), _odds(by_meta, model.meta_line)
            sides = [_chance(text_odds), _chance(meta_odds), _chance(text_odds + meta_odds - model.prior)]
        return pa.StructArray.from_arrays([pa.array(s) for s in sides], names=["text_score", "meta_score", "score"])

    scored = F.arrow_udf(score, kind)
    return scored(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))


def typed(docs: DataFrame) -> DataFrame:
    """The columns that training reads, with the types it expects."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")],
        F.col("n_chars").cast("long").alias("n_chars"),
    )


def scored(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, the three scores, and ``kept``."""
    model = co_trained(typed(docs), labels, **parameters)
    return docs.select("doc_id", quality(model).alias("q")).select("doc_id", "q.*", (F.col("q.score") >= 0.5).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The documents of good quality, all columns."""
    model = co_trained(typed(docs), labels, **parameters)
    return docs.withColumn("__quality", quality(model)["score"]).where("__quality >= 0.5").drop("__quality")
