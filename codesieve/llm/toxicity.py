"""Toxicity as expected severity from a cumulative-link ordinal regression over sparse text features.

Features are words and word beginnings of six bytes. From a bounded sample of labelled rows, features
are selected whose document counts differ between toxic and clean rows beyond chance: those in at least
``least`` rows with a likelihood ratio of at least ``ratio``, of them the ``most_features`` strongest. With few
labels, toxic words that are rarer than that are not seen. Grades are 0 for clean rows and 1, 2, 3 for toxic rows by how many toxic words they hold; one
weight vector and ordered thresholds give the chance of each grade or more, and their sum is the
expected severity. A row is called toxic from a chance of one half on, or from a lower one if that parts
held-out labelled rows better (F1).

Null and empty texts have no features and the base severity. Repeated rows score alike, rows without
an id are scored but never trained on, extra columns are ignored. Without both labels in the sample
all severities are 0 and no row is toxic. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import Sample, labelled_sample, sampled_documents
from .words import ALNUM, Words, mixed, slices, words_of

# Toxic words from which a toxic row has the grade.
GRADES = ((1, 0), (2, 3), (3, 6))
HEAD = 6
SLOTS = 1 << 16


@dataclass(frozen=True)
class Severity:
    """Selected features in ascending order, their weights, ascending thresholds, and the log-odds called toxic."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.0

    def at_least(self, total: np.ndarray) -> np.ndarray:
        """Chance of grade 1, 2, ... or more, for sums of weights."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - total[:, None], -40, 40)))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every word, and of the first bytes of every longer word."""
    longer = np.flatnonzero(words.end - words.start > HEAD)
    heads = np.zeros(len(longer), np.uint64)
    for k in range(HEAD):
        heads = (heads << np.uint64(8)) | ALNUM[words.data[words.start[longer] + k]]
    return np.concatenate((words.text, words.text[longer])), np.concatenate((words.hash, mixed(heads + np.uint64(1))))


def _document_counts(sample: Sample):
    """For each feature the number of toxic and of clean sample rows that have it, by task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 16 << 20):
                text, key = features(words_of(part.column(1)))
                order = np.lexsort((text, key))
                text, key = text[order], key[order]
                first = np.ones(len(key), bool)
                first[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                text, key = text[first], key[first]
                toxic = sample.labels[sample.find(part.column(0).to_numpy(zero_copy_only=False))][text]
                starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
                bad = np.add.reduceat(toxic, starts) if len(starts) else toxic
                all_ = np.diff(np.concatenate((starts, [len(key)])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[starts].view(np.int64)), pa.array(bad), pa.array(all_ - bad)], names=["key", "toxic", "clean"]
                )

    return count


def _selected(docs: DataFrame, sample: Sample, least: int, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the features that tell the classes apart, ascending, and whether they speak for toxic."""
    toxic, clean = float((sample.labels == 1).sum()), float((sample.labels == 0).sum())
    counts = docs.mapInArrow(_document_counts(sample), "key long, toxic long, clean long").groupBy("key").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    ).where(F.col("toxic") + F.col("clean") >= least)
    share = (F.col("toxic") + F.col("clean")) / (toxic + clean)
    part = lambda n, rows: F.when(n > 0, n * F.ln(n / (rows * share))).otherwise(0.0)
    gain = 2 * (
        part(F.col("toxic"), toxic) + part(F.col("clean"), clean)
        + part(toxic - F.col("toxic"), F.lit(toxic) * (1 / share - 1)) + part(clean - F.col("clean"), F.lit(clean) * (1 / share - 1))
    )
    rows = counts.select("key", gain.alias("gain"), (F.col("toxic") / toxic > F.col("clean") / clean).alias("speaks")).where(
        F.col("gain") >= ratio
    ).orderBy(F.desc("gain"), "key").limit(most).toPandas()
    keys = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["speaks"].to_numpy(bool)[order]


class _Lookup:
    """Finds selected features among many; a small table of slots rules most out at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.slots = np.zeros(SLOTS, bool)
        self.slots[(keys & np.uint64(SLOTS - 1)).astype(np.int64)] = True

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in the keys, count) of the selected features of each text."""
        text, key = features(words_of(texts))
        maybe = self.slots[(key & np.uint64(SLOTS - 1)).astype(np.int64)] if len(self.keys) else np.zeros(len(key), bool)
        text, key = text[maybe], key[maybe]
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        hit = self.keys[at] == key if len(self.keys) else maybe[maybe]
        pairs, n = np.unique(text[hit] * max(1, len(self.keys)) + at[hit], return_counts=True)
        return pairs // max(1, len(self.keys)), pairs % max(1, len(self.keys)), n


def _sample_features(docs: DataFrame, sample: Sample, keys: np.ndarray):
    """(row of the sample, feature, count); bounded by the sample and the number of features."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(keys)
        for batch in batches:
            for part in slices(batch, 1):
                rows = sample.find(part.column(0).to_numpy(zero_copy_only=False))
                text, at, n = lookup.counts(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(rows[text]), pa.array(at), pa.array(n)], names=["row", "feature", "n"])

    found = docs.mapInArrow(find, "row long, feature long, n long").toPandas()
    return found["row"].to_numpy(), found["feature"].to_numpy(), found["n"].to_numpy()


def fit_ordinal(
    row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, size: int, grades: int,
    steps: int = 400, rate: float = 0.1, decay: float = 1e-4,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the likelihood of the grades (full batches, Adam)."""
    n = len(grade)
    shares = np.array([(grade >= k).mean() for k in range(1, grades)]).clip(1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log((1 - shares) / shares) + 1e-3 * np.arange(grades - 1))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    state = np.concatenate((np.zeros(size), start[:1], gaps))
    first, second = np.zeros_like(state), np.zeros_like(state)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, low, gap = state[:size], state[size], np.exp(state[size + 1 :])
        thresholds = low + np.concatenate(([0.0], np.cumsum(gap)))
        total = np.bincount(row, w[feature] * value, n)
        # P(y <= k) with P(y <= -1) = 0 and P(y <= last) = 1.
        upto = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - total[:, None], -35, 35)))
        bounds = np.concatenate((np.zeros((n, 1)), upto, np.ones((n, 1))), 1)
        slope = bounds * (1 - bounds)
        chance = np.maximum(bounds[rows, grade + 1] - bounds[rows, grade], 1e-12)
        upper, lower = slope[rows, grade + 1] / chance, slope[rows, grade] / chance
        by_total = (upper - lower) / n
        by_threshold = np.zeros(grades + 1)
        np.add.at(by_threshold, grade + 1, -upper / n)
        np.add.at(by_threshold, grade, lower / n)
        by_threshold = by_threshold[1:-1]
        tail = np.cumsum(by_threshold[::-1])[::-1]
        slope_all = np.concatenate((
            np.bincount(feature, by_total[row] * value, size) + decay * w, tail[:1], tail[1:] * gap
        ))
        first = 0.9 * first + 0.1 * slope_all
        second = 0.999 * second + 0.001 * slope_all**2
        state = state - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gap = np.exp(state[size + 1 :])
    return state[:size], state[size] + np.concatenate(([0.0], np.cumsum(gap)))


def best_cut(total: np.ndarray, toxic: np.ndarray) -> float | None:
    """The total that parts toxic from clean rows with the best F1, midway between two; None if none does."""
    order = np.argsort(-total, kind="stable")
    total, toxic = total[order], toxic[order]
    apart = total[:-1] > total[1:]
    if not apart.any() or not 0 < toxic.sum() < len(toxic):
        return None
    f1 = 2 * np.cumsum(toxic) / (np.arange(1, len(toxic) + 1) + toxic.sum())
    at = int(np.argmax(np.where(apart, f1[:-1], -1.0)))
    return float(total[at] + total[at + 1]) / 2


def _fitted(docs: DataFrame, sample: Sample, taught: np.ndarray, least: int, ratio: float, most: int) -> tuple[Severity, np.ndarray]:
    """A model of the rows of the sample that are marked in ``taught``, and the log-odds of all its rows."""
    lesson = Sample(sample.ids[taught], sample.labels[taught], sample.held_out[taught])
    keys, speaks = _selected(sampled_documents(docs, lesson), lesson, least, ratio, most)
    row, feature, count = _sample_features(sampled_documents(docs, sample), sample, keys)
    toxic_words = np.bincount(row, count * speaks[feature], len(sample.ids)) if len(row) else np.zeros(len(sample.ids))
    grade = np.zeros(len(sample.ids), np.int64)
    for value, since in GRADES:
        grade[(sample.labels == 1) & (toxic_words >= since)] = value
    mine, place = taught[row], np.cumsum(taught) - 1
    weights, thresholds = fit_ordinal(
        place[row[mine]], feature[mine], np.log1p(count[mine]), grade[taught], len(keys), len(GRADES) + 1
    )
    total = np.bincount(row, weights[feature] * np.log1p(count), len(sample.ids))
    return Severity(keys, weights, thresholds), total - thresholds[0]


def trained(docs: DataFrame, labels: DataFrame, most_labelled: int = 30_000, least: int = 4, ratio: float = 25.0, most_features: int = 2048) -> Severity | None:
    """A model from at most ``most_labelled`` labelled rows, or None without both labels.

    The cut comes from a trial model that does not know the held-out rows; the model itself knows all.
    """
    sample = labelled_sample(labels, "toxic", most_labelled, held_out=0.2)
    if len(np.unique(sample.labels)) < 2:
        return None
    held, cut = sample.held_out, None
    if len(np.unique(sample.labels[~held])) == 2:
        _, odds = _fitted(docs, sample, ~held, least, ratio, most_features)
        cut = best_cut(odds[held], sample.labels[held])
    model, _ = _fitted(docs, sample, np.ones(len(held), bool), least, ratio, most_features)
    return replace(model, cut=min(0.0, cut or 0.0))


def scored(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, expected severity, chance of any toxicity, likeliest grade, and ``toxic``."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = trained(typed, labels, **parameters)

    def score(texts: pa.Array) -> pa.Array:
        total = np.zeros(len(texts))
        if model is None:
            chances, toxic = np.zeros((len(texts), len(GRADES))), np.zeros(len(texts), bool)
        else:
            lookup, at = _Lookup(model.keys), 0
            for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0):
                text, place, n = lookup.counts(part.column(0))
                total[at : at + len(part)] = np.bincount(text, model.weights[place] * np.log1p(n), len(part))
                at += len(part)
            chances, toxic = model.at_least(total), total - model.thresholds[0] >= model.cut
        each = np.concatenate((1 - chances[:, :1], chances[:, :-1] - chances[:, 1:], chances[:, -1:]), 1)
        return pa.StructArray.from_arrays(
            [pa.array(chances.sum(1)), pa.array(chances[:, 0]), pa.array(each.argmax(1).astype(np.int32)), pa.array(toxic)],
            names=["severity", "p_toxic", "grade", "toxic"],
        )

    of = F.arrow_udf(score, "severity double, p_toxic double, grade int, toxic boolean")
    return docs.select("doc_id", of(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")
