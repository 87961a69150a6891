"""Bounded samples of labelled documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sample:
    """Labelled ids in ascending order, their labels, and which are held out for calibration."""

    ids: np.ndarray
    labels: np.ndarray
    held_out: np.ndarray

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Place of each id in the sample, or -1."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)


def labelled_sample(labels: DataFrame, column: str, most: int, held_out: float = 0.3) -> Sample:
    """At most ``most`` labelled ids, those with the least hashes; of contradicting labels the least counts."""
    rows = (
        labels.where(f"doc_id IS NOT NULL AND {column} IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(column).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        .select("doc_id", "label", F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(1000)).alias("part")).toPandas()
    ).sort_values("doc_id")
    return Sample(
        rows["doc_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), rows["part"].to_numpy() < 1000 * held_out
    )


def sampled_documents(docs: DataFrame, sample: Sample) -> DataFrame:
    """The documents of the sample; its ids are broadcast, as their number is bounded."""
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in sample.ids], "__sampled long")
    return docs.join(F.broadcast(ids), docs["doc_id"] == ids["__sampled"], "left_semi")
