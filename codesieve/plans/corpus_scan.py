"""The whole job: one pass over the corpus, then findings, statistics and reports.

A file's findings never leave its row before they are final, so the job has no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import model_text
from ..operators.post import listed
from ..operators.report import nested_reports
from ..operators.scan import with_findings
from ..operators.segment import with_chunks
from ..operators.stats import verdict, with_listed_statistics
from ..operators.units import Cutter
from ..options import HEURISTIC_PACK, MODEL_PACK, ScanOptions


@dataclass(frozen=True)
class CorpusScan:
    """Lazy results: one row per file, with its findings in report order in ``listed``.

    Findings, files and reports are projections of it. Whoever needs several of them writes
    ``results`` once and passes the written table to ``CorpusScan``.
    """

    results: DataFrame

    @property
    def findings(self) -> DataFrame:
        """Final findings, one row each."""
        return self.results.select("file_id", F.explode("listed").alias("x")).select("file_id", "x.*").drop("rank")

    @property
    def files(self) -> DataFrame:
        """Statistics and verdict of every file, those without findings too."""
        return self.results.drop("listed")

    def reports(self, include_fixes: bool = False) -> DataFrame:
        return nested_reports(self.results, include_fixes)


def _scannable(files: DataFrame) -> DataFrame:
    """Missing texts are emptied and marked as failed."""
    failed = F.col("content").isNull()
    return files.select("file_id", "path", failed.alias("failed"), F.coalesce("content", F.lit("")).alias("content"))


def scan_corpus(
    files: DataFrame, options: ScanOptions = ScanOptions(), cutter: Cutter = with_chunks,
    predict: model_text.Predictor | None = None, load: model_text.Loader | None = None, only: set[str] | None = None,
) -> CorpusScan:
    """Scan files(file_id, path, content); nothing runs until a result is used.

    With ``predict``, or ``load`` which makes one in each worker, the findings of pack M are what this model
    says about each chunk; chunks it failed on are counted in ``failed_answers``. ``only`` takes some rules.
    """
    modelled = predict is not None or load is not None
    packs = options.packs - {MODEL_PACK} if modelled else options.packs
    # Chunks are counted where any pack looks at them.
    cut = bool(options.packs & {MODEL_PACK, HEURISTIC_PACK})
    scanned = with_findings(_scannable(files), options, only, cutter, packs, cut)
    if modelled:
        answered = model_text.with_answers(scanned, predict, load)
        found, unanswered = model_text.answered_findings(), F.size(F.filter("answers", lambda a: a["text"].isNull()))
        scanned = answered.withColumns({"found": F.concat(found, "found"), "failed_answers": unanswered.cast("long")}).drop("answers")
    else:
        scanned = scanned.withColumn("failed_answers", F.lit(0).cast("long"))
    chunks = F.size("chunks") if cut else F.lit(None)
    # What is not deterministic is evaluated once: a filter on a result must not repeat the scan below it.
    once = F.when(F.spark_partition_id() >= 0, F.col("found"))
    counted = scanned.select(
        "file_id", "path", "failed", F.when(F.col("failed"), 0).otherwise(chunks).cast("long").alias("chunks_analyzed"),
        "failed_answers", once.alias("found"),
    )
    final = counted.select(*counted.columns[:-1], F.expr(listed("found", options)).alias("listed"))
    results = with_listed_statistics(final, options.severity_weights)
    return CorpusScan(results.withColumn("verdict", verdict(F.col("failed"))))
