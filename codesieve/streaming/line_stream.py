"""Rules on streams.

Line-only rules are row-local, so a streaming DataFrame of lines goes through the same plan
as a table. Rules with a wider scope need the whole file in one row; they run per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.post import finish_findings
from ..operators.scan import LINE_RULES, line_findings, raw_findings
from ..options import ScanOptions
from ..sources.tables import to_lines

def stream_line_findings(files: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Findings of line-only rules on a stream of files(file_id, content)."""
    return line_findings(to_lines(files), LINE_RULES if only is None else only)


def stream_raw_findings(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Raw findings of all packs on a stream whose rows each hold one whole file."""
    return raw_findings(files, options)


def scan_each_batch(
    files: DataFrame, sink: Callable[[DataFrame, int], None], options: ScanOptions = ScanOptions()
) -> DataStreamWriter:
    """Writer that hands each micro-batch's finished findings to ``sink``.

    Deduplication is per file, and a row is a whole file, so no state crosses batches.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        sink(finish_findings(raw_findings(batch, options), options), batch_id)

    return files.writeStream.foreachBatch(run)
