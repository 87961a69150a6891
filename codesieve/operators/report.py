"""Reports per file: nested rows, JSON text and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Widths, headings and texts of the plain report.
WIDE_RULE, NARROW_RULE, FOOTER_RULE = "=" * 70, "-" * 40, "-" * 70
TITLE = "# C/C++ Vulnerability Analysis Report"
NO_FINDINGS = "No vulnerabilities detected."
CONTEXT_CUT = 100
# Terminal colours of the severities.
COLOURS = {"CRITICAL": "\x1b[91m", "HIGH": "\x1b[93m", "MEDIUM": "\x1b[94m", "LOW": "\x1b[92m"}
COLOUR_END = "\x1b[0m"

STATISTICS = (
    "total_vulnerabilities", "critical_count", "high_count", "medium_count", "low_count",
    "vulnerability_types", "most_common_type", "risk_score",
)


def nested_reports(results: DataFrame, include_fixes: bool = False) -> DataFrame:
    """One row per file: statistics struct and its findings in report order.

    ``results`` has file_id, path, chunks_analyzed, the statistics columns and ``listed``.
    """
    shown = ["line", "severity", "type", "description", "context", "source", "cwe"]
    if include_fixes:
        shown.append("suggested_fix")
    entry = lambda x: F.struct(*[x[c].alias(c) for c in shown])
    return results.select(
        "file_id", "path", "chunks_analyzed", F.struct(*STATISTICS).alias("statistics"),
        F.transform("listed", entry).alias("vulnerabilities"),
    )


def json_reports(nested: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """Nested reports as JSON text; absent values are absent keys."""
    stamp = F.current_timestamp() if generated_at is None else generated_at
    metadata = F.struct(
        F.col("path").alias("filename"), "chunks_analyzed",
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )
    document = F.struct(metadata.alias("metadata"), "statistics", "vulnerabilities")
    return nested.select("file_id", F.to_json(document, {"pretty": "true"}).alias("report"))


def _finding_block(entry: Column, include_fixes: bool, colours: bool) -> Column:
    level = F.concat(F.lit("["), entry["severity"], F.lit("]"))
    if colours:
        painted = F.coalesce(*[F.when(entry["severity"] == s, F.lit(c)) for s, c in COLOURS.items()])
        level = F.coalesce(F.concat(painted, level, F.lit(COLOUR_END)), level)
    context = F.when(
        F.coalesce(entry["context"], F.lit("")) != "",
        F.concat(F.lit("  Context: "), F.left(entry["context"], F.lit(CONTEXT_CUT)), F.lit("...")),
    )
    parts = [
        F.format_string("Line %d: %s %s - %s", entry["line"], level, entry["type"], entry["description"]),
        context,
        F.concat(F.lit("  CWE: "), entry["cwe"]),
    ]
    if include_fixes:
        parts.append(F.concat(F.lit("  Fix: "), entry["suggested_fix"]))
    return F.concat_ws("\n", *parts, F.lit(""))


def text_reports(
    nested: DataFrame, include_fixes: bool = False, colours: bool = False, generated_at: Column | None = None
) -> DataFrame:
    """Nested reports as plain text: header, summary, one block per finding, footer."""
    stamp = F.current_timestamp() if generated_at is None else generated_at
    stats = {name: F.col(f"statistics.{name}") for name in STATISTICS}

    def row(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value.cast("string"))

    blocks = F.concat_ws(
        "\n", F.transform("vulnerabilities", lambda v: _finding_block(v, include_fixes, colours))
    )
    heading = F.concat_ws(
        "\n",
        F.lit(WIDE_RULE),
        F.lit(TITLE),
        row("# File: ", F.col("path")),
        row("# Chunks Analyzed: ", F.col("chunks_analyzed")),
        F.lit(WIDE_RULE),
        F.lit(""),
        F.lit("## Summary"),
        F.lit(NARROW_RULE),
        row("Total Vulnerabilities: ", stats["total_vulnerabilities"]),
        row("Critical: ", stats["critical_count"]),
        row("High:     ", stats["high_count"]),
        row("Medium:   ", stats["medium_count"]),
        row("Low:      ", stats["low_count"]),
        row("Risk Score: ", stats["risk_score"]),
        F.when(stats["most_common_type"] != "", row("Most Common Type: ", stats["most_common_type"])),
        F.lit(""),
        F.when(
            stats["total_vulnerabilities"] > 0,
            F.concat_ws("\n", F.lit("## Vulnerabilities Found"), F.lit(NARROW_RULE)),
        ).otherwise(F.concat_ws("\n", F.lit(NO_FINDINGS), F.lit(""))),
    )
    footer = F.concat_ws(
        "\n",
        F.lit(FOOTER_RULE),
        row("Report generated at: ", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
    )
    text = F.concat_ws("\n", heading, F.when(F.size("vulnerabilities") > 0, blocks), footer)
    return nested.select("file_id", text.alias("report"))
