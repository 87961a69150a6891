"""Statistics over final findings: per file, and rolled up over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, literal
from ..options import SEVERITY_WEIGHTS, ScanOptions
from .post import severity_rank

# Exit verdicts.
CLEAN, OTHER, HIGH, CRITICAL, FAILED = 0, 1, 2, 3, 4
COUNTS = ("total_vulnerabilities", "critical_count", "high_count", "medium_count", "low_count")


def _counts() -> list[Column]:
    severity = F.coalesce("severity", F.lit("LOW"))
    return [
        F.count("*").alias("total_vulnerabilities"),
        F.count_if(severity == "CRITICAL").alias("critical_count"),
        F.count_if(severity == "HIGH").alias("high_count"),
        F.count_if(severity == "MEDIUM").alias("medium_count"),
        F.count_if(~severity.isin("CRITICAL", "HIGH", "MEDIUM")).alias("low_count"),
    ]


def weighted_risk(weights: dict[str, int]) -> Column:
    """Risk from the four counts."""
    score = F.lit(0)
    for name in SEVERITY_WEIGHTS:
        score = score + F.col(f"{name.lower()}_count") * F.lit(weights[name])
    return score.cast("long")


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*(keys or ("file_id",))).agg(*_counts())


def type_counts(findings: DataFrame) -> DataFrame:
    """Findings per file and type, with the place where the type is first met in report order."""
    met = F.struct("line", severity_rank(F.col("severity")).alias("rank"), "ordinal")
    kind = F.coalesce("type", F.lit("Unknown")).alias("type")
    return findings.groupBy("file_id", kind).agg(
        *_counts(), F.min(met).alias("first_met")
    )


def with_listed_statistics(files: DataFrame, weights: dict[str, int]) -> DataFrame:
    """The same statistics from ``listed``, a file's findings in report order, inside the row.

    Types are sorted with their places, so equal ones are neighbours; the commonest type is, of equally
    common ones, the one met first.
    """
    levels = "transform(listed.severity, s -> coalesce(s, 'LOW'))"
    types = "sort_array(transform(listed.type, (t, at) -> named_struct('type', coalesce(t, 'Unknown'), 'at', at)))"
    starts = (
        "filter(transform(types, (t, n) -> if(n = 0 or t.type <> get(types, n - 1).type, "
        "named_struct('type', t.type, 'at', t.at, 'n', n), null)), t -> t is not null)"
    )
    kinds = (
        "transform(starts, (t, k) -> named_struct('type', t.type, 'at', t.at, "
        "'n', cast(coalesce(get(starts, k + 1).n, size(types)) - t.n as bigint)))"
    )
    number = lambda name: f"cast(size(filter(levels, s -> s = '{name}')) as bigint)"
    named = list(SEVERITY_WEIGHTS)[:3]
    facts = (
        "named_struct('total_vulnerabilities', cast(size(listed) as bigint), "
        + ", ".join(f"'{name.lower()}_count', {number(name)}" for name in named)
        + f", 'low_count', cast(size(filter(levels, s -> s not in ({', '.join(map(literal, named))}))) as bigint), "
        "'most_common_type', coalesce(array_min(transform(kinds, k -> named_struct('n', -k.n, 'at', k.at, 'type', k.type))).type, ''), "
        "'vulnerability_types', map_from_entries(transform(kinds, k -> named_struct('type', k.type, 'n', k.n))))"
    )
    stated = files.withColumn("__facts", F.expr(bind(facts, levels=levels, types=types, starts=starts, kinds=kinds)))
    return stated.select(*files.columns, "__facts.*").withColumn("risk_score", weighted_risk(weights))


def verdict(failed: Column) -> Column:
    """Verdict from the counts; ``failed`` marks files that could not be scanned."""
    return (
        F.when(failed, FAILED).when(F.col("critical_count") > 0, CRITICAL).when(F.col("high_count") > 0, HIGH)
        .when(F.col("total_vulnerabilities") > 0, OTHER).otherwise(CLEAN)
    )


def file_statistics(findings: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Counts, type histogram, most common type and risk score per file with findings.

    Built from per-type partial counts, so the second step holds one row per file and type.
    """
    by_type = type_counts(findings)
    total = F.col("total_vulnerabilities")
    names = [c for c in by_type.columns if c.endswith("_count") or c == "total_vulnerabilities"]
    per_file = by_type.groupBy("file_id").agg(
        *[F.sum(c).alias(c) for c in names],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", total)))).alias("vulnerability_types"),
        F.min_by("type", F.struct((-total).alias("n"), "first_met")).alias("most_common_type"),
    )
    return per_file.withColumn("risk_score", weighted_risk(options.severity_weights))


def with_verdict(files: DataFrame, statistics: DataFrame, failed: Column | None = None) -> DataFrame:
    """Statistics of all files, those without findings too, with the verdict column.

    ``failed`` marks files that could not be scanned.
    """
    joined = files.join(statistics, "file_id", "left").withColumn(
        "verdict", verdict(F.lit(False) if failed is None else failed)
    )
    zero = [c for c in statistics.columns if c.endswith(("_count", "_vulnerabilities", "_score"))]
    return joined.withColumns(
        {
            **{c: F.coalesce(c, F.lit(0).cast("long")) for c in zero},
            "vulnerability_types": F.coalesce("vulnerability_types", F.expr("cast(map() as map<string,bigint>)")),
            "most_common_type": F.coalesce("most_common_type", F.lit("")),
        }
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_id").agg(F.count("*").alias("chunks_analyzed"))


def corpus_rollup(findings: DataFrame, *levels: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Counts and risk for every prefix of ``levels`` and for the whole corpus."""
    rolled = findings.rollup(*levels).agg(F.grouping_id().cast("int").alias("level"), *_counts())
    return rolled.withColumn("risk_score", weighted_risk(options.severity_weights))


def path_levels(path: Column) -> Column:
    """A path's directories from the top, as array<struct<level, name>>, each with all above it."""
    parts = F.split(F.regexp_replace(path, "/+", "/"), "/")
    upto = F.sequence(F.lit(1), F.size(parts) - 1)
    names = F.when(F.size(parts) > 1, F.transform(upto, lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    return F.transform(
        F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda name: name != ""),
        lambda name: F.struct(F.lit("directory").alias("level"), name.alias("name")),
    )


def column_levels(*columns: str) -> Column:
    """Levels by columns of a file, and the whole corpus."""
    named = [F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("name")) for c in columns]
    return F.array(*named, F.struct(F.lit("corpus").alias("level"), F.lit("").alias("name")))


def rolled_up(files: DataFrame, levels: Column, weights: dict[str, int] = SEVERITY_WEIGHTS) -> DataFrame:
    """Statistics of scanned files merged by each level they are in: directories, source, language, corpus.

    ``files`` has a row per file with its statistics, and ``levels`` is an array<struct<level, name>> of it.
    Counts and histograms are added up by level and type, so a level of all files is summed in every task
    first. Of equally common types the first by name is the commonest.
    """
    counts = [c for c in COUNTS if c != "total_vulnerabilities"]
    none, types = F.lit(0).cast("long"), F.map_entries("vulnerability_types")
    own = F.struct(F.lit(None).cast("string").alias("type"), none.alias("n"), F.lit(1).cast("long").alias("files"), *counts)
    of_types = F.transform(types, lambda e: F.struct(
        e["key"].alias("type"), e["value"].alias("n"), none.alias("files"), *[none.alias(c) for c in counts]
    ))
    entries = files.select(F.explode(levels).alias("at"), F.concat(F.array(own), of_types).alias("entries"))
    rows = entries.select("at.level", "at.name", F.explode("entries").alias("e")).select("level", "name", "e.*")
    by_type = rows.groupBy("level", "name", "type").agg(*[F.sum(c).alias(c) for c in ("n", "files", *counts)])
    histogram = F.sort_array(F.collect_list(F.when(F.col("type").isNotNull(), F.struct("type", "n"))))
    merged = by_type.groupBy("level", "name").agg(
        *[F.sum(c).alias(c) for c in ("files", *counts)], F.map_from_entries(histogram).alias("vulnerability_types"),
        F.coalesce(F.min_by("type", F.when(F.col("type").isNotNull(), F.struct((-F.col("n")).alias("n"), "type"))), F.lit("")).alias("most_common_type"),
    )
    total = sum((F.col(c) for c in counts), F.lit(0))
    return merged.withColumn("total_vulnerabilities", total.cast("long")).withColumn("risk_score", weighted_risk(weights))
