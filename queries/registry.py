"""Every registered query as a function of (spark, sf_dir)."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.operators import model_text as MT
from codesieve.operators import post, report, segment, stats
from codesieve.operators.scan import line_findings, raw_findings
from codesieve.operators.segment import with_whole_text
from codesieve.options import ScanOptions
from codesieve.plans.corpus_scan import CorpusScan, scan_corpus
from codesieve.sources import sinks
from codesieve.sources.listing import write_files
from codesieve.sources.tables import clean_text, read_source_files, source_rows, text_corpus, to_lines

from . import corpora

Query = Callable[[SparkSession, str], DataFrame]

# The code corpora have 40 lines a file; in these queries a file is one chunk.
WHOLE = ScanOptions(max_chunk_size=None)
BASIC = ("file_id", "line", "severity", "type", "description")
RESULT = (*BASIC, "context", "source", "rule_id")


def on_lines(*rules: str) -> Query:
    """Line-only rules straight on the lines; no grouping, no shuffle."""
    return lambda spark, sf: line_findings(corpora.code_lines(spark, sf), set(rules)).select(*RESULT)


def on_files(*rules: str) -> Query:
    """Rules with context, each file being one chunk."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        packs = frozenset(r[0] for r in rules)
        options = ScanOptions(max_chunk_size=None, packs=packs)
        files = corpora.line_files(spark, sf)
        return raw_findings(files, options, set(rules), with_whole_text).select(*RESULT)

    return run


def on_documents(*rules: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        options = ScanOptions(max_chunk_size=None, packs=frozenset(r[0] for r in rules))
        return raw_findings(corpora.documents(spark, sf), options, set(rules), with_whole_text).select(*RESULT)

    return run


def line_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Raw findings of all packs on the line corpus."""
    return raw_findings(corpora.line_files(spark, sf), WHOLE, cutter=with_whole_text)


def line_scan(spark: SparkSession, sf: str) -> CorpusScan:
    """The whole scan of the line corpus, one row per file."""
    return scan_corpus(corpora.line_files(spark, sf), WHOLE, cutter=with_whole_text)


def numbered_files(spark: SparkSession, sf: str) -> DataFrame:
    """The line corpus, its paths cycling through extensions; the last two are no sources."""
    endings = ["c", "CPP", "cc", "Cxx", "h", "hpp", "txt", "c.bak"]
    kind = F.get(F.array(*[F.lit(e) for e in endings]), (F.col("file_id") % len(endings)).cast("int"))
    path = F.concat(F.lit("f"), F.col("file_id").cast("string"), F.lit("."), kind)
    return corpora.line_files(spark, sf).withColumn("path", path)


def source_filter(spark: SparkSession, sf: str) -> DataFrame:
    files = text_corpus(numbered_files(spark, sf), "file_id", "content", F.col("path"))
    return source_rows(files).select("file_id", "path", F.length("content").alias("n_chars"))


def line_split(spark: SparkSession, sf: str) -> DataFrame:
    return to_lines(corpora.documents(spark, sf))


def _line_reports(spark: SparkSession, sf: str) -> DataFrame:
    return line_scan(spark, sf).reports(include_fixes=True)


def _fixed_time():
    return F.to_timestamp(F.lit("2024-01-01 00:00:00"))


def json_report(spark: SparkSession, sf: str) -> DataFrame:
    """Fields read back from the JSON text, one row per reported finding."""
    document = (
        "metadata struct<filename:string,chunks_analyzed:bigint>,"
        "statistics struct<total_vulnerabilities:bigint,risk_score:bigint>,"
        "vulnerabilities array<struct<line:int,severity:string,type:string,context:string,cwe:string>>"
    )
    reports = report.json_reports(_line_reports(spark, sf), _fixed_time())
    parsed = reports.select("file_id", F.from_json("report", document).alias("d"))
    return parsed.select("file_id", "d", F.posexplode("d.vulnerabilities").alias("at", "v")).select(
        "file_id", F.col("d.metadata.filename").alias("filename"),
        F.col("d.metadata.chunks_analyzed").alias("chunks_analyzed"),
        F.col("d.statistics.total_vulnerabilities").alias("total"),
        F.col("d.statistics.risk_score").alias("risk_score"),
        (F.col("at") + 1).alias("place"), "v.line", "v.severity", "v.type", "v.context", "v.cwe",
    )


def text_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.text_reports(_line_reports(spark, sf), True, False, _fixed_time())


def scan_options(spark: SparkSession, sf: str) -> DataFrame:
    """Own weights, a threshold, ignored patterns and context lines, all at work."""
    options = ScanOptions.from_config(
        {
            "analysis": {"max_chunk_size": None, "enable_llm": False, "confidence_threshold": 0.7},
            "output": {"max_context_lines": 1},
            "vulnerabilities": {"ignore_patterns": ["system", "sleep("], "severity_weights": {"HIGH": 20}},
        }
    )
    found = raw_findings(corpora.line_files(spark, sf), options, cutter=with_whole_text)
    kept = post.apply_options(found, options).where("line > 0")
    per_line = stats.severity_counts(
        kept.withColumn("context_lines", F.array_join("context_lines", "|")), "file_id", "line", "context_lines"
    )
    return per_line.select(
        "file_id", "line", "context_lines", "total_vulnerabilities",
        stats.weighted_risk(options.severity_weights).alias("risk_score"),
    )


def code_chunks(spark: SparkSession, sf: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    return segment.chunk_files(corpora.code_files(spark, sf), options)


def chunks_of_type(kind: str) -> Query:
    return lambda spark, sf: code_chunks(spark, sf).where(F.col("chunk_type") == kind).select(
        "file_id", "function_name", "start_line", "end_line", "content"
    )


def function_headers(spark: SparkSession, sf: str) -> DataFrame:
    return segment.function_headers(corpora.code_files(spark, sf))


def brace_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return segment.brace_pairs(corpora.code_files(spark, sf)).select(
        "file_id", "level", "open_line", "close_line"
    )


def size_split(spark: SparkSession, sf: str) -> DataFrame:
    return segment.chunk_texts(corpora.documents(spark, sf)).select(
        "file_id", "chunk_idx", "start_line", "end_line", F.length("content").alias("n_chars")
    )


def chunk_order(spark: SparkSession, sf: str) -> DataFrame:
    return code_chunks(spark, sf).select("file_id", "chunk_idx", "chunk_type", "function_name", "start_line")


def chunk_summary(spark: SparkSession, sf: str) -> DataFrame:
    types = F.array_join(
        F.transform(F.map_entries("chunk_types"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))),
        ",",
    )
    return segment.chunk_summary(code_chunks(spark, sf)).select(
        "file_id", "total_chunks", types.alias("chunk_types"),
        F.array_join("functions", ",").alias("functions"), F.col("avg_chunk_size").cast("long"),
    )


def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    return segment.chunk_lines(code_chunks(spark, sf)).drop("function_name")


def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    prompts = MT.with_prompt(corpora.documents(spark, sf), F.col("path"))
    return prompts.select("file_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


def annotate_default(spark: SparkSession, sf: str) -> DataFrame:
    """Pack M written as model text for each chunk, then parsed back."""
    chunks = code_chunks(spark, sf)
    starts = chunks.select("file_id", "chunk_idx", "start_line")
    found = raw_findings(corpora.code_files(spark, sf), ScanOptions(packs=frozenset("M")))
    responses = MT.render_findings(found.join(starts, ["file_id", "chunk_idx"]))
    return MT.parse_model_text(responses).select("file_id", "chunk_idx", *BASIC[1:], "source")


def annotate_hook(spark: SparkSession, sf: str) -> DataFrame:
    """The annotation hook with a small stand-in predictor over all prompts of the code corpus."""

    nothing = MT.NOTHING_FOUND + "."

    def predict(prompts: pd.Series) -> pd.Series:
        code = prompts.str.extract(r"```c\n([\s\S]*?)\n```", expand=False)
        found = code.str.contains("gets(", regex=False)
        return found.map({True: "Line 1: [HIGH] Unsafe Input - gets in chunk", False: nothing})

    answers = MT.annotate(MT.with_prompt(code_chunks(spark, sf)), predict)
    return MT.parse_model_text(answers).select("file_id", "chunk_idx", *BASIC[1:])


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return MT.parse_model_text(corpora.model_text(spark, sf))


def parse_main(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).where(F.col("source") == MT.MODEL_SOURCE).select(*BASIC, "source")


def parse_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).where(F.col("source") == MT.FALLBACK_SOURCE).select(*BASIC, "source")


def sentinel_skip(spark: SparkSession, sf: str) -> DataFrame:
    """Answers without findings: empty, or with the sentinel."""
    answers = corpora.model_text(spark, sf)
    found = _parsed(spark, sf).groupBy("file_id").agg(F.count("*").alias("n"))
    return answers.join(found, "file_id", "left_anti").select("file_id", F.length("text").alias("n_chars"))


def severity_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).groupBy("severity").agg(F.count("*").alias("n"))


def type_classify(spark: SparkSession, sf: str) -> DataFrame:
    rated = _parsed(spark, sf).where(F.col("source") == MT.FALLBACK_SOURCE)
    return rated.groupBy("type", "description").agg(F.count("*").alias("n"))


def combine_packs(spark: SparkSession, sf: str) -> DataFrame:
    return line_raw(spark, sf).groupBy("source", "rule_id", "severity").agg(F.count("*").alias("n"))


def fp_filter(spark: SparkSession, sf: str) -> DataFrame:
    context = F.get(
        F.array(*[F.lit(c) for c in corpora.CONTEXTS]), (F.col("line") % len(corpora.CONTEXTS)).cast("int")
    )
    found = _parsed(spark, sf).withColumn("context", context)
    return post.drop_false_positives(found).select(*BASIC, "context")


def cwe_enrich(spark: SparkSession, sf: str) -> DataFrame:
    return post.with_cwe(line_raw(spark, sf)).select("file_id", "line", "type", "source", "rule_id", "cwe")


def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    return line_scan(spark, sf).findings.select(*RESULT)


def ranked_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The final list in report order."""
    return post.ranked(line_scan(spark, sf).findings).select(
        *RESULT, "cwe", post.severity_rank(F.col("severity")).alias("severity_rank")
    )


def fix_suggest(spark: SparkSession, sf: str) -> DataFrame:
    return line_scan(spark, sf).findings.select("file_id", "line", "type", "description", "suggested_fix")


def context_text(spark: SparkSession, sf: str) -> DataFrame:
    found = line_raw(spark, sf)
    return found.groupBy("rule_id").agg(
        F.count("*").alias("n"), F.count("context").alias("with_context"),
        F.min("context").alias("first_context"), F.max(F.length("context")).alias("longest"),
    )


def _line_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the files that have findings."""
    return line_scan(spark, sf).files.where("total_vulnerabilities > 0")


def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _line_statistics(spark, sf).select("file_id", *stats.COUNTS)


def type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _line_statistics(spark, sf).select("file_id", F.explode("vulnerability_types").alias("type", "n"))


def most_common_type(spark: SparkSession, sf: str) -> DataFrame:
    return _line_statistics(spark, sf).select("file_id", "most_common_type")


def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    return _line_statistics(spark, sf).select("file_id", "total_vulnerabilities", "risk_score")


def gate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict of every listed document from its secrets; a listed one without text fails."""
    options = ScanOptions(max_chunk_size=None, packs=frozenset({"H"}))
    documents = corpora.listed_documents(spark, sf)
    secrets = {f"H{n}" for n in range(24, 29)}
    scan = scan_corpus(documents, options, with_whole_text, only=secrets)
    return scan.files.select("file_id", "total_vulnerabilities", "verdict")


def code_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict of every file of the line corpus, from one pass over the text."""
    return line_scan(spark, sf).files.select("file_id", "chunks_analyzed", "total_vulnerabilities", "risk_score", "verdict")


def chunk_count(spark: SparkSession, sf: str) -> DataFrame:
    return stats.chunk_counts(code_chunks(spark, sf))


def corpus_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of the documents by source and language, with subtotals."""
    options = ScanOptions(max_chunk_size=None, packs=frozenset({"H", "X"}))
    keyed = corpora.keyed_documents(spark, sf, "source", "lang")
    rules = {*(f"H{n}" for n in range(24, 29)), "X2"}
    final = scan_corpus(keyed, options, with_whole_text, only=rules).findings
    return stats.corpus_rollup(
        final.select("severity", "file_id.source", "file_id.lang"), "source", "lang", options=options
    )


def secret_risk_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Token assignments in the documents, weighed and summed by source."""
    options = ScanOptions(max_chunk_size=None, packs=frozenset({"H"}))
    keyed = corpora.keyed_documents(spark, sf, "source")
    found = scan_corpus(keyed, options, with_whole_text, only={"H27"}).findings
    counts = stats.severity_counts(found.select("severity", F.col("file_id.source").alias("origin")), "origin")
    return counts.select("origin", "high_count", stats.weighted_risk(options.severity_weights).alias("risk_score"))


def page_protocols(spark: SparkSession, sf: str) -> DataFrame:
    """Insecure protocols in the addresses of pages (line 1) and in their html (from line 2 on)."""
    page = F.concat_ws("\n", "url", "html").alias("content")
    lines = to_lines(corpora.table(spark, sf, "pages").select(F.col("page_id").alias("file_id"), page))
    return line_findings(lines, {"X4"}).select("file_id", "line", "type", "context")


def source_text(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as bytes with other line ends, invalid bytes and empty files, cleaned to text."""
    files = corpora.source_bytes(spark, sf).select("file_id", clean_text(F.col("raw")).alias("content"))
    return files.select("file_id", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


def _shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and tasks share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="corpus-")
    return f"{shared}/{name}-{uuid4().hex}"


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as files in nested folders, a few of them empty or no sources, then listed and read."""
    folder = _shared_folder(spark, "sources")
    endings = F.array(*[F.lit(e) for e in ("c", "H", "cpp", "txt")])
    place = F.concat_ws("/", (F.col("file_id") % 7).cast("string"), (F.col("file_id") % 3).cast("string"), F.col("file_id").cast("string"))
    name = F.concat(place, F.lit("."), F.get(endings, (F.col("file_id") % 4).cast("int")))
    write_files(corpora.source_bytes(spark, sf).select(name.alias("name"), "raw"), folder)
    read = read_source_files(spark, folder)
    return read.select(
        F.regexp_extract("path", "([0-9]+/[0-9]+/[^/]*)$", 1).alias("name"), F.length("content").alias("n_chars"), F.md5("content").alias("digest")
    )


def report_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Text reports of the line corpus, written with their keys and read back."""
    folder = _shared_folder(spark, "reports")
    sinks.write_reports(text_report(spark, sf), folder)
    return sinks.read_reports(spark, folder).select(F.col("file_id").cast("long").alias("file_id"), "report")


def directory_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the line corpus by directory, by the kind of file, and for the whole corpus."""
    place = F.concat(F.lit("/src/d"), (F.col("file_id") % 5).cast("string"), F.lit("/e"), (F.col("file_id") % 3).cast("string"), F.lit("/"), "path")
    nested = numbered_files(spark, sf).withColumn("path", place)
    files = scan_corpus(nested, WHOLE, with_whole_text).files.withColumn("ending", F.substring_index("path", ".", -1))
    levels = F.concat(stats.path_levels(F.col("path")), stats.column_levels("ending"))
    histogram = F.array_join(F.transform(
        F.array_sort(F.map_entries("vulnerability_types")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))
    ), ",")
    return stats.rolled_up(files, levels).withColumn("vulnerability_types", histogram)


def scan_with_model(spark: SparkSession, sf: str) -> DataFrame:
    """The whole scan with a stand-in model in place of pack M; it fails on chunks with ``popen``."""

    nothing = MT.NOTHING_FOUND + "."

    def predict(prompts: pd.Series) -> pd.Series:
        code = prompts.str.extract(r"```c\n([\s\S]*?)\n```", expand=False)
        if code.str.contains("popen(", regex=False).any():
            raise ValueError("no answer")
        found = code.str.contains("gets(", regex=False)
        return found.map({True: "Line 1: [HIGH] Unsafe Input - gets in chunk", False: nothing})

    results = scan_corpus(corpora.code_files(spark, sf), predict=predict).results
    return results.select("file_id", "failed_answers", "verdict", F.explode("listed").alias("x")).select(
        "file_id", "failed_answers", "verdict", *[f"x.{c}" for c in RESULT[1:]], "x.cwe"
    )


def scan_code(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: segmentation, all packs, and all post-processing over the code corpus."""
    return scan_corpus(corpora.code_files(spark, sf)).findings.select(
        *RESULT, "chunk_idx", "function_name", "cwe", "suggested_fix"
    )


def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All packs over the documents as if they were sources, summed by source."""
    keyed = corpora.keyed_documents(spark, sf, "source")
    final = scan_corpus(keyed).findings
    return final.groupBy(F.col("file_id.source").alias("origin"), "rule_id", "severity").agg(
        F.count("*").alias("n")
    )


QUERIES: dict[str, Query] = {
    "source_text": source_text,
    "source_files": source_files,
    "report_sink": report_sink,
    "directory_rollup": directory_rollup,
    "source_filter": source_filter,
    "line_split": line_split,
    "json_report": json_report,
    "text_report": text_report,
    "scan_options": scan_options,
    "includes_chunk": chunks_of_type(segment.INCLUDES),
    "function_headers": function_headers,
    "brace_pairs": brace_pairs,
    "function_chunks": chunks_of_type(segment.FUNCTION),
    "global_chunk": chunks_of_type(segment.GLOBAL),
    "size_split": size_split,
    "chunk_order": chunk_order,
    "chunk_summary": chunk_summary,
    "chunk_lines": chunk_lines,
    "m01_gets": on_lines("M1"),
    "m02_strcpy": on_lines("M2"),
    "m03_strcat": on_lines("M3"),
    "m04_sprintf": on_lines("M4"),
    "m05_printf_user": on_lines("M5"),
    "m06_leak_lookahead": on_files("M6"),
    "m07_use_after_free": on_files("M7"),
    "m08_signed_arith": on_lines("M8"),
    "m09_null_deref": on_files("M9"),
    "m10_array_input": on_lines("M10"),
    "m11_lock": on_lines("M11"),
    "m12_unseeded_rand": on_files("M12"),
    "m13_unchecked_open": on_files("M13"),
    "m14_command_calls": on_lines("M14", "M15", "M16"),
    "h01_dangerous_calls": on_lines(*(f"H{n}" for n in range(1, 9))),
    "h09_format": on_lines("H9"),
    "h10_size_arith": on_lines("H10"),
    "h12_chunk_leak": on_files("H12"),
    "h13_double_free": on_files("H13"),
    "h14_unchecked_return": on_files(*(f"H{n}" for n in range(14, 24))),
    "h24_secrets": on_files(*(f"H{n}" for n in range(24, 29))),
    "h24_secrets_documents": on_documents(*(f"H{n}" for n in range(24, 29))),
    "h29_weak_rng": on_files("H29", "H30"),
    "x01_crypto": on_lines("X1", "X2", "X3", "X4"),
    "x02_secrets_documents": on_documents("X2"),
    "x04_page_protocols": page_protocols,
    "x05_input": on_lines("X5"),
    "x06_sqli": on_lines("X6"),
    "x07_traversal": on_lines("X7"),
    "x08_open_handles": on_files("X8"),
    "x09_unfreed": on_files("X9"),
    "x10_shared_state": on_files("X10"),
    "x11_no_sync": on_files("X11"),
    "x12_race_idioms": on_lines("X12", "X13", "X14"),
    "prompt_build": prompt_build,
    "annotate_default": annotate_default,
    "annotate_hook": annotate_hook,
    "parse_main": parse_main,
    "parse_fallback": parse_fallback,
    "sentinel_skip": sentinel_skip,
    "severity_normalise": severity_normalise,
    "type_classify": type_classify,
    "combine_packs": combine_packs,
    "fp_filter": fp_filter,
    "cwe_enrich": cwe_enrich,
    "dedupe_first": dedupe_first,
    "ranked_findings": ranked_findings,
    "fix_suggest": fix_suggest,
    "context_text": context_text,
    "severity_counts": severity_counts,
    "type_histogram": type_histogram,
    "most_common_type": most_common_type,
    "risk_score": risk_score,
    "gate_verdict": gate_verdict,
    "code_verdict": code_verdict,
    "chunk_count": chunk_count,
    "corpus_rollup": corpus_rollup,
    "secret_risk_by_source": secret_risk_by_source,
    "scan_code": scan_code,
    "scan_with_model": scan_with_model,
    "scan_documents": scan_documents,
}
