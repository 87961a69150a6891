"""Post-processing, statistics, options and reports."""

import json

from pyspark.sql import functions as F

from codesieve.operators import post, report, stats
from codesieve.operators.model_text import parse_model_text
from codesieve.operators.scan import raw_findings
from codesieve.options import ScanOptions
from codesieve.plans.corpus_scan import scan_corpus

BAD = "void f(char *a) {\n  gets(a);\n  system(a);\n}\n"
CLEAN = "int x;\n"
LOW = "int t = a + b;\n"


def test_scan_of_a_corpus(files):
    scan = scan_corpus(files(BAD, CLEAN, LOW, None, ""))
    rows = {r.file_id: r for r in scan.files.collect()}
    assert [rows[n].verdict for n in range(5)] == [3, 0, 1, 4, 0]
    assert rows[1].total_vulnerabilities == 0 and rows[1].vulnerability_types == {}
    assert rows[0].chunks_analyzed == 1
    for row in rows.values():
        parts = row.critical_count + row.high_count + row.medium_count + row.low_count
        assert parts == row.total_vulnerabilities
    keys = scan.findings.groupBy("file_id", "line", "type").count()
    assert keys.where("count > 1").count() == 0


def test_long_files_are_scanned_whole(files):
    scan = scan_corpus(files("int pad;\n" * 20_000 + BAD)).files.first()
    assert (scan.verdict, scan.critical_count) == (3, 1)


def test_row_statistics_equal_the_grouped_ones(files):
    scan = scan_corpus(files(BAD, CLEAN, LOW, BAD * 3))
    grouped = {r.file_id: r for r in stats.file_statistics(scan.findings).collect()}
    for row in scan.files.collect():
        if row.file_id in grouped:
            assert all(row[c] == grouped[row.file_id][c] for c in grouped[row.file_id].asDict())


def test_a_scan_has_no_shuffle_and_a_filter_does_not_repeat_it(files, spark, fresh_dir):
    path = f"{fresh_dir}/files"
    files(BAD).write.parquet(path)
    scan = scan_corpus(spark.read.parquet(path))
    for frame in (scan.findings, scan.files, scan.reports(), scan.files.where("verdict > 0")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("X14") <= 1
        assert len(plan) < 100_000


def test_in_row_results_equal_those_of_rows(files):
    text = BAD + LOW + 'key = "abc";\nint z = a * size;\n' + BAD
    options = ScanOptions(ignore_patterns=("system",), max_context_lines=1, include_context=False)
    rows = post.finish_findings(raw_findings(files(text, CLEAN), options), options)
    columns = sorted(rows.columns)
    in_row = scan_corpus(files(text, CLEAN), options).findings
    assert sorted(map(str, in_row.select(*columns).collect())) == sorted(map(str, rows.select(*columns).collect()))


def test_model_findings_take_the_place_of_pack_m(files):
    def predict(prompts):
        if prompts.str.contains("popen").any():
            raise ValueError
        return prompts.map(lambda p: "Line 1: [LOW] Memory Leak - says a model" if "gets" in p else "")

    scan = scan_corpus(files(BAD, "void g() {\n  popen(a, b);\n}\n", CLEAN), predict=predict)
    rows = {r.file_id: r for r in scan.files.collect()}
    assert [rows[n].failed_answers for n in range(3)] == [0, 1, 0]
    found = scan.findings.where("file_id = 0").collect()
    assert not any((r.rule_id or "").startswith("M") for r in found)
    said = [r for r in found if r.source == "llm"]
    assert [(r.line, r.severity, r.type, r.cwe) for r in said] == [(2, "LOW", "Memory Leak", "CWE-401")]
    assert rows[0].low_count == 1


def test_parsed_findings_go_through_post_processing(spark):
    said = spark.createDataFrame([(1, 1, "Line 2: [HIGH] Buffer Overflow - gets() of x")], "file_id int, start_line int, text string")
    row = post.finish_findings(parse_model_text(said)).first()
    assert (row.line, row.cwe, row.confidence) == (3, "CWE-120", 1.0)
    strict = ScanOptions(confidence_threshold=0.7)
    doubtful = parse_model_text(said).withColumn("confidence", F.lit(0.5))
    assert post.finish_findings(doubtful, strict).count() == 0


def test_first_finding_wins(files):
    kept = post.deduplicate(raw_findings(files(BAD)))
    row = kept.where("line = 2 and type = 'Buffer Overflow'").collect()
    assert [r.rule_id for r in row] == ["M1"]


def test_null_pointer_without_context_is_dropped(spark):
    found = spark.createDataFrame(
        [(1, "HIGH", "Null pointer here", None, "llm"), (2, "HIGH", "Null pointer here", "p->x", "llm"),
         (3, "LOW", "integer overflow", "while (i)", "llm"), (4, "LOW", "integer overflow", "a+b", "llm"),
         (5, "HIGH", "integer overflow", "while (i)", "llm"), (6, "HIGH", "null pointer", None, "pattern")],
        "line int, severity string, description string, context string, source string",
    )
    assert [r.line for r in post.drop_false_positives(found).collect()] == [2, 4, 5, 6]


def test_options_from_config():
    options = ScanOptions.from_config(
        {"analysis": {"max_chunk_size": 100, "enable_llm": False}, "output": {"include_context": False},
         "vulnerabilities": {"ignore_patterns": ["test_"], "severity_weights": {"LOW": 2}}}
    )
    assert options.packs == {"H", "X"} and options.max_chunk_size == 100 and not options.include_context
    assert options.severity_weights == {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 4, "LOW": 2}


def test_options_filter_findings(files):
    text = "void test_f(char *a) {\n  gets(a);\n}\nvoid g(char *a) {\n  gets(a);\n}\n"
    options = ScanOptions(packs=frozenset("H"), ignore_patterns=("test_",), include_context=False, max_context_lines=1)
    rows = post.finish_findings(raw_findings(files(text), options), options).collect()
    assert [(r.line, r.context, r.context_lines) for r in rows] == [(5, None, ["void g(char *a) {", "  gets(a);", "}"])]
    assert post.apply_options(raw_findings(files(text)), ScanOptions(confidence_threshold=1.5)).count() == 0


def test_json_report(files):
    reports = scan_corpus(files(BAD, CLEAN)).reports(True)
    rows = {r.file_id: json.loads(r.report) for r in report.json_reports(reports).collect()}
    assert rows[0]["metadata"]["filename"] == "src/0.c"
    assert rows[0]["statistics"]["critical_count"] == 1
    lines = [v["line"] for v in rows[0]["vulnerabilities"]]
    assert lines == sorted(lines)
    assert rows[0]["vulnerabilities"][1]["suggested_fix"].startswith("Replace gets()")
    assert rows[1]["vulnerabilities"] == []


def test_text_report(files):
    reports = scan_corpus(files(BAD, CLEAN)).reports(True)
    plain = {r.file_id: r.report for r in report.text_reports(reports, True).collect()}
    assert "Line 2: [CRITICAL] Buffer Overflow - gets() function is unsafe and deprecated\n  CWE: CWE-120\n  Fix: " in plain[0]
    assert "No vulnerabilities detected.\n\n" + "-" * 70 in plain[1]
    painted = report.text_reports(reports, colours=True).where("file_id = 0").first().report
    assert "\x1b[91m[CRITICAL]\x1b[0m" in painted and "Fix:" not in painted


def test_a_long_file_has_one_report(files):
    text = "gets(a);\n" * 12_000
    nested = scan_corpus(files(text, CLEAN)).reports()
    assert nested.count() == 2
    assert nested.where("file_id = 0").select(F.size("vulnerabilities")).first()[0] >= 12_000


def test_context_lines_of_chunk_and_file_rules(files):
    text = "int a;\np = malloc(4);\nq = rand();\npthread_create(&t, 0, f, 0);\nint z;"
    options = ScanOptions(max_context_lines=1)
    found = {r.rule_id: r.context_lines for r in raw_findings(files(text), options).collect()}
    assert found["H12"] == ["int a;", "p = malloc(4);", "q = rand();"]
    assert found["H29"] == ["p = malloc(4);", "q = rand();", "pthread_create(&t, 0, f, 0);"]
    assert found["X11"] == ["q = rand();", "pthread_create(&t, 0, f, 0);", "int z;"]
    assert found["X9"] is None


def test_most_common_type_ties_go_to_the_first_met(spark):
    place = "struct<stage:int,chunk_idx:int,pack:int,grp:int,major:int,minor:int,tie:string>"
    rows = [(1, 9, "HIGH", "B", (0, 0, 0, 0, 1, 0, "")), (1, 3, "LOW", "C", (0, 0, 0, 0, 2, 0, "")),
            (1, 3, "HIGH", "A", (0, 0, 0, 0, 3, 0, ""))]
    found = spark.createDataFrame(rows, f"file_id int, line int, severity string, type string, ordinal {place}")
    row = stats.file_statistics(found).first()
    assert (row.most_common_type, row.risk_score) == ("A", 15)


def test_sample_risk_score(spark):
    found = spark.createDataFrame([("CRITICAL",), ("HIGH",), ("MEDIUM",)], "severity string")
    counts = stats.severity_counts(found.withColumn("file_id", F.lit(1)))
    assert counts.select(stats.weighted_risk(ScanOptions().severity_weights)).first()[0] == 21


def test_levels_of_paths_and_merged_statistics(spark, files):
    paths = spark.createDataFrame([("/a/b/c.c",), ("x.c",), ("d//e.c",), (None,)], "path string")
    found = [[x.name for x in r[0]] for r in paths.select(stats.path_levels(F.col("path"))).collect()]
    assert found == [["/a", "/a/b"], [], ["d"], []]
    scanned = scan_corpus(files(BAD, CLEAN, LOW)).files
    rolled = {(r.level, r.name): r for r in stats.rolled_up(scanned, F.concat(stats.path_levels(F.col("path")), stats.column_levels())).collect()}
    assert set(rolled) == {("directory", "src"), ("corpus", "")}
    for row in rolled.values():
        assert row.files == 3 and row.total_vulnerabilities == sum(row.vulnerability_types.values())
        assert row.total_vulnerabilities == scanned.agg(F.sum("total_vulnerabilities")).first()[0]
        best = max(row.vulnerability_types.values())
        assert row.most_common_type == min(t for t, n in row.vulnerability_types.items() if n == best)
