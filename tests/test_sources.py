import json
import os

from codesieve.operators import report
from codesieve.operators.scan import raw_findings
from codesieve.plans.corpus_scan import scan_corpus
from codesieve.sources import listing, sinks, tables


def test_source_files_are_cleaned(spark, fresh_dir):
    os.makedirs(f"{fresh_dir}/in/sub")
    contents = {
        "crlf.c": b"a\r\nb\rc\n", "bad.h": b"ok\xff\xfe!\n", "UP.CPP": b"x = rand();", "empty.hpp": b"",
        "notes.txt": b"gets(a);", "sub/deep.cc": "é = 1;\n".encode(), "c": b"no extension",
    }
    for name, data in contents.items():
        with open(f"{fresh_dir}/in/{name}", "wb") as handle:
            handle.write(data)
    read = tables.read_source_files(spark, f"{fresh_dir}/in")
    found = {r.path.split("/in/")[1]: r.content for r in read.collect()}
    assert found == {
        "crlf.c": "a\nb\nc\n", "bad.h": "ok!\n", "UP.CPP": "x = rand();", "sub/deep.cc": "é = 1;\n",
        "empty.hpp": "",
    }
    assert {r.rule_id for r in raw_findings(read).collect()} >= {"H29", "X1", "M12"}


def test_lines_keep_the_empty_tail(spark, files):
    assert [(r.line_no, r.line) for r in tables.to_lines(files("a\n\n")).collect()] == [(1, "a"), (2, ""), (3, "")]


def test_skipped_rows_are_counted(spark):
    frame = spark.createDataFrame([("a.c",), ("b.CXX",), ("c.py",), ("d.cx",)], "path string")
    assert tuple(tables.split_counts(frame).first()) == (2, 2)


def test_spread_deals_by_file(files):
    spread = tables.spread(files(*"abcdef").coalesce(1), 3)
    assert spread.rdd.getNumPartitions() == 3
    assert sorted(r.content for r in spread.collect()) == list("abcdef")


def test_empty_files_are_rows(spark, fresh_dir):
    for name, content in (("a b.c", b""), ("full.c", b"int x;"), ("no.txt", b"")):
        with open(f"{fresh_dir}/{name}", "wb") as out:
            out.write(content)
    rows = {r.path.rsplit("/", 1)[1]: r.content for r in tables.read_source_files(spark, fresh_dir).collect()}
    assert rows == {"a b.c": "", "full.c": "int x;"}
    verdicts = scan_corpus(tables.read_source_files(spark, fresh_dir)).files.select("verdict").collect()
    assert [r.verdict for r in verdicts] == [0, 0]


def test_folders_are_walked_by_tasks(spark, fresh_dir):
    names = {f"a{n % 5}/b{n % 3}/c{n % 2}/f{n}.c" for n in range(60)} | {"top.c", "a0/mid.c", "a0/b0/skip.txt"}
    for name in names:
        os.makedirs(os.path.dirname(f"{fresh_dir}/{name}"), exist_ok=True)
        with open(f"{fresh_dir}/{name}", "w") as out:
            out.write(name)
    for enough in (1, 4, 1000):
        folders, root = listing._folders(fresh_dir, enough)
        assert root == fresh_dir and len(set(folders)) == len(folders)
        assert sum(deep for _, deep in folders) >= min(enough, 1) or enough == 1000
    found = listing.list_files(spark, fresh_dir).collect()
    assert sorted(r.path.removeprefix(f"{fresh_dir}/") for r in found) == sorted(names)
    assert [r.path for r in listing.list_files(spark, f"file://{fresh_dir}", recursive=False).collect()] == [f"{fresh_dir}/top.c"]
    read = {r.path.removeprefix(f"{fresh_dir}/"): r.content for r in tables.read_source_files(spark, fresh_dir).collect()}
    assert read == {n: n for n in names if n.endswith(".c")}


def test_an_empty_folder_has_no_files(spark, fresh_dir):
    assert tables.read_source_files(spark, fresh_dir).count() == 0


def test_sinks(spark, files, fresh_dir):
    scan = scan_corpus(files("gets(a);", "int x;"))
    nested = scan.reports()
    sinks.write_findings(scan.findings, f"{fresh_dir}/findings")
    sinks.write_reports(report.json_reports(nested), f"{fresh_dir}/json")
    sinks.write_reports(report.text_reports(nested), f"{fresh_dir}/text", buckets=2)
    assert spark.read.parquet(f"{fresh_dir}/findings").count() == scan.findings.count()
    parsed = {r.file_id: json.loads(r.report) for r in sinks.read_reports(spark, f"{fresh_dir}/json").collect()}
    assert {k: x["metadata"]["filename"] for k, x in parsed.items()} == {"0": "src/0.c", "1": "src/1.c"}
    assert all(set(x) == {"metadata", "statistics", "vulnerabilities"} for x in parsed.values())
    assert "# File: src/1.c\n" in sinks.read_report(spark, f"{fresh_dir}/text", 1)
    assert sinks.read_report(spark, f"{fresh_dir}/text", 7) is None
