"""Archives written and read back."""

import base64
import hashlib

from codesieve.llm import warc
from codesieve.llm.common import new_path

SCHEMA = "page_id long, url string, html string, offset int, length string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, "same"), (4, "http://a/\r\nX: y", "é\r\n\r\nWARC/1.1"),
    (5, "u", None), (6, "u", ""), (7, "u", "x" * 3_000_000), (8, "u", "single"),
]


def test_round_trip_with_revisits(spark):
    found = {r["page_id"]: r for r in warc.archive_round_trip(pages(spark, ROWS)).collect()}
    assert set(found) == {r[0] for r in ROWS}
    for page, _, html in ROWS:
        assert found[page]["payload_bytes"] == len((html or "").encode())
        assert found[page]["payload_digest"] == sha(html)
        first = min(p for p, _, h in ROWS if (h or "") == (html or ""))
        assert found[page]["refers_to"] == (None if first == page else first)
        assert found[page]["record_type"] == ("response" if first == page else "revisit")


def test_small_payloads_are_all_responses(spark):
    found = warc.archive_round_trip(pages(spark, ROWS), revisit_from=5).collect()
    assert {r["record_type"] for r in found} == {"response"}


def test_selected_records_by_index(spark):
    folder = new_path(spark, "warc")
    index = warc.write_archives(pages(spark, ROWS), folder, file_bytes=100)
    assert index.select("file").distinct().count() > 2
    read = warc.read_archives(index.where("page_id IN (4, 7)"), folder, gap=0, most=10).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in read) == [(4, len("é\r\n\r\nWARC/1.1".encode())), (7, 3_000_000)]


def test_ranges_join_neighbours_only():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("b", 45, 5), ("b", 50, 100)]
    assert list(warc._ranges(rows, 0, 60)) == [("a", 0, 15), ("a", 40, 45), ("b", 45, 50), ("b", 50, 150)]
    assert list(warc._ranges(rows, 25, 1000)) == [("a", 0, 45), ("b", 45, 150)]


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "u", "t"), (1, "u", "t"), (2, "u", "t"), (None, "u", "t"), (None, "u", "other"), (None, "u", "other")]
    found = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages(spark, rows)).collect())
    assert found == [("1", "response", None)] * 2 + [("2", "revisit", 1)] + [("None", "response", None)] * 3
    assert warc.archive_round_trip(pages(spark, [])).count() == 0
