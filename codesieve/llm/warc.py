"""WARC archives: an index row per record, and reads that follow the index.

Writing: each task appends gzip members, one record each, to an archive file in a shared folder and
returns an index row per record (file, offset, length, page, URL, digest). The index is a Parquet
table, so only rows of tasks that succeeded are in it; the file of a failed attempt has its own name
and is never referred to. Records with equal payloads are written once, later ones as revisits.

Reading: the index is filtered first; the chosen records are sorted by place over the tasks, and
neighbouring byte ranges become one read each.

Null or empty html is an empty payload, a null URL gives no target header. Of equal payloads the
smallest page_id is the response; repeated rows of that page are responses too, and pages without an
id are responses. Extra columns are ignored. An empty table gives an empty index and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, write_table

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_BYTES = 16 << 20
INDEX = (
    "page_id long, url string, record_type string, payload_digest string, file string, offset long, length long"
)
READ = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has no payload and names the response it refers to."""
    body = b"" if revisit else payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record; fails on anything that is none."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if version != VERSION or not gap or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"broken record: {head[:200]!r}")
    return fields, rest[:size]


def payload_keys(pages: DataFrame) -> DataFrame:
    """pages with html as bytes, their size, and the hexadecimal SHA-1 of the payload."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).select(
        "*", F.length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1")
    )


def with_record_type(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Adds ``first``, the page whose response a page revisits, or null for responses.

    Groups of equal payloads are summed to one row before anything is joined; groups of one page
    are left out, so the joined side is small, and Spark splits a hot digest if it must shuffle.
    """
    keyed = payload_keys(pages)
    shared = (
        keyed.where(F.col("size") >= revisit_from).groupBy("sha1", "size")
        .agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1 AND least IS NOT NULL")
        .select("sha1", "size", "least")
    )
    revisits = F.when(F.col("page_id") != F.col("least"), F.col("least"))
    return keyed.join(shared, ["sha1", "size"], "left").select("page_id", "url", "payload", revisits.alias("first"))


def _writer(folder: str, file_bytes: int, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = FileSystem.from_uri(folder)
        files.create_dir(at, recursive=True)
        out, place, name = None, 0, ""
        for batch in batches:
            rows = []
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base32_sha1(payload)
                member = gzip.compress(record_bytes(page_id, url, payload, digest, first, first is not None), level, mtime=0)
                if out is not None and place + len(member) > file_bytes:
                    out.close()
                    out = None
                if out is None:
                    name, place = f"{uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{at}/{name}", compression=None)
                out.write(member)
                rows.append((page_id, url, "response" if first is None else "revisit", digest, name, place, len(member)))
                place += len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()])]
                if rows else [pa.array([], t) for t in (pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64())],
                names=["page_id", "url", "record_type", "payload_digest", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0, file_bytes: int = 1 << 30, level: int = 1) -> DataFrame:
    """Write a record per page below ``folder`` (a URI all tasks share) and return the written index."""
    records = with_record_type(pages, revisit_from)
    return write_table(records.mapInArrow(_writer(folder, file_bytes, level), INDEX), "warc-index")


def _ranges(rows: list[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int]]:
    """Sorted (file, offset, length) joined where they are at most ``gap`` apart, up to ``most`` bytes."""
    held = None
    for name, offset, length in rows:
        if held and held[0] == name and offset - held[2] <= gap and offset + length - held[1] <= most:
            held = (name, held[1], max(held[2], offset + length))
        else:
            if held:
                yield held
            held = (name, offset, offset + length)
    if held:
        yield held


def _reader(folder: str, gap: int, most: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = FileSystem.from_uri(folder)
        for batch in batches:
            wanted = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            found, k = [], 0
            for name, start, end in _ranges(wanted, gap, most):
                with files.open_input_file(f"{at}/{name}") as source:
                    data = source.read_at(end - start, start)
                while k < len(wanted) and wanted[k][0] == name and wanted[k][1] + wanted[k][2] <= end and wanted[k][1] >= start:
                    _, offset, length = wanted[k]
                    fields, body = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
                    found.append(_facts(fields, body))
                    k += 1
            if k != len(wanted):
                raise ValueError("index rows are not sorted by file and offset")
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), *[pa.string()] * 3, pa.int64(), pa.int64()))],
                names=["page_id", "url", "record_type", "payload_digest", "refers_to", "payload_bytes"],
            )

    return read


def _facts(fields: dict[str, str], body: bytes) -> tuple:
    """A response's digest is taken from its bytes and held against the header."""
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page, url, kind = _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"]
    if kind == "revisit":
        return page, url, kind, said, _page(fields["WARC-Refers-To"]), None
    if base32_sha1(body) != said:
        raise ValueError(f"payload of page {page} does not match its digest")
    return page, url, kind, said, None, len(body)


def read_archives(index: DataFrame, folder: str, gap: int = 1 << 16, most: int = 1 << 23) -> DataFrame:
    """The chosen index rows as records; ``payload_bytes`` is null for revisits.

    The index is narrow, so tasks are dealt by the bytes it refers to: 16 MB of archive each.
    """
    places = index.select("file", "offset", "length")
    chosen = places.agg(F.sum("length")).first()[0] or 0
    placed = places.repartitionByRange(1 + chosen // READ_BYTES, F.col("file"), F.col("offset")).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_reader(folder, gap, most), READ)


def resolved(records: DataFrame) -> DataFrame:
    """Gives revisits the size of the response they refer to; its digest must agree."""
    answers = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(
        F.max("payload_bytes").alias("full_bytes")
    )
    own: Column = F.coalesce("payload_bytes", "full_bytes")
    return records.join(answers, ["refers_to", "payload_digest"], "left").select(
        "page_id", own.alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def archive_round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write all pages, read all records back, and say what the archives hold."""
    folder = new_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder, revisit_from)
    return resolved(write_table(read_archives(index, folder), "warc-read"))


ROUND_TRIP_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS least FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, ((k * 5) // 4 + 1)::INTEGER, 2))::INTEGER >> (3 - (k * 5) % 4)::INTEGER) & 31)::INTEGER + 1, 1
       )), '') AS payload_digest,
       CASE WHEN page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM g
"""
