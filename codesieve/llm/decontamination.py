"""Benchmark decontamination by winnowing.

Of every six neighbouring 5-word hashes the least is kept (the last of equal ones), on documents and
benchmark items alike. A span of ten shared words holds six such hashes, so both sides keep one in
the same place: no shared span of ten words is missed. Kept hashes are joined, and each meeting is
extended word by word to both sides; it counts if the common span has at least ten words. An item of
m < 10 words is one window, found by keeping every m-word hash of the documents.

Documents drop a hash at once if a bitmap of fixed size, filled from the benchmark's hashes, rules it
out; what the bitmap lets through by chance fails in the join. Words are compared by 64-bit hashes.

Null and empty texts have no words and are clean; items without words match nothing. Repeated rows of
documents each give a row, repeated items count once per item id. Null item ids are left out of the
list of items but their windows hit. Extra columns are ignored. Without items every document is clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, with_row_key, write_table
from .words import Words, mixed, slices, words_of

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
SIDE = SPAN - GRAM
BITS = 24
KEY = "__key"
CONTEXT = pa.list_(pa.int64())
CANDIDATE = pa.struct([("p", pa.int64()), ("fp", pa.int64()), ("ctx", CONTEXT)])
RADIX = np.uint64(0xD6E8FEB86659FD93)


def _grams(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``width`` words of one text begin, and a hash at every place (others are junk)."""
    n = len(words.hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * RADIX + words.hash[k : k + n]
    inside = words.text[:n] == words.text[width - 1 :]
    return np.flatnonzero(inside), mixed(total + np.uint64(width))


def winnowed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept 5-word hashes of all texts, and the hashes."""
    spans, _ = _grams(words, SPAN)
    _, hashes = _grams(words, GRAM)
    if not len(spans):
        return spans, np.zeros(0, np.uint64)
    best, place = hashes[spans], spans
    for k in range(1, WINDOW):
        value = hashes[spans + k]
        less = value <= best
        best, place = np.where(less, value, best), np.where(less, spans + k, place)
    kept = np.zeros(len(hashes), bool)
    kept[place] = True
    place = np.flatnonzero(kept)
    return place, hashes[place]


def _context(words: Words, place: np.ndarray, before: int, size: int, outside: int) -> np.ndarray:
    """Word hashes around each place, ``outside`` where the text has none."""
    at = place[:, None] - before + np.arange(size)
    safe = np.clip(at, 0, max(0, len(words.hash) - 1))
    same = (at == safe) & (words.text[safe] == words.text[place][:, None])
    return np.where(same, words.hash[safe], np.uint64(outside))


def _found(words: Words, widths: list[int], bitmap: np.ndarray | None, outside: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, hash, contexts) for full windows and for each short width."""
    for width in [SPAN, *widths]:
        if width == SPAN:
            place, fp = winnowed(words)
        else:
            place, fp = _grams(words, width)
            fp = fp[place]
        fp = mixed(fp ^ np.uint64(width))
        if bitmap is not None and len(fp):
            slot = (fp & np.uint64((1 << BITS) - 1)).astype(np.int64)
            keep = (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            place, fp = place[keep], fp[keep]
        if len(place):
            before, size = (SIDE, 2 * SIDE + GRAM) if width == SPAN else (0, width)
            yield place, fp, _context(words, place, before, size, outside)


def _lists(contexts: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate([np.full(len(c), c.shape[1]) for c in contexts])
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([c.ravel() for c in contexts]).view(np.int64)))


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's kept hashes: ten words and more winnowed, fewer as one window."""
    for batch in batches:
        for part in slices(batch, 1):
            words = words_of(part.column(1))
            count = words.per_text
            found = []
            for width in range(1, SPAN + 1):
                fits = (count >= SPAN) if width == SPAN else (count == width)
                if not fits.any():
                    continue
                for place, fp, ctx in _found(words, [] if width == SPAN else [width], None, 1):
                    if ctx.shape[1] == (2 * SIDE + GRAM if width == SPAN else width):
                        mine = fits[words.text[place]]
                        found.append((words.text[place][mine], fp[mine], ctx[mine]))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.concatenate([f[0] for f in found]))),
                     pa.array(np.concatenate([f[1] for f in found]).view(np.int64)), _lists([f[2] for f in found])],
                    names=["item_id", "fp", "ctx"],
                )


def _document_rows(widths: list[int], bitmap: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words = words_of(part.column(1))
                first = words.first_of_text()
                found = list(_found(words, widths, bitmap, 0))
                texts = len(part)
                if found:
                    place = np.concatenate([f[0] for f in found])
                    text = words.text[place]
                    order = np.argsort(text, kind="stable")
                    values = pa.StructArray.from_arrays(
                        [pa.array(place - first[text]), pa.array(np.concatenate([f[1] for f in found]).view(np.int64)), _lists([f[2] for f in found])],
                        fields=list(CANDIDATE),
                    ).take(pa.array(order))
                    sizes = np.bincount(text, minlength=texts)
                else:
                    values, sizes = pa.array([], CANDIDATE), np.zeros(texts, np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words.per_text.astype(np.int64)), pa.ListArray.from_arrays(offsets, values)],
                    names=[KEY, "n_words", "found"],
                )

    return rows


def _bitmap(items: DataFrame) -> np.ndarray:
    """2 MB that say which hash slots the benchmark uses, whatever its size."""
    slot = F.col("fp").bitwiseAND(F.lit((1 << BITS) - 1))
    rows = (
        items.select(F.shiftright(slot, 3).alias("byte"), F.expr(f"1L << cast(fp & 7 AS int)").alias("bit"))
        .groupBy("byte").agg(F.bit_or("bit").alias("bits")).collect()
    )
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    for row in rows:
        bitmap[row["byte"]] = row["bits"]
    return bitmap


def _run(equal: Column) -> Column:
    """How many leading entries are true."""
    at = F.array_position(equal, False)
    return F.when(at == 0, F.size(equal)).otherwise(at - 1)


def matched(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of each document, n_words, n_hit, n_items, items_sha256, contaminated."""
    texts = items.select("item_id", F.col("text").cast("string").alias("text"))
    kind = items.select("item_id").schema[0].dataType.simpleString()
    prints = write_table(texts.mapInArrow(_item_rows, f"item_id {kind}, fp long, ctx array<long>"), "item-prints")
    size = F.size("ctx")
    widths = sorted(r[0] for r in prints.select(size.alias("n")).where(size < SPAN).distinct().collect())
    classes = write_table(
        prints.select("fp", "ctx").distinct().withColumn("window", F.monotonically_increasing_id()), "item-windows"
    )
    members = prints.join(classes, ["fp", "ctx"]).select("window", "item_id").distinct()

    key = F.struct(*keep).alias(KEY)
    source = docs.select(key, F.col("text").cast("string").alias("text"))
    schema = (
        f"{KEY} {source.schema[0].dataType.simpleString()}, n_words long, "
        "found array<struct<p:long,fp:long,ctx:array<long>>>"
    )
    scanned = source.mapInArrow(_document_rows(widths, _bitmap(prints)), schema)
    scanned = write_table(scanned.withColumn("doc", F.monotonically_increasing_id()), "document-prints")

    met = scanned.select("doc", F.explode("found").alias("f")).select("doc", "f.p", "f.fp", F.col("f.ctx").alias("own"))
    met = met.join(classes, "fp").where(F.size("own") == F.size("ctx"))
    equal = met.withColumn("equal", F.zip_with("own", "ctx", lambda x, y: x == y))
    left, right = _run(F.reverse(F.slice("equal", 1, SIDE))), _run(F.slice("equal", SIDE + GRAM + 1, SIDE))
    full = F.size("equal") > SPAN
    core = F.forall(F.when(full, F.slice("equal", SIDE + 1, GRAM)).otherwise(F.col("equal")), lambda x: x)
    spans = equal.where(core).select(
        "doc", "window",
        F.when(full, F.col("p") - left).otherwise(F.col("p")).alias("start"),
        F.when(full, F.col("p") + GRAM + right).otherwise(F.col("p") + F.size("equal")).alias("end"), full.alias("full"),
    ).where(~F.col("full") | (F.col("end") - F.col("start") >= SPAN))
    hits = write_table(spans.select("doc", "window", "start", "end"), "hits")

    places = hits.select("doc", "start", "end").distinct().select("doc", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("at"))
    n_hit = places.distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    of_doc = hits.select("doc", "window").distinct().join(members, "window").where("item_id IS NOT NULL")
    listed = of_doc.select("doc", F.col("item_id").cast("string").alias("item_id")).distinct().groupBy("doc").agg(
        F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("items")
    )
    facts = scanned.select("doc", KEY, "n_words").join(n_hit, "doc", "left").join(listed, "doc", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return facts.select(
        f"{KEY}.*", "n_words", count("n_hit"), count("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any hit, all columns."""
    keyed = with_row_key(docs)
    flagged = matched(keyed, items, (ROW,)).where("contaminated").select(ROW)
    return keyed.join(flagged, ROW, "left_anti").drop(ROW)


MATCHED_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, width, array_to_string(words[s : s + width - 1], ' ') AS gram
  FROM (SELECT item_id, words, least(len(words), 10) AS width, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS s
        FROM i WHERE len(words) > 0)
), dw AS (
  SELECT doc_id, s, width, array_to_string(words[s : s + width - 1], ' ') AS gram
  FROM (SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS s
        FROM d, (SELECT DISTINCT width FROM iw) WHERE len(words) >= width)
), h AS (SELECT doc_id, s, width, item_id FROM dw JOIN iw USING (width, gram)),
n AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + width)) AS place FROM (SELECT DISTINCT doc_id, s, width FROM h)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
