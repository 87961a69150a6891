"""Alignment of two tokenizers: which tokens of both stand for the same bytes, and how often corpus-wide.

The tokens of a text by both tokenizers are cut into groups where both end at the same byte; a pair of tokens
is linked where it shares a group. The documents that hold a pair are counted by external spilling:

1. A task writes its (pair, document) records as sorted runs of bounded size, compressed with zstd. A run
   counts its documents per pair, and deals these counts by a radix of the first token to one block each.
2. For each radix the blocks are merged by a k-way heap, at most ``FAN_IN`` at a time; a further round merges
   the results of the round before. Keys have the first token on the major side, so the last merge knows the
   highest count of a token as soon as its last pair is through.
3. Totals stream back: next to its own blocks, each run gets the totals of its pairs, and sums them up per
   document from its records.

A pair that every document holds is one record per run, and no step holds more than a run, the pairs of a
radix, or a bounded number of blocks. All steps are written tables in the shared folder.

Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens: zeros
and an empty string. Repeated rows and rows with equal or no ids are documents of their own. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import write_table
from .pieces import Encode, Encoder, Pieces, byte_encode, byte_tokenizer, bytes_of, cut, flat_take, once_per_worker, sums_of
from .words import slices

RUN_BYTES = 4 << 20
RADICES = 128
FAN_IN = 256
SIDE = 32
# Links up to which a group's pairs are listed before equal ones are added up.
SMALL_GROUP = 64
# How a piece vocabulary writes a blank, and a single byte.
PIECE_BLANK = "▁"


def byte_letters() -> dict[str, int]:
    """Letter to byte of byte-level vocabularies: printable bytes stand for themselves, others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def letter_bytes(entry: str, letters: dict[str, int]) -> bytes | None:
    """The bytes of an entry of a byte-level vocabulary; None for entries that are no such text."""
    return bytes(letters[c] for c in entry) if all(c in letters for c in entry) else None


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(PIECE_BLANK, " ").encode()


@dataclass(frozen=True)
class Side:
    """One tokenizer, and the bytes of each id, one after the other."""

    encoder: Encoder
    data: np.ndarray

    @classmethod
    def of(cls, encode: Encode, tokens: list[bytes]) -> "Side":
        sizes = np.array([len(t) for t in tokens], np.int64)
        return cls(Encoder(encode, sizes), np.frombuffer(b"".join(tokens), np.uint8))

    @property
    def sizes(self) -> np.ndarray:
        return self.encoder.sizes

    def tokens(self, pieces: pa.LargeBinaryArray, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number per piece, pieces whose tokens give back their bytes)."""
        ids, counts = self.encoder.tokens(pieces)
        good = sums_of(self.sizes[ids], counts) == np.diff(bounds)
        place = np.flatnonzero(good)
        shown = flat_take(self.data, np.cumsum(self.sizes), flat_take(ids, np.cumsum(counts), place))
        wrong = np.flatnonzero(shown != flat_take(data, bounds[1:], place))
        good[place[np.searchsorted(np.cumsum(np.diff(bounds)[place]), wrong, "right")]] = False
        return ids, counts, good


def both_sides(a_path: str, b_path: str) -> tuple[Side, Side]:
    """Side A by a byte-level vocabulary, side B by a piece vocabulary, which adds the blank a text starts with.

    Special tokens in texts are plain text; as tokens they have no bytes.
    """
    from sentencepiece import SentencePieceProcessor

    a, b = byte_tokenizer(a_path, True), SentencePieceProcessor(model_file=b_path)
    letters = byte_letters()
    by_id = {i: letter_bytes(entry, letters) or b"" for entry, i in a.get_vocab().items()}
    return (
        Side.of(byte_encode(a), [by_id.get(i, b"") for i in range(max(by_id) + 1)]),
        Side.of(lambda text: b.encode(text[1:]), [piece_bytes(b.id_to_piece(i)) for i in range(b.get_piece_size())]),
    )


@dataclass(frozen=True)
class Alignment:
    """Per piece: text of its groups, (n_a, n_b, n_groups, n_links), and its linked pairs with their links."""

    good: np.ndarray
    shown: pa.Array
    numbers: np.ndarray
    pair_ends: np.ndarray
    pair_keys: np.ndarray
    pair_links: np.ndarray


def _linked(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, groups: int) -> tuple[np.ndarray, ...]:
    """(group, key, links) of the pairs in all groups; equal pairs of small groups may come more than once."""
    per_a, per_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
    start_a, start_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
    small = per_a * per_b <= SMALL_GROUP
    left = np.flatnonzero(small[of_a])
    times = per_b[of_a[left]]
    group = np.repeat(of_a[left], times)
    right = start_b[group] + np.arange(len(group)) - np.repeat(np.cumsum(times) - times, times)
    found = [(group, np.repeat(a[left], times).astype(np.int64) << SIDE | b[right], np.ones(len(group), np.int64))]
    # In a large group equal tokens are counted first, so its pairs are different ones.
    for g in np.flatnonzero(~small).tolist():
        x, n = np.unique(a[start_a[g] : start_a[g] + per_a[g]], return_counts=True)
        y, m = np.unique(b[start_b[g] : start_b[g] + per_b[g]], return_counts=True)
        keys = (x.astype(np.int64)[:, None] << SIDE | y[None, :]).ravel()
        found.append((np.full(len(keys), g), keys, (n[:, None] * m[None, :]).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found))


def align(sides: tuple[Side, Side], pieces: pa.LargeBinaryArray) -> Alignment:
    """All pieces at once: groups end at bytes where tokens of both sides end."""
    data, bounds = bytes_of(pieces)
    (a, n_a, good_a), (b, n_b, good_b) = (side.tokens(pieces, data, bounds) for side in sides)
    good = good_a & good_b
    kept = np.flatnonzero(good)
    a, b = flat_take(a, np.cumsum(n_a), kept), flat_take(b, np.cumsum(n_b), kept)
    n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
    a_ends, b_ends = np.cumsum(sides[0].sizes[a]), np.cumsum(sides[1].sizes[b])
    ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
    of_a, of_b = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
    of_piece = kept[np.searchsorted(np.cumsum(np.diff(bounds)[kept]), ends)]
    per_a, per_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
    n_groups = np.bincount(of_piece, minlength=len(pieces))
    n_links = np.zeros(len(pieces), np.int64)
    np.add.at(n_links, of_piece, per_a * per_b)

    def joined(parts: pa.Array, sizes: np.ndarray, by: str) -> pa.Array:
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, parts), by)

    texts = [joined(pa.array(ids).cast(pa.string()), sizes, ",") for ids, sizes in ((a, per_a), (b, per_b))]
    shown = joined(pc.binary_join_element_wise(*texts, "|"), n_groups, ";")
    group, keys, links = _linked(a, b, of_a, of_b, len(ends))
    piece = of_piece[group]
    order = np.lexsort((keys, piece))
    piece, keys, links = piece[order], keys[order], links[order]
    first = np.ones(len(keys), bool)
    first[1:] = (piece[1:] != piece[:-1]) | (keys[1:] != keys[:-1])
    starts = np.flatnonzero(first)
    summed = np.add.reduceat(links, starts) if len(starts) else links
    pair_ends = np.searchsorted(piece[starts], np.arange(len(pieces)), "right")
    return Alignment(good, shown, np.stack([n_a, n_b, n_groups, n_links], 1), pair_ends, keys[starts], summed)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers as one compressed block; the first is ascending and kept as differences."""
    head = np.diff(arrays[0], prepend=np.zeros(1, arrays[0].dtype))
    return zstandard.compress(b"".join(np.ascontiguousarray(x, "<i8").tobytes() for x in (head, *arrays[1:])), 1)


def _unpacked(block: bytes, width: int) -> list[np.ndarray]:
    arrays = np.frombuffer(zstandard.decompress(block), "<i8").reshape(width, -1)
    return [np.cumsum(arrays[0]), *arrays[1:]]


def _radix(keys: np.ndarray) -> np.ndarray:
    """Radix of the first token of each key, spread so that neighbouring tokens part."""
    return ((keys >> SIDE) * 0x9E3779B1 >> 7) % RADICES


def _run_records(pieces: Pieces, found: Alignment, good: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair keys by radix, documents of each, and records: document, place of the pair, links)."""
    width = max(len(pieces.different), 1)
    seen, times = np.unique(pieces.text * width + pieces.code, return_counts=True)
    text, code = seen // width, seen % width
    text, code, times = (x[good[text]] for x in (text, code, times))
    per_piece = np.diff(found.pair_ends, prepend=0)[code]
    keys = flat_take(found.pair_keys, found.pair_ends, code)
    links = flat_take(found.pair_links, found.pair_ends, code) * np.repeat(times, per_piece)
    different, place = np.unique(keys, return_inverse=True)
    by_radix = np.lexsort((different, _radix(different)))
    rank = np.empty(len(by_radix), np.int64)
    rank[by_radix] = np.arange(len(by_radix))
    # One record per document and pair, in the order of the pairs.
    record, at = np.unique(rank[place] * max(len(good), 1) + np.repeat(text, per_piece), return_inverse=True)
    total = np.zeros(len(record), np.int64)
    np.add.at(total, at, links)
    documents, where = record % max(len(good), 1), record // max(len(good), 1)
    return different[by_radix], np.bincount(where, minlength=len(different)), documents, where, total


def _spiller(a_path: str, b_path: str, schema: pa.Schema):
    """Documents (doc_id, text) to runs: a row with documents and records, and a row per radix with counts."""

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = once_per_worker(f"{a_path} {b_path}", lambda: both_sides(a_path, b_path))
        run = TaskContext.get().partitionId() << 24
        for batch in (piece for whole in batches for piece in slices(whole, 1, RUN_BYTES)):
            texts = batch.column(1).cast(pa.large_binary())
            lengths = pc.binary_length(texts).to_numpy()
            led = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts, pa.scalar(b"", pa.large_binary()))
            pieces = cut(led)
            found = align(sides, pieces.different)
            good = (lengths > 0) & (sums_of((~found.good[pieces.code]).astype(np.int64), pieces.per_text) == 0)
            per_text = [np.where(good, sums_of(found.numbers[pieces.code, k], pieces.per_text), 0) for k in range(4)]
            shown = found.shown.take(pa.array(pieces.code))
            bounds = pa.array(np.concatenate(([0], np.cumsum(pieces.per_text))), pa.int32())
            lines = pc.binary_join(pa.ListArray.from_arrays(bounds, shown), ";").to_pylist() if len(batch) else []
            sums = [hashlib.sha256(s.encode()).hexdigest() if g else "" for s, g in zip(lines, good.tolist())]
            keys, holders, documents, where, links = _run_records(pieces, found, good)
            docs = pa.StructArray.from_arrays(
                [batch.column(0), *map(pa.array, per_text), pa.array(sums, pa.string())], fields=list(schema.field("docs").type.value_type)
            )
            rows = {name: [] for name in schema.names}

            def add(**given) -> None:
                for name in schema.names:
                    rows[name].append(given.get(name))

            add(run=run, radix=-1, records=_packed(where, documents, links))
            edges = np.searchsorted(_radix(keys), np.arange(RADICES + 1))
            for radix, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
                if hi > lo:
                    add(run=run, radix=radix, counts=_packed(keys[lo:hi], holders[lo:hi]))
            n = len(rows["run"])
            lists = pa.ListArray.from_arrays(pa.array([0] + [len(docs)] * n, pa.int32()), docs).cast(schema.field("docs").type)
            columns = [lists if f.name == "docs" else pa.array(rows[f.name], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            run += 1

    return spill


def _merged(blocks: list[bytes]) -> Iterator[tuple[int, int]]:
    """Keys in ascending order with the sum of their counts, by a heap over all blocks."""
    cursors = [zip(*(x.tolist() for x in _unpacked(block, 2))) for block in blocks]
    for key, same in groupby(heapq.merge(*cursors), key=itemgetter(0)):
        yield key, sum(n for _, n in same)


def _merge_level(last: bool):
    """Blocks of one radix and group to one block; the last level adds which pairs are their first token's best."""

    def merge(table: pa.Table) -> pa.Table:
        keys, counts, best = [], [], []
        for _, pairs in groupby(_merged(table["counts"].to_pylist()), key=lambda x: x[0] >> SIDE):
            pairs = list(pairs)
            highest = max(n for _, n in pairs)
            for key, n in pairs:
                keys.append(key)
                counts.append(n)
                best.append(n == highest)
        arrays = [np.array(x, np.int64) for x in ((keys, counts, best) if last else (keys, counts))]
        return pa.table({
            "radix": table["radix"][:1], "run": pa.array(table["group"][:1].to_pylist(), pa.int64()),
            "counts": pa.array([_packed(*arrays)], pa.binary()),
        })

    return merge


def pair_totals(blocks: DataFrame, runs: int) -> DataFrame:
    """(radix, totals): all pairs of a radix with the number of their documents, and whether it is the best.

    ``blocks`` has (radix, run, counts) of at most ``runs`` runs.
    """
    while True:
        groups = -(-runs // FAN_IN)
        dealt = blocks.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)))
        merged = dealt.groupBy("radix", "group").applyInArrow(_merge_level(groups == 1), "radix int, run long, counts binary")
        blocks = write_table(merged, "align-totals" if groups == 1 else "align-merged")
        if groups == 1:
            return blocks.select("radix", F.col("counts").alias("totals"))
        runs = groups


def _answers(own: pa.Table, totals: pa.Table) -> pa.Table:
    """Blocks of runs to the totals of their pairs, block by block."""
    out = []
    if len(own) and len(totals):
        keys, counts, best = _unpacked(totals["totals"][0].as_py(), 3)
        for run, block in zip(own["run"].to_pylist(), own["counts"]):
            at = np.searchsorted(keys, _unpacked(block.as_py(), 2)[0])
            out.append((run, zstandard.compress(np.stack([counts[at], best[at]]).astype("<i8").tobytes(), 1)))
    radix = own["radix"].to_pylist()[: len(out)]
    return pa.table({
        "run": pa.array([r for r, _ in out], pa.int64()), "radix": pa.array(radix, pa.int32()), "answer": pa.array([b for _, b in out], pa.binary())
    })


def _gatherer(schema: pa.Schema):
    """A run and its answers to its documents with the sums over their links."""

    def gather(runs: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("radix")
        parts = [np.frombuffer(zstandard.decompress(x.as_py()), "<i8").reshape(2, -1) for x in answers["answer"]]
        counts, best = np.concatenate(parts, 1) if parts else np.zeros((2, 0), np.int64)
        where, documents, links = _unpacked(runs["records"][0].as_py(), 3)
        docs = runs["docs"].combine_chunks().values
        sums = [np.zeros(len(docs), np.int64) for _ in range(2)]
        for total, factor in zip(sums, (best, counts)):
            np.add.at(total, documents, links * factor[where])
        return pa.Table.from_arrays([*docs.flatten(), *map(pa.array, sums)], schema=schema)

    return gather


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    long = T.LongType()
    own = [T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(c, long) for c in ("n_a", "n_b", "n_groups", "n_links")],
           T.StructField("groups_sha256", T.StringType())]
    spilled = T.StructType([
        T.StructField("run", long), T.StructField("radix", T.IntegerType()), T.StructField("docs", T.ArrayType(T.StructType(own))),
        T.StructField("records", T.BinaryType()), T.StructField("counts", T.BinaryType()),
    ])
    runs = write_table(rows.mapInArrow(_spiller(a_path, b_path, to_arrow_schema(spilled)), spilled), "align-runs")
    blocks = runs.where("radix >= 0").select("radix", "run", "counts")
    heads = runs.where("radix < 0").select("run", "docs", "records")
    number = heads.count()
    totals = pair_totals(blocks, number)
    # Groups bound how many blocks meet in one task; each of them gets the totals of its radix.
    groups = max(1, -(-number // FAN_IN))
    near = blocks.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("long"))
    spread = totals.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    answers = near.groupBy("radix", "group").cogroup(spread.groupBy("radix", "group")).applyInArrow(
        _answers, "run long, radix int, answer binary"
    )
    done = T.StructType([*own, T.StructField("n_best", long), T.StructField("count_sum", long)])
    return heads.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_gatherer(to_arrow_schema(done)), done)
