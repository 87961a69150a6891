"""Vectorised words of Arrow text columns: places and 64-bit hashes, without a Python object per word.

Whole texts are read, in blocks of bounded size that end between words; a text longer than a block
is read in several.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def byte_table(is_word, fold: bool = True) -> np.ndarray:
    """256 bytes: 0 for separators, else the byte itself, A-Z lower-cased if ``fold``."""
    low = [b + 32 if fold and 65 <= b <= 90 else b for b in range(256)]
    return np.array([x if is_word(b) else 0 for b, x in enumerate(low)], np.uint8)


ALNUM = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
SPACED = byte_table(lambda b: b != 32 and not 9 <= b <= 13 and b != 0, fold=False)


@dataclass(frozen=True)
class Words:
    """Words of a batch in order: index of the text, byte places in ``data``, hash; ``bounds`` of texts."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    bounds: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.bounds) - 1)

    def first_of_text(self) -> np.ndarray:
        """For each text, the index of its first word; one more at the end."""
        return np.concatenate(([0], np.cumsum(self.per_text)))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 1)
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        for name, base in (("up", MULTIPLIER), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _block(data: np.ndarray, bounds: np.ndarray, lo: int, hi: int, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends and hashes of the words in data[lo:hi], which begins and ends between words."""
    mapped = table[data[lo:hi]]
    mask = mapped != 0
    cut = np.zeros(hi - lo + 1, bool)
    inside = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi, "right")] - lo
    cut[inside] = True
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    start = np.flatnonzero(mask & (~before | cut[:-1]))
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    end = np.flatnonzero(mask & (~after | cut[1:])) + 1
    up, down = _powers_to(hi - lo + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mapped * up[: hi - lo], dtype=np.uint64)))
    raw = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)
    return start + lo, end + lo, mixed(raw)


def _offsets(texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)


def words_of(texts: pa.Array, table: np.ndarray = ALNUM) -> Words:
    """Words of string or binary texts; nulls have none. Hashes are of the mapped bytes."""
    texts = texts.cast(pa.large_binary())
    offsets = _offsets(texts)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    parts, lo, total = [], 0, len(data)
    while lo < total:
        hi = min(lo + BLOCK, total)
        if hi < total:
            hi = _between_words(data, bounds, lo, hi, table)
        parts.append(_block(data, bounds, lo, hi, table))
        lo = hi
    start, end, hashes = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return Words(np.searchsorted(bounds, start, "right") - 1, start, end, hashes, data, bounds)


def _between_words(data: np.ndarray, bounds: np.ndarray, lo: int, hi: int, table: np.ndarray) -> int:
    """The last place in (lo, hi] that is not inside a word, else the first after it."""
    ends = bounds[(bounds > lo) & (bounds <= hi)]
    blank = np.flatnonzero(table[data[lo + 1 : hi]] == 0)
    best = max(int(ends[-1]) if len(ends) else 0, int(blank[-1]) + lo + 1 if len(blank) else 0)
    if best > lo:
        return best
    while hi < len(data):
        upto = min(hi + BLOCK, len(data))
        later = bounds[(bounds > hi) & (bounds <= upto)]
        blank = np.flatnonzero(table[data[hi:upto]] == 0)
        found = [int(x) for x in (later[:1], blank[:1] + hi) for x in x]
        if found:
            return min(found)
        hi = upto
    return len(data)


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text, one row at least."""
    texts = batch.column(column).cast(pa.large_binary())
    ends = _offsets(texts)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto
