"""Texts cut into pieces that tokenizers treat alone, so each different piece is encoded once.

A piece starts at a single blank between two characters that are no white space. The pattern of byte-level
vocabularies starts a word there, and no entry of a piece vocabulary has a blank after another character, so
no merge crosses such a place: the tokens of a text are the tokens of its pieces, one after the other. Blanks
next to characters that might be white space outside ASCII are left inside a piece, which is always right.
Byte-level vocabularies end words at single line ends and at marks after letters, too.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from types import ModuleType
from typing import TypeVar

import numpy as np
import pyarrow as pa

from .words import mixed

BLANK, LINE_END = 32, 10
# First bytes of characters beyond ASCII that may be white space or stand for a blank.
DOUBTFUL_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)


# Bytes of pieces encoded as one text.
JOINED = 1 << 11
# Pieces whose tokens a worker remembers; others are encoded again. More where it holds one encoder only.
KNOWN = 1 << 18
KNOWN_ALONE = 1 << 20
# Bytes of a remembered piece's key: the piece, zeros, and its size in the last byte. Longer pieces are not remembered.
KEY = 32
Encode = Callable[[str], list[int]]
Made = TypeVar("Made")


def once_per_worker(key: str, make: Callable[[], Made]) -> Made:
    """One value for all tasks of a worker process; functions of this package come anew with every task."""
    held = sys.modules.setdefault("__codesieve_worker__", ModuleType("__codesieve_worker__")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


@dataclass(frozen=True)
class Pieces:
    """``code`` of each piece in order, the number of pieces of each text, and the different pieces."""

    code: np.ndarray
    per_text: np.ndarray
    different: pa.LargeBinaryArray

    @property
    def text(self) -> np.ndarray:
        """The text of each piece."""
        return np.repeat(np.arange(len(self.per_text)), self.per_text)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large binary texts and the bounds of each in them."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _plain(x: np.ndarray) -> np.ndarray:
    """Characters of one byte that are no white space."""
    return (x > BLANK) & (x < 127)


def _ends_plain(last: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether a character that is no white space ends here: of one byte, or of two that begin with no doubtful one."""
    return _plain(last) | ((last >= 128) & (second > DOUBTFUL_LEADS[0]) & (second < 0xE0))


def _starts_plain(x: np.ndarray) -> np.ndarray:
    return _plain(x) | ((x >= 0xC0) & ~np.isin(x, DOUBTFUL_LEADS))


def _mark_cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places of marks after letters: byte-level vocabularies end a word there. A bar may be inside a special token."""
    kind = np.zeros(256, np.uint8)
    kind[[*range(65, 91), *range(97, 123)]] = 1
    kind[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "|"]] = 2
    kinds = kind[data]
    at = np.flatnonzero((kinds[:-1] == 1) & (kinds[1:] == 2)) + 1
    return at[~begins[at]]


def _cuts(data: np.ndarray, bounds: np.ndarray, at_lines: bool) -> np.ndarray:
    """Places of single blanks, with ``at_lines`` of single line ends too, at which a text may be cut."""
    inner = (data == BLANK) | (data == LINE_END) if at_lines else data == BLANK
    inner[bounds[:-1][bounds[:-1] < len(data)]] = False
    inner[bounds[1:][bounds[1:] > 0] - 1] = False
    at = np.flatnonzero(inner)
    return at[_ends_plain(data[at - 1], data[np.maximum(at - 2, 0)]) & _starts_plain(data[at + 1])]


def cut(texts: pa.Array, at_marks: bool = False) -> Pieces:
    """Pieces of large binary texts without nulls; an empty text has none.

    ``at_marks`` cuts words and marks apart and cuts at line ends, too, which holds for byte-level vocabularies only.
    """
    data, bounds = bytes_of(texts)
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds] = True
    begins[_cuts(data, bounds, at_marks)] = True
    if at_marks and len(data):
        begins[_mark_cuts(data, begins)] = True
    starts = np.flatnonzero(begins[: len(data)])
    offsets = np.append(starts, len(data)).astype(np.int64)
    whole = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )
    coded = whole.dictionary_encode()
    per_text = np.diff(np.searchsorted(starts, bounds))
    return Pieces(coded.indices.to_numpy(), per_text, coded.dictionary)


def flat_take(values: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Runs of ``values`` (run i ends before ``ends[i]``) one after the other, in the given order of runs."""
    if not len(order):
        return values[:0]
    starts = np.where(order > 0, ends[order - 1], 0)
    sizes = ends[order] - starts
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]


def sums_of(numbers: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Sum of the numbers of each text's pieces."""
    sums = np.concatenate(([0], np.cumsum(numbers))).astype(np.int64)
    ends = np.cumsum(per_text)
    return sums[ends] - sums[ends - per_text]


def byte_tokenizer(path: str, plain_specials: bool):
    """A tokenizer of the tokenizers library; with ``plain_specials`` special tokens in texts are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_specials
    return tokenizer


def byte_encode(tokenizer) -> Encode:
    return lambda text: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


def token_sizes(tokenizer) -> np.ndarray:
    """Bytes of each token of a byte-level vocabulary, whose letters stand for one byte each."""
    special = {i: len(t.content.encode()) for i, t in tokenizer.get_added_tokens_decoder().items()}
    sizes = {i: special.get(i, len(entry)) for entry, i in tokenizer.get_vocab().items()}
    table = np.zeros(max(sizes) + 1, np.int64)
    table[list(sizes)] = list(sizes.values())
    return table


def _one_by_one(encode: Encode, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of each piece); bytes that are no UTF-8 become replacement characters."""
    ids = [encode(p.decode("utf-8", "replace")) for p in pieces.to_pylist()]
    counts = np.array([len(x) for x in ids], np.int64)
    return np.fromiter((i for x in ids for i in x), np.int32, int(counts.sum())), counts


def _joined(encode: Encode, sizes: np.ndarray, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The same for pieces that may follow each other in a text, many at a time.

    The bytes of the tokens say which of them belong to which piece. Where they do not, a text's pieces are
    encoded one by one.
    """
    data, bounds = bytes_of(pieces)
    edges = np.unique(np.append(np.searchsorted(bounds, np.arange(0, len(data), JOINED)), len(bounds) - 1))
    found = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
    for lo, hi in zip(edges[:-1], edges[1:]):
        try:
            ids = np.array(encode(data[bounds[lo] : bounds[hi]].tobytes().decode()), np.int32)
        except UnicodeDecodeError:
            ids = np.zeros(0, np.int32)
        ends = np.concatenate(([0], np.cumsum(sizes[ids])))
        own = bounds[lo : hi + 1] - bounds[lo]
        at = np.minimum(np.searchsorted(ends, own), len(ends) - 1)
        fits = np.array_equal(ends[at], own) and at[-1] == len(ids)
        found.append((ids, np.diff(at)) if fits else _one_by_one(encode, pieces.slice(lo, hi - lo)))
    ids, counts = (np.concatenate(x) for x in zip(*found))
    return ids, counts


def piece_tokens(
    encode: Encode, sizes: np.ndarray, pieces: pa.LargeBinaryArray, at_lines: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, one after the other, and how many each has; ``sizes`` has the bytes of each id.

    ``at_lines`` says that the vocabulary ends words at single line ends.
    """
    data, bounds = bytes_of(pieces)
    if not len(pieces):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    first, last = bounds[:-1], bounds[1:] - 1
    near = lambda x: data[np.minimum(np.maximum(x, 0), len(data) - 1)]
    led = (near(first) == BLANK) | at_lines & (near(first) == LINE_END)
    regular = (last > first) & led & _starts_plain(near(first + 1)) & _ends_plain(near(last), near(last - 1))
    ids, counts = (
        np.concatenate(x) for x in zip(
            _joined(encode, sizes, pieces.filter(pa.array(regular))), _one_by_one(encode, pieces.filter(pa.array(~regular)))
        )
    )
    place = np.empty(len(pieces), np.int64)
    place[regular], place[~regular] = np.arange(regular.sum()), regular.sum() + np.arange((~regular).sum())
    return flat_take(ids, np.cumsum(counts), place), counts[place]


def _keys(pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key of each piece as a row of numbers, a hash of it, and whether the piece fits its key."""
    data, bounds = bytes_of(pieces)
    sizes = np.diff(bounds)
    padded = np.concatenate((data, np.zeros(KEY, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, KEY)[bounds[:-1]]
    rows[np.arange(KEY) >= sizes[:, None]] = 0
    rows[:, -1] = np.minimum(sizes, KEY)
    keys, hashes = rows.view(np.uint64), np.zeros(len(pieces), np.uint64)
    for column in keys.T:
        hashes = mixed(hashes ^ column)
    return keys, hashes, sizes < KEY


@dataclass
class Encoder:
    """An encoding, the bytes of its ids, and the tokens of the first pieces it met, ``known`` (else ``KNOWN``) at most.

    ``keys`` and ``ends`` (of each piece's run in ``ids``) are in the order met; ``hashes`` are sorted, with the
    ``place`` of each. A piece is known by its key, the hash only finds it.
    """

    encode: Encode
    sizes: np.ndarray
    at_lines: bool = False
    known: int | None = None
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    keys: np.ndarray = field(default_factory=lambda: np.zeros((0, KEY // 8), np.uint64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def _known(self, keys: np.ndarray, hashes: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """Where each piece is remembered, or -1."""
        if not len(self.place):
            return np.full(len(keys), -1, np.int64)
        order, found = np.argsort(hashes), np.empty(len(hashes), np.int64)
        found[order] = np.searchsorted(self.hashes, hashes[order])
        at = self.place[np.minimum(found, len(self.place) - 1)].astype(np.int64)
        return np.where(fits & (self.keys[at] == keys).all(axis=1), at, -1)

    def _remember(self, keys: np.ndarray, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.place = np.insert(self.place, at, len(self.ends) + order)
        self.keys = np.concatenate((self.keys, keys))
        self.ends = np.concatenate((self.ends, len(self.ids) + np.cumsum(counts)))
        self.ids = np.concatenate((self.ids, ids))

    def tokens(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, one after the other, and how many each has."""
        keys, hashes, fits = _keys(pieces)
        at = self._known(keys, hashes, fits)
        fresh = np.flatnonzero(at < 0)
        ids, counts = piece_tokens(self.encode, self.sizes, pieces.take(pa.array(fresh)), self.at_lines)
        at[fresh] = len(self.ends) + np.arange(len(fresh))
        flat, ends = np.concatenate((self.ids, ids)), np.concatenate((self.ends, len(self.ids) + np.cumsum(counts)))
        most = KNOWN if self.known is None else self.known
        kept = np.flatnonzero(fits[fresh])[: max(0, most - len(self.ends))]
        if len(kept):
            self._remember(keys[fresh[kept]], hashes[fresh[kept]], flat_take(ids, np.cumsum(counts), kept), counts[kept])
        return flat_take(flat, ends, at), ends[at] - np.where(at > 0, ends[at - 1], 0)


def byte_encoder(path: str, plain_specials: bool) -> Encoder:
    """The encoder of a byte-level vocabulary, kept by the worker."""

    def make() -> Encoder:
        tokenizer = byte_tokenizer(path, plain_specials)
        return Encoder(byte_encode(tokenizer), token_sizes(tokenizer), at_lines=True, known=KNOWN_ALONE)

    return once_per_worker(f"{path} {plain_specials}", make)
