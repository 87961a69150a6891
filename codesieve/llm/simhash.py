"""Near-duplicates by SimHash: fingerprints, and a self-join of their binary trie.

A fingerprint is one 64-bit number per text. Equal fingerprints are joined by grouping. Different
ones meet in a trie over their bits: two nodes of equal depth are visited together, the bits in which
their prefixes differ are added up, and a pair is dropped once it exceeds the budget. The top of the
trie is cut into leaves of bounded size; a pair of leaves within the budget is one group of a Spark
job, and below it the traversal runs over sorted arrays. A group returns a spanning forest of its
links, never all pairs; the forests are joined by connected components.

Null and empty texts, and texts of blanks, have no words: fingerprint zero, linked like any other.
Repeated rows are linked like copies. A null id never is a component's id unless all ids in it are
null; ids may be structs, which are ordered field by field, nulls first. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, join_counted, with_row_key, write_table
from .components import components

SEED = 42
BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
LEAST_LEAF, MOST_LEAF, LEAVES = 1 << 8, 1 << 18, 64
DEALT = 100_000


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits of the hashes of all shingles of blank-separated words, A-Z folded."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[width - 1 :].tolist())
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    counts = [np.bincount(column, minlength=256) for column in hashes.view(np.uint8).reshape(n, 8).T]
    over = (np.stack(counts) @ BITS_OF_BYTE).ravel() * 2 > n
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of each row; ``fp`` holds the 64 bits as a long."""

    def of(texts: pa.Array) -> pa.Array:
        values = [0 if t is None else fingerprint(t, shingle) for t in texts.cast(pa.large_binary()).to_pylist()]
        return pa.array(np.array(values, np.uint64).view(np.int64))

    print_of = F.arrow_udf(of, "long")
    return docs.select(F.col(id_column).alias("id"), print_of(F.col(text_column).cast("string")).alias("fp"))


def _prefixes(prints: DataFrame, depth: int, below: list[int], shift: int) -> dict[int, int]:
    """Number of fingerprints under each prefix of ``depth`` bits; ``below`` names heavier prefixes."""
    prefix = F.shiftrightunsigned("fp", 64 - depth)
    if shift:
        prints = prints.where(F.shiftrightunsigned("fp", 64 - depth + shift).isin(below))
    rows = prints.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).collect()
    return {r["prefix"]: r["n"] for r in rows}


def trie_leaves(prints: DataFrame, leaf_size: int, step: int = 12) -> list[tuple[int, int]]:
    """Leaves (first fingerprint, depth) that tile the trie, each of ``leaf_size`` at most.

    Only counts reach the driver: at most 2 ** step of them, and as many for each prefix that is
    still too large, of which there are no more than fingerprints / leaf_size.
    """
    leaves: list[tuple[int, int]] = []

    def cut(prefix: int, depth: int, counts: dict[int, int], bottom: int, heavy: list[int]) -> None:
        low, high = prefix << (bottom - depth), (prefix + 1) << (bottom - depth)
        inside = {p: n for p, n in counts.items() if low <= p < high}
        if sum(inside.values()) <= leaf_size:
            leaves.append((prefix << (64 - depth), depth))
        elif depth == bottom:
            heavy.append(prefix)
        else:
            cut(2 * prefix, depth + 1, inside, bottom, heavy)
            cut(2 * prefix + 1, depth + 1, inside, bottom, heavy)

    roots, depth = [0], 0
    while roots:
        bottom = min(64, depth + step)
        counts = _prefixes(prints, bottom, roots, bottom - depth if depth else 0)
        heavy: list[int] = []
        for root in roots:
            cut(root, depth, counts, bottom, heavy)
        roots, depth = heavy, bottom
    return sorted(leaves)


def _dealer(leaves: list[tuple[int, int]], budget: int):
    """Sends every fingerprint to each pair of leaves within the budget that its leaf is part of."""
    starts = np.array([s for s, _ in leaves], np.uint64)
    depths = np.array([d for _, d in leaves], np.uint64)

    def partners(leaf: int) -> np.ndarray:
        common = np.minimum(depths, depths[leaf])
        differing = np.where(common > 0, (starts ^ starts[leaf]) >> (np.uint64(64) - np.maximum(common, np.uint64(1))), np.uint64(0))
        return np.flatnonzero(np.bitwise_count(differing) <= budget)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own = np.searchsorted(starts, prints, "right") - 1
            for leaf in np.unique(own).tolist():
                if leaf not in known:
                    known[leaf] = partners(leaf)
                mine, others = prints[own == leaf], known[leaf]
                pair = np.minimum(others, leaf) * len(leaves) + np.maximum(others, leaf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(pair, len(mine))), pa.array(np.tile(mine, len(others)).view(np.int64)),
                     pa.array(np.repeat(others < leaf, len(mine)))],
                    names=["pair", "fp", "second"],
                )

    return deal


class _Trie:
    """The binary trie of sorted distinct fingerprints: nodes of a depth are runs of the array."""

    def __init__(self, prints: np.ndarray, depth: int) -> None:
        self.prints = prints
        whole = np.array([0, len(prints)])
        self.levels = {depth: (whole[:1], whole[1:])}
        self.children: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def below(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node of ``depth`` the numbers of its children for bit 0 and bit 1, or -1."""
        if depth not in self.children:
            low, high = self.levels[depth]
            bit = (self.prints >> np.uint64(63 - depth)) & np.uint64(1)
            ones = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
            middle = high - (ones[high] - ones[low])
            bounds = [(low, middle), (middle, high)]
            full = [a < b for a, b in bounds]
            place = np.cumsum(np.stack(full, 1).ravel()).reshape(-1, 2) - 1
            self.children[depth] = tuple(np.where(full[k], place[:, k], -1) for k in (0, 1))
            keep = np.stack(full, 1).ravel()
            self.levels[depth + 1] = tuple(np.stack([b[k] for b in bounds], 1).ravel()[keep] for k in (0, 1))
        return self.children[depth]


def _links(one: np.ndarray, two: np.ndarray | None, depth: int, budget: int, block: int = 1 << 19, small: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints at most ``budget`` bits apart; ``two`` None: pairs within ``one``."""
    left = _Trie(one, depth)
    right = left if two is None else _Trie(two, depth)
    zero = np.zeros(1, np.int64)
    top = int(depth and np.bitwise_count((one[0] ^ right.prints[0]) >> np.uint64(64 - depth)))
    stack = [(depth, zero, zero, np.full(1, top, np.int64))]
    while stack:
        at, a, b, err = stack.pop()
        (alow, ahigh), (blow, bhigh) = left.levels[at], right.levels[at]
        na, nb = ahigh[a] - alow[a], bhigh[b] - blow[b]
        done = (na * nb <= small) | (at == 64)
        if done.any():
            i, j = _expanded(alow[a[done]], na[done], blow[b[done]], nb[done])
            near = np.bitwise_count(one[i] ^ right.prints[j]) <= budget
            if two is None:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            a, b, err = a[~done], b[~done], err[~done]
        if not len(a):
            continue
        (a0, a1), (b0, b1) = left.below(at), right.below(at)
        na = np.concatenate((a0[a], a1[a], a0[a], a1[a]))
        nb = np.concatenate((b0[b], b1[b], b1[b], b0[b]))
        ne = np.concatenate((err, err, err + 1, err + 1))
        fits = (na >= 0) & (nb >= 0) & (ne <= budget)
        if two is None:
            fits &= na <= nb
        na, nb, ne = na[fits], nb[fits], ne[fits]
        for k in range(0, len(na), block):
            stack.append((at + 1, na[k : k + block], nb[k : k + block], ne[k : k + block]))


def _expanded(alow, na, blow, nb) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of each pair of runs."""
    sizes = na * nb
    which = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return alow[which] + place // nb[which], blow[which] + place % nb[which]


def _merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Unites the sets of each pair; every entry of ``parent`` names its root afterwards."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _joiner(leaves: list[tuple[int, int]], budget: int):
    def join(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        pair = group["pair"][0].as_py()
        a, b = divmod(pair, len(leaves))
        second = group["second"].to_numpy()
        prints = group["fp"].to_numpy().view(np.uint64)
        one, two = np.sort(prints[~second]), np.sort(prints[second])
        nodes = np.concatenate((one, two))
        parent = np.arange(len(nodes))
        if a == b:
            found = _links(one, None, leaves[a][1], budget)
        elif len(one) and len(two):
            found = _links(one, two, min(leaves[a][1], leaves[b][1]), budget)
        else:
            found = iter(())
        shift = 0 if a == b else len(one)
        for i, j in found:
            parent = _merge(parent, i, j + shift)
        moved = np.flatnonzero(parent != np.arange(len(nodes)))
        return pa.table({"u": nodes[moved].view(np.int64), "v": nodes[parent[moved]].view(np.int64)})

    return join


def near_links(prints: DataFrame, budget: int = 3) -> DataFrame:
    """Links (u, v) that join all fingerprints (distinct, column fp) at most ``budget`` bits apart."""
    total = prints.count()
    leaves = trie_leaves(prints, min(MOST_LEAF, max(LEAST_LEAF, total // LEAVES)))
    tasks = min(4096, max(16, 4 * len(leaves)))
    spread = prints.select("fp").repartition(max(8, total // DEALT))
    dealt = spread.mapInArrow(_dealer(leaves, budget), "pair long, fp long, second boolean")
    return dealt.repartition(tasks, "pair").groupBy("pair").applyInArrow(_joiner(leaves, budget), "u long, v long")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, budget: int = 3
) -> DataFrame:
    """(id, fingerprint, component_id): the component's id is the smallest id that links reach."""
    prints = write_table(fingerprints(docs, id_column, text_column, shingle), "prints")
    least = write_table(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "least")
    linked = components(near_links(least, budget))
    roots = linked.join(least, linked["node"] == least["fp"]).groupBy("root").agg(F.min("least").alias("component"))
    placed = linked.join(roots, "root").select(F.col("node").alias("fp"), "component")
    class_of = least.join(placed, "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component_id"))
    return join_counted(prints, write_table(class_of, "classes"), ["fp"]).select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """One row of each component, all columns: the smallest doc_id, of repeated rows the one stored first."""
    keyed = with_row_key(docs)
    named = keyed.select(F.struct("doc_id", ROW).alias("__id"), "text")
    best = near_duplicates(named, "__id", "text", shingle, budget).where("id = component_id")
    return keyed.join(best.select(F.col(f"id.{ROW}").alias(ROW)), ROW, "left_semi").drop(ROW)
