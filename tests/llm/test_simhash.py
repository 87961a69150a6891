"""Fingerprints, trie join and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from codesieve.llm import simhash as S
from codesieve.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, near):
    """Least value of each component, by union of all near pairs."""
    parent = {v: v for v in values}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if a < b and near(a, b):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {v: top(v) for v in values}


def near(a, b):
    return bin(a ^ b).count("1") <= 3


def clustered(rng, n):
    out = []
    while len(out) < n:
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 4, 12])):
            value = center
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
                value ^= 1 << rng.randrange(64)
            out.append(value)
    return sorted(set(out))


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\x0b", "A", "a B", "A b C", "É\u0085x y z", "one two three four " * 500]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["id"]: r["fp"] % (1 << 64) for r in S.fingerprints(rows).collect()}
    assert found == {i: brute_print(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("small", [1, 8])
def test_trie_finds_exactly_the_near_pairs(small):
    rng = random.Random(5)
    values = np.array(clustered(rng, 400), np.uint64)
    pairs = {(i, j) for i, j in zip(*np.triu_indices(len(values), 1)) if near(int(values[i]), int(values[j]))}
    found = {(int(a), int(b)) for i, j in S._links(values, None, 0, 3, block=50, small=small) for a, b in zip(i, j)}
    assert found == pairs
    one, two = values[values < 1 << 63], values[values >= 1 << 63]
    across = {(i, j) for i in range(len(one)) for j in range(len(two)) if near(int(one[i]), int(two[j]))}
    assert {(int(a), int(b)) for i, j in S._links(one, two, 1, 3, block=50, small=small) for a, b in zip(i, j)} == across


@pytest.mark.parametrize("leaf", [8, 1 << 12])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, leaf):
    monkeypatch.setattr(S, "LEAST_LEAF", leaf)
    monkeypatch.setattr(S, "MOST_LEAF", leaf)
    rng = random.Random(leaf)
    values = clustered(rng, 300) + [0, 1, (1 << 64) - 1, 1 << 63]
    values = sorted(set(values))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    linked = components(S.near_links(spark.createDataFrame(signed, "fp long"))).collect()
    groups = {}
    for row in linked:
        groups.setdefault(row["root"], set()).add(row["node"] % (1 << 64))
    expected = {}
    for value, root in roots(values, near).items():
        expected.setdefault(root, set()).add(value)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_leaves_split_heavy_prefixes(spark):
    dense = [(i,) for i in range(3000)] + [(-i,) for i in range(1, 200)]
    frame = spark.createDataFrame(dense, "fp long")
    leaves = S.trie_leaves(frame, 64)
    starts = np.array([s for s, _ in leaves], np.uint64)
    values = np.array([v % (1 << 64) for (v,) in dense], np.uint64)
    assert np.bincount(np.searchsorted(starts, values, "right") - 1).max() <= 64
    assert sum(1 << (64 - d) for _, d in leaves) == 1 << 64


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(31)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


SCHEMA = "doc_id long, text string, fp long, component_id string"


def test_components_of_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [(5, base), (3, base + " tail"), (9, base), (9, base), (1, None), (2, ""), (7, "other words here now"), (None, "alone again by itself")]
    rows = spark.createDataFrame([(*t, 1, "x") for t in texts], SCHEMA)
    found = sorted((str(r["id"]), r["fingerprint"], str(r["component_id"])) for r in S.near_duplicates(rows).collect())
    prints = {t: brute_print(t) for _, t in texts}
    component = {i: min((j for j, u in texts if j is not None and near(prints[t], prints[u])), default=None) for i, t in texts}
    assert found == sorted((str(i), f"{prints[t]:016x}", str(component[i])) for i, t in texts)
    kept = sorted(str(r["doc_id"]) for r in S.representatives(rows).collect())
    assert len(kept) == len({min(str(c) for c in [component[i]]) for i, _ in texts}) and "None" in kept
    assert S.representatives(rows).columns == rows.columns


def test_repeated_rows_leave_one_and_empty_table(spark):
    rows = spark.createDataFrame([(4, "same text of words", 0, "")] * 5, SCHEMA)
    assert S.representatives(rows).count() == 1
    assert S.near_duplicates(rows.limit(0)).count() == 0
    assert S.representatives(rows.limit(0)).count() == 0
