"""Shards: the law of counts, gapless slots, and groups kept together."""

import random
from collections import Counter, defaultdict

import pytest

from codesieve.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, node int"


def place(spark, texts, ids=None, **options):
    ids = range(len(texts)) if ids is None else ids
    return S.assigned(spark.createDataFrame([(i, t, "x", 0) for i, t in zip(ids, texts)], SCHEMA), **options).collect()


def check_law(rows, shards=8):
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def spread(rows, texts):
    where = defaultdict(Counter)
    for r in rows:
        where[texts[r["doc_id"]]][r["shard"]] += 1
    return where


@pytest.mark.parametrize("bucket_rows", [5, 50_000])
def test_groups_stay_together_and_counts_even(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(6)
    texts = [f"unique {i}" for i in range(300)]
    for g in range(40):
        texts += [f"group {g}"] * rng.randint(2, 8)
    rng.shuffle(texts)
    rows = place(spark, texts)
    check_law(rows)
    assert all(len(shards) == 1 for shards in spread(rows, texts).values())


def test_hot_group_fills_few_shards(spark):
    texts = ["hot"] * 200 + [f"unique {i}" for i in range(300)] + [f"pair {i // 2}" for i in range(100)]
    rows = place(spark, texts)
    check_law(rows)
    hot = spread(rows, texts)["hot"]
    assert sum(sorted(hot.values())[-3:]) >= 170


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9])
def test_small_tables(spark, n):
    rows = place(spark, ["same"] * n)
    check_law(rows)
    assert len(rows) == n


def test_sizes_nulls_and_repeated_rows(spark):
    texts = [None, "", "é", "é", "x" * 100_000]
    rows = place(spark, texts, ids=[1, None, 2, 2, 3])
    check_law(rows)
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == [("1", 1), ("2", 3), ("2", 3), ("3", 100_001), ("None", 1)]
    assert {r["text_crc32"] for r in rows if r["size"] == 1} == {0}


def test_sharded_keeps_columns_and_every_row(spark):
    docs = spark.createDataFrame([(i % 3, "t", "old", 1) for i in range(20)], SCHEMA)
    out = S.sharded(docs)
    assert out.columns == ["doc_id", "text", "node", "shard", "slot"] and out.count() == 20
    check_law(out.collect())


def cut_groups(rows, texts):
    return [text for text, shards in spread(rows, texts).items() if len(shards) > 1]


@pytest.mark.parametrize("bucket_rows", [50, 50_000])
@pytest.mark.parametrize("copies", [2, 5, 20])
def test_groups_stay_whole_where_every_row_is_linked(spark, monkeypatch, copies, bucket_rows):
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket_rows)
    texts = [f"group {i // copies}" for i in range(2_000)]
    rows = place(spark, texts)
    check_law(rows)
    assert len(cut_groups(rows, texts)) < 8


def test_a_hot_group_of_a_third_leaves_the_others_whole(spark):
    texts = ["hot"] * 800 + [f"group {i // 4}" for i in range(1_600)]
    rows = place(spark, texts)
    check_law(rows)
    where = spread(rows, texts)
    assert sorted(where["hot"].values()) == [200, 300, 300]
    assert cut_groups(rows, texts) == ["hot"]


def test_groups_that_fit_no_shard_whole_are_cut_last(spark):
    texts = [f"group {i // 111}" for i in range(999)] + ["last"]
    rows = place(spark, texts)
    check_law(rows)
    assert len(cut_groups(rows, texts)) == 1


def test_rounds_alone_exchange_rows_of_full_shards(spark):
    rng = random.Random(2)
    pieces = [(h, s, rng.randint(1, 9)) for h in range(400) for s in range(4)]
    load = [sum(n for _, t, n in pieces if t == s) for s in range(4)]
    found = S.propagated(spark.createDataFrame(pieces, "hub long, shard int, n long"), load).collect()
    assert sum(r["n"] for r in found) == sum(load)
    assert len(found) < 0.5 * len(pieces)


def test_best_exchange_moves_the_most_rows():
    assert S.best_exchange({(0, 1): 5, (1, 0): 7}, [0, 0]) == {(0, 1): 5, (1, 0): 5}
    assert S.best_exchange({(0, 1): 5, (1, 0): 7}, [1, 0]) == {(0, 1): 5, (1, 0): 6}
    assert S.best_exchange({(0, 1): 4, (1, 2): 6, (2, 0): 5, (0, 2): 9}, [0, 0, 0]) == {(0, 1): 4, (1, 2): 4, (2, 0): 5, (0, 2): 1}
    assert S.best_exchange({(2, 0): 10, (0, 1): 10, (1, 0): 10}, [0, 0, 3]) == {(2, 0): 0, (0, 1): 10, (1, 0): 10}
    rng = random.Random(4)
    for _ in range(50):
        asked = {(s, t): rng.randint(0, 1000) for s in range(8) for t in range(8) if s != t}
        room = [rng.choice([0, 50]) for _ in range(8)]
        flow = S.best_exchange(asked, room)
        assert all(0 <= n <= asked[pair] for pair, n in flow.items())
        for t in range(8):
            assert sum(n for (_, b), n in flow.items() if b == t) <= room[t] + sum(n for (a, _), n in flow.items() if a == t)


def test_whole_groups_by_size():
    room = [10, 7]
    ranges, over = S.placed_by_size({6: 2, 5: 1}, room)
    assert ranges == [(6, 0, 1, 1), (6, 1, 2, 0)] and over == {5: 1} and room == [4, 1]
    assert S.cut_up(5, room) == [(0, 0, 4), (1, 4, 5)] and room == [0, 0]
