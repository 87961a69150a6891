"""Shards by balanced label propagation: linked documents together, shard counts at most one apart.

Documents are linked when their texts are equal. Groups of more than an eighth of a shard (at most
eight for each shard) are placed first, largest first; a group that no shard can hold fills one shard
after another. The other linked documents start in hashed shards. In each round the pieces of a group
move to the shard that holds most of it. What leaves a shard in a round makes room there, so shards
exchange rows: the moves are the largest flow between the shards that no quota forbids. Rounds end
when one merges no pieces. Groups still in pieces then, and those over a shard's quota, are placed as
wholes, largest first, and only groups that no room holds are cut: fewer than there are shards. All
documents without links fill what is missing.

Only counts by shard and by group size reach the driver, and the groups placed first or cut. Rows get
their places from counts of small buckets, so a group with a third of all rows is never one task.

Null and empty texts are equal texts of size 1. Repeated rows are linked rows of their own. Null ids
and extra columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, join_counted, with_row_key, write_table

BUCKET_ROWS = 5_000
# Groups of more than this part of a shard are placed before the rounds.
LARGE = 8


def _nodes(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """A narrow row per document with a number of its own and the hashes that stand for its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        *keep, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"),
    )
    return write_table(rows.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _hub_links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, hub) of the members of groups of equal texts with two rows at least, and (hub, n)."""
    keys = ["h1", "h2", "size"]
    groups = nodes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    hubs = write_table(groups.withColumn("hub", F.monotonically_increasing_id()), "hubs")
    links = join_counted(nodes.select("node", *keys), hubs, keys).select("node", "hub")
    return write_table(links, "links"), hubs.select("hub", "n")


def _chance(*parts: Column | str) -> Column:
    """A hashed number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _loads(labels: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _numbered(
    rows: DataFrame, group: list[str], bucket: list[str], order: list[str], name: str, weight: Column | None = None
) -> DataFrame:
    """Adds ``name``: the weight (1 each by default) of the rows before the row in its group, by bucket and then ``order``.

    The weights of the buckets are summed first, so a task only numbers the rows of a bucket.
    """
    rows = write_table(rows.withColumn("__w", (F.lit(1) if weight is None else weight).cast("long")), "numbering")
    counts = rows.groupBy(*group, *bucket).agg(F.sum("__w").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*group).orderBy(*bucket)) - F.col("__n")
    offsets = counts.select(*group, *bucket, before.alias("__before"))
    upto = W.partitionBy(*group, *bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = rows.withColumn("__place", F.sum("__w").over(upto) - F.col("__w")).join(offsets, [*group, *bucket])
    return numbered.withColumn(name, F.col("__before") + F.col("__place")).drop("__before", "__place", "__w")


def _bucket(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits) if bits else F.lit(0).cast("long")


def best_exchange(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """The most rows that can move: for each (from, to) at most what is asked, and into no shard more
    than leave it and its room.

    A circulation over the shards and one more node that takes what stays in free room; cycles of the
    residual graph that let more rows move are added until there is none.
    """
    free, flow = len(room), {pair: 0 for pair in asked}
    edges = [[s, t, n, -1, (s, t)] for (s, t), n in asked.items() if n]
    edges += [[t, free, n, 0, None] for t, n in enumerate(room) if n]
    edges += [[free, s, sum(asked.values()), 0, None] for s in range(free)]
    # Each edge is followed by its reverse: from, to, capacity left, cost, pair.
    both = [e for s, t, n, cost, pair in edges for e in ([s, t, n, cost, pair], [t, s, 0, -cost, pair])]
    while True:
        cost, via, last = [0] * (free + 1), [-1] * (free + 1), -1
        for _ in range(free + 1):
            last = -1
            for k, (s, t, left, price, _pair) in enumerate(both):
                if left and cost[s] + price < cost[t]:
                    cost[t], via[t], last = cost[s] + price, k, t
        if last < 0:
            return flow
        for _ in range(free + 1):
            last = both[via[last]][0]
        cycle, at = [], last
        while not cycle or at != last:
            cycle.append(via[at])
            at = both[via[at]][0]
        most = min(both[k][2] for k in cycle)
        for k in cycle:
            both[k][2] -= most
            both[k ^ 1][2] += most
            if both[k][4]:
                flow[both[k][4]] += -most * both[k][3]


def _by_shard(values: list[int]) -> Column:
    return F.get(F.array(*[F.lit(x).cast("long") for x in values]), F.col("shard"))


def _started(links: DataFrame, room: list[int]) -> DataFrame:
    """(hub, shard, n): the pieces of groups whose nodes are dealt over the shards by their room."""
    at, shard, upto = _chance("node", F.lit("start")), F.lit(max(range(len(room)), key=room.__getitem__)), sum(room)
    for s in reversed(range(len(room))):
        shard = F.when((at < upto / max(1, sum(room))) & F.lit(room[s] > 0), F.lit(s)).otherwise(shard)
        upto -= room[s]
    return links.withColumn("shard", shard.cast("int")).groupBy("hub", "shard").agg(F.count("*").alias("n"))


def propagated(pieces: DataFrame, room: list[int]) -> DataFrame:
    """(hub, shard, n) after rounds of moves towards the shard that holds most of the hub.

    A round moves whole pieces, so none has more pieces than the one before; the first that has as many
    is the last.
    """
    shards, before = len(room), None
    while True:
        # Among equal pieces the hub's hash decides, so ties do not all go to one shard.
        rank = F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")
        best = F.max(rank).over(W.partitionBy("hub"))["shard"]
        pieces = write_table(
            pieces.withColumn("best", best).select("hub", "shard", "n", F.when(best != F.col("shard"), best).alias("to")), "pieces"
        )
        found = pieces.groupBy("shard", "to").agg(F.sum("n").alias("n"), F.count("*").alias("pieces")).collect()
        asked = {(r["shard"], r["to"]): r["n"] for r in found if r["to"] is not None}
        number = sum(r["pieces"] for r in found)
        load = [sum(r["n"] for r in found if r["shard"] == s) for s in range(shards)]
        flow = best_exchange(asked, [max(0, size - held) for size, held in zip(room, load, strict=True)])
        if number == before or not any(flow.values()):
            return pieces.select("hub", "shard", "n")
        before, allowed = number, F.lit(0).cast("long")
        for (s, t), n in flow.items():
            allowed = F.when((F.col("shard") == s) & (F.col("to") == t), F.lit(n).cast("long")).otherwise(allowed)
        bits = (number // BUCKET_ROWS).bit_length()
        wishes = pieces.where("to IS NOT NULL").withColumn("bucket", _bucket(F.col("hub"), bits))
        wishes = _numbered(wishes, ["shard", "to"], ["bucket"], ["hub"], "before", F.col("n"))
        after = F.when(F.col("before") + F.col("n") <= allowed, F.col("to")).otherwise(F.col("shard"))
        moved = wishes.select("hub", after.alias("shard"), "n").unionByName(pieces.where("to IS NULL").drop("to"))
        pieces = moved.groupBy("hub", "shard").agg(F.sum("n").alias("n"))


def placed_by_size(counts: dict[int, int], room: list[int]) -> tuple[list[tuple[int, int, int, int]], dict[int, int]]:
    """Whole groups into the shards, largest first: ranges (n, since, upto, shard) of the numbers of the
    groups of n rows, and how many of n rows fit nowhere; those have the last numbers. ``room`` is
    lowered. A group goes to the shard with the least room that holds it.
    """
    ranges, over = [], {}
    for n in sorted(counts, reverse=True):
        since = 0
        for s in sorted(range(len(room)), key=room.__getitem__):
            fit = min(room[s] // n, counts[n] - since)
            if fit:
                ranges.append((n, since, since + fit, s))
                since, room[s] = since + fit, room[s] - fit * n
        if since < counts[n]:
            over[n] = counts[n] - since
    return ranges, over


def cut_up(n: int, room: list[int]) -> list[tuple[int, int, int]]:
    """(shard, since, upto) of the rows of a group, in as few shards as hold it; ``room`` is lowered."""
    cuts, since = [], 0
    while since < n:
        whole = [s for s in range(len(room)) if room[s] >= n - since]
        s = min(whole, key=room.__getitem__) if whole else max(range(len(room)), key=room.__getitem__)
        upto = min(n, since + room[s])
        cuts.append((s, since, upto))
        room[s] -= upto - since
        since = upto
    return cuts


def grouped(links: DataFrame, hubs: DataFrame, sizes: list[int]) -> DataFrame:
    """(node, hub, shard): all linked nodes, in no shard more than its size."""
    spark, room, homes, cuts = links.sparkSession, list(sizes), [], []
    largest = max(sizes)
    large = hubs.where(F.col("n") > largest / LARGE).orderBy(F.desc("n"), "hub").collect()
    for hub, n in large:
        if n > largest:
            cuts += [(hub, *c) for c in cut_up(n, room)]
        elif whole := [s for s in range(len(room)) if room[s] >= n]:
            s = min(whole, key=room.__getitem__)
            room[s] -= n
            homes.append((hub, s, n))
    done = F.broadcast(spark.createDataFrame([(h,) for h in {x[0] for x in homes + cuts}], "hub long"))
    pieces = propagated(_started(links.join(done, "hub", "left_anti"), room), room)

    # Whole groups stay while the quota lasts; all others are dealt anew.
    totals = pieces.groupBy("hub").agg(F.sum("n").alias("n"), F.count("*").alias("pieces"), F.min("shard").alias("shard"))
    totals = write_table(totals, "totals")
    bits = (totals.count() // BUCKET_ROWS).bit_length()
    totals = totals.withColumn("bucket", _bucket(F.col("hub"), bits))
    whole = _numbered(totals.where("pieces = 1"), ["shard"], ["bucket"], ["hub"], "before", F.col("n"))
    whole = write_table(whole.withColumn("stays", F.col("before") + F.col("n") <= _by_shard(room)), "whole")
    for r in whole.where("stays").groupBy("shard").agg(F.sum("n").alias("n")).collect():
        room[r["shard"]] -= r["n"]
    others = totals.where("pieces > 1").unionByName(whole.where("NOT stays").drop("before", "stays")).select("hub", "n", "bucket")
    others = write_table(_numbered(others, ["n"], ["bucket"], ["hub"], "number"), "others")
    counts = {r["n"]: r["groups"] for r in others.groupBy("n").agg(F.count("*").alias("groups")).collect()}
    ranges, over = placed_by_size(counts, room)
    plan = F.broadcast(spark.createDataFrame(ranges, "n long, since long, upto long, shard int"))
    planned = others.join(plan, "n").where("number >= since AND number < upto")
    if over:
        rest = F.broadcast(spark.createDataFrame([(n, counts[n] - k) for n, k in over.items()], "n long, since long"))
        for r in others.join(rest, "n").where("number >= since").orderBy(F.desc("n"), "hub").collect():
            cuts += [(r["hub"], *c) for c in cut_up(r["n"], room)]
    columns = ("hub", "shard", "n")
    first = spark.createDataFrame(homes, "hub long, shard int, n long")
    homes = write_table(whole.where("stays").select(*columns).union(planned.select(*columns)).union(first), "homes")
    labels = join_counted(links, homes, ["hub"]).select("node", "hub", "shard")
    if not cuts:
        return write_table(labels, "labels")
    ways = F.broadcast(spark.createDataFrame(cuts, "hub long, shard int, since long, upto long"))
    bits = (sum(upto - since for _, _, since, upto in cuts) // BUCKET_ROWS).bit_length()
    split = links.join(ways.select("hub").distinct(), "hub", "left_semi").withColumn("bucket", _bucket(F.col("node"), bits))
    split = _numbered(split, ["hub"], ["bucket"], ["node"], "number").join(ways, "hub").where("number >= since AND number < upto")
    return write_table(labels.unionByName(split.select("node", "hub", "shard")), "labels")


def _bucket_rows(nodes: DataFrame, total: int) -> int:
    """Rows to number in one task: two buckets for each shuffle partition, and never more than BUCKET_ROWS."""
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(BUCKET_ROWS, total // (2 * tasks)))


def assigned(docs: DataFrame, shards: int = 8, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    nodes = _nodes(docs, keep)
    total = nodes.count()
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    most = _bucket_rows(nodes, total)
    bits = (total // most).bit_length()
    labels = grouped(*_hub_links(nodes), sizes)

    # Whole groups in order of their hash; large pieces are spread over buckets of their own.
    pieces = labels.groupBy("hub", "shard").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / most))
    parts = F.col("parts")
    linked = join_counted(labels, write_table(pieces, "pieces"), ["hub", "shard"]).select(
        "node", "hub", "shard", _bucket(F.col("hub"), bits).alias("bucket"),
        F.when(parts > 1, 1 + F.pmod(F.xxhash64("node"), parts)).otherwise(0).cast("long").alias("part"),
    )
    placed = write_table(_numbered(linked, ["shard"], ["bucket", "part"], ["hub", "node"], "slot"), "placed")
    staying = placed.where(F.col("slot") < _by_shard(sizes)).select("node", "shard", "slot")
    held = [min(load, size) for load, size in zip(_loads(placed, shards), sizes, strict=True)]

    rest = nodes.select("node").join(staying.select("node"), "node", "left_anti")
    rest = rest.select("node", F.lit(0).alias("all"), _bucket(F.col("node"), bits).alias("bucket"))
    rest = _numbered(rest, ["all"], ["bucket"], ["node"], "number")
    shard, slot, upto = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        first, upto = upto, upto + sizes[s] - held[s]
        here = (F.col("number") >= first) & (F.col("number") < upto)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("number") - first + held[s]).otherwise(slot)
    filling = rest.select("node", shard.alias("shard"), slot.alias("slot"))
    return nodes.join(staying.unionByName(filling), "node").select(*keep, "size", "text_crc32", "shard", "slot")


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The documents with ``shard`` and ``slot``, which replace columns of these names."""
    keyed = with_row_key(docs.drop("shard", "slot"))
    places = assigned(keyed, shards, keep=(ROW,)).select(ROW, "shard", "slot")
    return keyed.join(places, ROW).drop(ROW)
