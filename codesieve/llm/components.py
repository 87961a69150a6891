"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least neighbour of u, or u itself if that is less."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Expects u > v in every edge."""
    starred = _with_least(edges)
    moved = starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = starred.select("u", F.col("m").alias("v"))
    return moved.union(kept).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): the root is the least node it can reach.

    Rounds of large-star and small-star, so long chains take a logarithmic number of rounds. Every
    round is a written table. An edge from a node to itself adds nothing; no edges give no rows.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = write_table(now, "edges")
    state = _state(now)
    while state[0]:
        now = write_table(_small_star(_large_star(now)), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
