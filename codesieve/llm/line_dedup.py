"""Removal of repeated line runs, found by prefix doubling of suffixes over line numbers.

The alphabet is the distinct lines. A suffix is a place in a document; prefix doubling sorts all
suffixes by their first 1, 2, 4, ... lines: the rank of 2k lines comes from the ranks of two
neighbouring blocks of k lines. Suffixes whose prefix occurs once are settled and dropped. Suffixes of
equal rank have that many first lines in common. The whole suffix array, with the common prefixes of neighbours, is
not built.

A repeated run counts if it has ``min_words`` words. Every such maximal run is the union of shortest
windows of that many words, beginning or ending at its lines, and the prefix of any window is the
union of two doubled blocks. So doubling goes as far as the longest window needs, and the intervals
of the windows' prefixes give all maximal runs. The first copy, by document id and line, stays; the
lines of later copies are removed. Overlapping copies within one document count as copies.

Null texts stay null with no lines; an empty text is one empty line. Blank lines take part in runs but
have no words. Repeated rows are copies, the one that is stored first stays. Null ids come before all
others. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, join_counted, with_row_key, write_table

BLANKS = r"[\x20\x09-\x0D]+"
PLACE = ("file", "index", "line")


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line: document, place, two hashes of the line, and its words."""
    each = docs.where("text IS NOT NULL").select(
        "doc_id", f"{ROW}.*", F.posexplode(F.split("text", "\n", -1)).alias("line", "content")
    )
    return each.select(
        "doc_id", *PLACE, F.xxhash64("content").alias("h1"), F.xxhash64(F.lit(1), "content").alias("h2"),
        F.size(F.array_remove(F.split("content", BLANKS), "")).cast("long").alias("words"),
    )


def _ranks(keys: DataFrame, *columns: str) -> DataFrame:
    """Keys that occur twice or more, how often, and the rank of each; ranks follow the order of the keys."""
    repeated = keys.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return write_table(repeated.orderBy(*columns).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _doubled(level: DataFrame, block: int) -> DataFrame:
    """Suffixes by their first 2 * block lines; those whose prefix occurs once are left out."""
    after = level.select("file", "index", (F.col("line") - block).alias("line"), F.col("rank").alias("second"))
    pairs = level.withColumnRenamed("rank", "first").join(after, list(PLACE))
    pairs = write_table(pairs, "pairs")
    ranks = _ranks(pairs, "first", "second")
    return write_table(join_counted(pairs, ranks, ["first", "second"]).select("doc_id", *PLACE, "rank"), "suffixes")


def _windows(level: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, place, size): the shortest windows of ``min_words`` words that begin or end at a line.

    Only stretches of repeated lines matter. Each gets one more row for its end, and the words before
    a row order the frames, so each window comes from one growing frame.
    """
    doc = W.partitionBy("file", "index").orderBy("line")
    stretch = level.withColumn("stretch", F.col("line") - F.row_number().over(doc))
    by = W.partitionBy("file", "index", "stretch")
    before = stretch.withColumn("before", F.sum("words").over(by.orderBy("line")) - F.col("words")).withColumn(
        "is_last", F.lead("line").over(by.orderBy("line")).isNull()
    )
    own = F.struct("line", "before", F.lit(True).alias("real"))
    end = F.struct((F.col("line") + 1).alias("line"), (F.col("before") + F.col("words")).alias("before"), F.lit(False).alias("real"))
    bounds = before.select(
        "doc_id", "file", "index", "stretch",
        F.explode(F.when(F.col("is_last"), F.array(own, end)).otherwise(F.array(own))).alias("b"),
    ).select("doc_id", "file", "index", "stretch", "b.*")
    far = (W.unboundedPreceding, -min_words)
    framed = bounds.withColumns({
        "till": F.min("line").over(by.orderBy(F.desc("before")).rangeBetween(*far)),
        "since": F.max("line").over(by.orderBy("before").rangeBetween(*far)),
    })
    ahead = framed.where("real AND till IS NOT NULL").select("doc_id", *PLACE, (F.col("till") - F.col("line")).alias("size"))
    back = framed.where("since IS NOT NULL").select(
        "doc_id", "file", "index", F.col("since").alias("line"), (F.col("line") - F.col("since")).alias("size")
    )
    return ahead.union(back).distinct()


def _later_copies(windows: DataFrame, level: DataFrame, block: int) -> DataFrame:
    """Windows of ``block`` to 2 * block - 1 lines that occur earlier."""
    head = windows.where((F.col("size") >= block) & (F.col("size") < 2 * block)).join(
        level.select(*PLACE, F.col("rank").alias("head")), list(PLACE)
    )
    tails = level.select("file", "index", F.col("line").alias("tail_line"), F.col("rank").alias("tail"))
    both = head.withColumn("tail_line", F.col("line") + F.col("size") - block).join(tails, ["file", "index", "tail_line"])
    both = write_table(both.select("doc_id", *PLACE, "size", "head", "tail"), "ends")
    at, keys = F.struct("doc_id", *PLACE), ["size", "head", "tail"]
    first = both.groupBy(*keys).agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    return join_counted(both, write_table(first, "firsts"), keys).where(at != F.col("first")).select(*PLACE, "size")


def repeated_runs(keyed: DataFrame, min_words: int = 25) -> DataFrame:
    """(file, index, start, end): the line runs to remove, disjoint, from rows with a row key."""
    lines = write_table(_lines(keyed), "lines")
    alphabet = _ranks(lines, "h1", "h2")
    level = write_table(join_counted(lines, alphabet, ["h1", "h2"]).select("doc_id", *PLACE, "words", "rank"), "suffixes")
    windows = write_table(_windows(level, min_words), "windows")
    longest = windows.agg(F.max("size")).first()[0] or 0
    level, block, found = level.drop("words"), 1, None
    while block <= longest:
        copies = _later_copies(windows, level, block)
        found = copies if found is None else found.union(copies)
        if 2 * block <= longest:
            level = _doubled(level, block)
        block *= 2
    if found is None:
        found = windows.select(*PLACE, "size")
    doc = W.partitionBy("file", "index").orderBy("line")
    spans = found.select(*PLACE, (F.col("line") + F.col("size")).alias("end"))
    reach = F.max("end").over(doc.rowsBetween(W.unboundedPreceding, -1))
    starts = spans.withColumn("fresh", F.when(F.col("line") <= reach, 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("fresh").over(doc.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("file", "index", "run").agg(F.min("line").alias("start"), F.max("end").alias("end")).drop("run")


def _without(lines: Column, runs: Column) -> Column:
    """The lines outside the sorted runs: the slices between them."""

    def gap(k: Column) -> Column:
        since = F.coalesce(F.get(runs, k - 1)["end"], F.lit(0))
        till = F.coalesce(F.get(runs, k)["start"], F.size(lines))
        return F.slice(lines, since + 1, till - since)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), gap))


def deduplicated(docs: DataFrame, min_words: int = 25) -> DataFrame:
    """doc_id, n_lines, n_removed, and the text without later copies of repeated runs."""
    keyed = with_row_key(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    runs = repeated_runs(keyed, min_words).groupBy(F.struct("file", "index").alias(ROW)).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")
    )
    cut = keyed.join(write_table(runs, "runs"), ROW, "left").select(
        "doc_id", "text", F.split("text", "\n", -1).alias("lines"), "runs"
    )
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + r["end"] - r["start"])
    return cut.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("runs").isNull(), F.col("text"))
        .otherwise(F.array_join(_without(F.col("lines"), F.col("runs")), "\n")).alias("text"),
    )


DEDUPLICATED_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, n - 1 AS n, lines[n] AS line, len(regexp_extract_all(lines[n], '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM d)
), b AS (
  SELECT doc_id, n, sum(words) OVER (PARTITION BY doc_id ORDER BY n) - words AS before FROM l
  UNION ALL SELECT doc_id, count(*), sum(words) FROM l GROUP BY doc_id
), f AS (
  SELECT doc_id, n,
         min(n) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN 25 FOLLOWING AND UNBOUNDED FOLLOWING) AS till,
         max(n) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN UNBOUNDED PRECEDING AND 25 PRECEDING) AS since
  FROM b
), w AS (
  SELECT doc_id, n AS s, till AS e FROM f WHERE till IS NOT NULL
  UNION SELECT doc_id, since, n FROM f WHERE since IS NOT NULL
), t AS (
  SELECT w.doc_id, s, e, array_to_string(lines[s + 1 : e], chr(10)) AS content FROM w JOIN d USING (doc_id)
), r AS (
  SELECT doc_id, s, e, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS copy FROM t
), gone AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS n FROM r WHERE copy > 1),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM l ANTI JOIN gone USING (doc_id, n) GROUP BY doc_id
), c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.lines)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed, coalesce(kept.text, '') AS text
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
