"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit per
failed rule; a policy is a mask over these bits, so new policy versions and ablations are bitwise
work over the ledger and never read the texts again.

Null and empty texts have no words and fail ``few_words``. Repeated rows, null ids and extra columns
pass through: each input row gives one ledger row. Work is linear in the text, sorting aside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blanks between words, and the characters counted as symbols.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` is its place in the ledger, never reused."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "2 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "n_lines > 3 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 25 * n_words"),
    Rule("shouting", 6, "2 * n_exclaims > n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclaims", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Policy:
    """A version: the rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
CURRENT = Policy("2", tuple(r.name for r in RULES))


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measured(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the measurements of each row, all inside the row."""
    text, words, grams, twins = F.col("__text"), F.col("__words"), F.col("__grams"), F.col("__twins")
    kept = [F.col(c) for c in keep]
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    cut = docs.select(*kept, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("__text")).select(
        *kept, "__text", F.array_remove(F.split(text, BLANKS), "").alias("__words"),
        F.filter(F.split(text, "\n"), has_word).alias("__lines"),
    )
    counted = cut.select(
        *kept,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        _count_of(text, "!").cast("long").alias("n_exclaims"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.slice(
            F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
            1, F.greatest(F.size(words) - 2, F.lit(0)),
        ).alias("__grams"),
    )
    # Plain longs sort fast; only texts with a window found twice sort (window, place) pairs.
    order = counted.withColumn("__sorted", F.sort_array("__grams"))
    twin = order.withColumn(
        "__twins", F.exists(F.transform("__sorted", lambda g, i: g == F.get("__sorted", i + 1)), lambda x: x)
    ).drop("__sorted")
    placed = twin.withColumn(
        "__placed",
        F.when(twins, F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))),
    ).drop("__grams")
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    places = F.sort_array(
        F.transform(
            F.filter(
                "__placed",
                lambda x, n: same(x, F.get("__placed", n + 1)) | ((n > 0) & same(x, F.get("__placed", F.greatest(n - 1, F.lit(0))))),
            ),
            lambda x: x["i"],
        )
    )
    at = placed.withColumn("__at", F.when(twins, places)).drop("__placed")
    widths = F.transform("__at", lambda x, n: F.least(F.lit(3), F.coalesce(F.get("__at", n + 1) - x, F.lit(3))))
    covered = F.aggregate(widths, F.lit(0).cast("long"), lambda total, x: total + x)
    return at.select(
        *kept, *[c for c in MEASURES if c != "n_repeat_words"],
        F.when(twins, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def ledger(measures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``fail_bits``: one bit for each rule that the row fails."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        failed = F.coalesce(F.expr(rule.fails), F.lit(False))
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measures.withColumn("fail_bits", bits)


# The columns of a verdict, in order; further measurements follow.
VERDICT_COLUMNS = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablations(entries: DataFrame, policies: tuple[Policy, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents failing it, and those that only it rejects.

    The ledger is first summed by bit pattern (at most 2 ** rules rows), so the rest is tiny.
    """
    spark = entries.sparkSession
    masks = [
        (p.version, r.name, p.mask(rules), 1 << r.bit) for p in policies for r in rules if r.name in p.rules
    ]
    table = spark.createDataFrame(masks, "policy string, rule string, mask long, bit long")
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    hit = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(table.columns, m, strict=True)]) for m in masks])
    each = patterns.select("fail_bits", "n", F.explode(hit).alias("m")).select("fail_bits", "n", "m.*")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return each.groupBy("policy", "rule").agg(
        F.coalesce(F.sum(F.when(failed.bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("failing"),
        F.coalesce(F.sum(F.when(failed == F.col("bit"), F.col("n"))), F.lit(0)).alias("only_by_it"),
        F.coalesce(F.sum(F.when(failed == 0, F.col("n"))), F.lit(0)).alias("kept"),
    )


def judged(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """doc_id, measurements, fail_bits, and the verdicts of the base policy and of ``policy``."""
    entries = ledger(measured(docs)).withColumns({"base_failed": ~passes(BASE), "kept": passes(BASE) & passes(policy)})
    return entries.select(*VERDICT_COLUMNS, *[c for c in entries.columns if c not in VERDICT_COLUMNS])


def ablated(docs: DataFrame, policies: tuple[Policy, ...] = (BASE, CURRENT)) -> DataFrame:
    """The ablations of all policies, from one ledger of all documents."""
    return ablations(ledger(measured(docs)), policies)


JUDGED_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM g JOIN twice USING (doc_id, gram), (SELECT unnest([0, 1, 2]) AS k)
  GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaims,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
       + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
       + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END
       + CASE WHEN n_lines > 3 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
       + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
       + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END
       + CASE WHEN 2 * n_exclaims > n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits
  FROM m
)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""
ABLATED_SQL = f"""
WITH j AS ({JUDGED_SQL}), r AS (
  SELECT p.policy, p.mask, unnest(['few_words', 'repeated_words', 'symbols', 'repeated_lines', 'short_words', 'long_words', 'shouting']) AS rule,
         unnest([1, 2, 4, 8, 16, 32, 64]) AS bit
  FROM (SELECT 'base' AS policy, 3 AS mask UNION ALL SELECT '2', 127) p
)
SELECT policy, rule, count(*) FILTER (fail_bits & mask & bit <> 0) AS failing,
       count(*) FILTER (fail_bits & mask = bit) AS only_by_it, count(*) FILTER (fail_bits & mask = 0) AS kept
FROM r, j WHERE mask & bit <> 0 GROUP BY policy, rule
"""
