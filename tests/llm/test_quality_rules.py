"""The ledger against plain Python."""

import random
import re
from collections import Counter

from codesieve.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_exclaims": text.count("!"), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, __text string")


def test_measurements_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "x y \u0085z", "!# $\r\n\x0b a"]
    texts += ["".join(rng.choice("ab #!\n\tÉ") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts += ["lorem ipsum dolor sit\n" * 3000]
    rows = Q.judged(documents(spark, texts)).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        assert {k: row[k] for k in Q.MEASURES} == brute(text), text
        assert row["base_failed"] == (row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"])
        assert row["kept"] == (row["fail_bits"] == 0)


def test_clean_text_is_kept_and_junk_is_not(spark):
    clean = " ".join(f"word{i} and more{i % 17}" for i in range(60))
    rows = Q.judged(documents(spark, [clean, clean.replace(" ", "*** "), clean.replace(" ", "!! ").upper()])).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True, False, False]


def test_policies_and_ablations_come_from_the_ledger(spark):
    entries = spark.createDataFrame([(b,) for b in [0, 0, 1, 2, 3, 4, 6]], "fail_bits long")
    both = Q.Policy("p", ("few_words", "repeated_words"))
    found = {r["rule"]: r for r in Q.ablations(entries, (both,)).collect()}
    assert (found["few_words"]["failing"], found["few_words"]["only_by_it"], found["few_words"]["kept"]) == (2, 1, 3)
    assert (found["repeated_words"]["failing"], found["repeated_words"]["only_by_it"]) == (3, 2)
    assert entries.where(Q.passes(both)).count() == 3


def test_empty_table_and_repeated_rows(spark):
    assert Q.judged(documents(spark, [])).count() == 0
    twice = documents(spark, ["a b", "a b"])
    assert Q.judged(twice.union(twice)).count() == 4
