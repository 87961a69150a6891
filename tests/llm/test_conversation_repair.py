"""Repairs against a search over all edits, and the damage and faults against plain Python."""

import hashlib
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codesieve.llm import conversation_repair as C
from codesieve.llm import role_parser as P

SCHEMA = "conv_id long, turn long, role string, text string, letters string, kind int"
NAMES = {"u": "user", "a": "assistant"}
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """Least (cost, audit, roles) over all edits; at most four inserted rows in one place are enough."""

    @lru_cache(None)
    def best(at, state, inserted):
        found = [(0, "", "")] if at == len(rows) and state in (0, 3) else []

        def add(cost, letter, role, rest):
            if rest:
                found.append((cost + rest[0], letter + rest[1], role + rest[2]))

        def go(cost, letter, role, after, n):
            if (state, role) in STEPS:
                add(cost, letter, role, best(after, STEPS[state, role], n))

        if inserted < 4:
            for role in "ua":
                go(2, "I", role, at, inserted + 1)
        if at < len(rows):
            add(3, "D", "-", best(at + 1, state, 0))
            row = rows[at]
            if row != "-":
                spoiled = int(row.isupper() or row == "!")
                go(spoiled, "K", row.lower(), at + 1, 0)
                for role in "ua":
                    go(2 + spoiled, "R", role, at + 1, 0)
        return min(found) if found else None

    return best(0, 0, 0)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="suaSUA?!-", max_size=12))
def test_cheapest_repair(rows):
    assert P.repair(rows) == cheapest(rows)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="suaSUA?!-", min_size=5, max_size=40))
def test_segments_join_to_the_same_repair(rows):
    whole = P._repair(P.CHAT, rows)
    size, P.SEGMENT = P.SEGMENT, 4
    try:
        assert P._repair(P.CHAT, rows) == whole
    finally:
        P.SEGMENT = size


def test_other_grammars_and_conflicts():
    # An ambiguous grammar: both readings of a pair are followed.
    pairs = P.Grammar((("x", ("y",)), ("x", ("z",)), ("y", ("u", "a")), ("z", ("u", "a")), ("z", ("z", "a"))))
    assert P.repair("uaa", pairs) == (0, "KKK", "uaa") and P.repair("ua", pairs) == (0, "KK", "ua")
    assert P.repair("s", pairs) == (4, "IR", "ua")
    deep = P.Grammar((("x", ("u", "a")), ("x", ("u", "x", "a"))))
    with pytest.raises(ValueError):
        P.repair("ua", deep)


def plain(rows, damage=True):
    """Expected digests by conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        kept = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20 if damage else 9
        role, text = said(role), said(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, letters, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            bare = text.strip(C.WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "?"
            letters += "-" if fault in ("blank", "duplicate") else {"?": "!"}.get(letter, letter.upper()) if fault else letter
            if fault:
                counts[fault] += 1
        turns = [t for t, _, _ in kept if t is not None]
        initials = [r[:1] for _, r, _ in kept]
        cost, audit, roles = cheapest(letters)
        lines, left = [], iter(kept)
        for letter, role in zip(audit, roles):
            row = next(left) if letter != "I" else None
            if letter != "D":
                lines.append(f"{row[1] if letter == 'K' else NAMES[role]}:{row[2] if row else ''}")
        out[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts,
            "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }
    return out


def run(spark, rows, damage=True):
    found = C.digests(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA), damage).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in found}


def test_many_damaged_conversations(spark):
    ends = [".", "", "?", " . ", "! x"]
    rows = [
        (c, t, ["system", "user", "assistant", "user", "tool", "assistant"][(c * 7 + t * t) % 6] if t else "system", f"t{(c + t) % 4}{ends[(c * t) % 5]}")
        for c in range(200) for t in range(c % 7)
    ]
    assert run(spark, rows) == plain(rows)


def test_nulls_ties_repeated_rows_and_empty_table(spark):
    rows = [
        (None, None, "user", "q."), (None, None, None, None), (None, 2, "assistant", "a."), (None, 2, "assistant", "a."),
        (1, 5, "user", "same."), (1, 5, "user", "same."), (1, 9, "user", "same."), (1, 7, "assistant", "\t\n"), (1, 8, "", "x"),
        (2, 1, "user", None), (3, 1, "assistant", "ends here"), (3, 1, "user", "ends here."),
    ]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, damage=False) == plain(rows, damage=False)
    assert run(spark, []) == {}


def test_one_long_conversation_and_long_text(spark):
    rows = [(0, t, ("user", "assistant", "tool")[t % 5 % 3], f"line {t % 900}{'.' * (t % 3)}") for t in range(3000)]
    rows += [(4, 0, "user", "long " * 300_000), (4, 1, "assistant", "fine.")]
    found = run(spark, rows)
    small = plain([r for r in rows if r[0] == 4])
    assert found[4] == small[4]
    letters_cost = found[0]["cost"]
    assert letters_cost > 0 and len(found[0]["audit"]) >= 2500


def test_repaired_turns_are_legal(spark):
    rows = [(c, t, ["user", "assistant"][(c + t) % 2], f"t{t}.") for c in range(40) for t in range(4)]
    keyed = C.damaged(C.keyed(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)))
    edits = C.cheapest_edits(C.faulty(keyed))
    turns = C.repaired_turns(keyed, edits).collect()
    by_conv = {}
    for r in sorted(turns, key=lambda r: (r["conv"], r["place"])):
        by_conv.setdefault(r["conv"], []).append(r["role"])
    assert by_conv and all(roles[::2] == ["user"] * (len(roles) // 2) and roles[1::2] == ["assistant"] * (len(roles) // 2) for roles in by_conv.values())
