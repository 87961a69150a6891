"""The finding record, and the compiler from rule tables to findings.

A rule hit is a small struct with the rule's number; severity, type and text are looked up by it,
each in one list, when hits become findings. All of it is SQL text over one file's row.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.text import NO_INTS, has_any, literal

HIT_TYPE = (
    "struct<rule:int,line:int,chunk_idx:int,function_name:string,major:int,minor:int,arg:string,context:string>"
)
NO_HITS = f"cast(array() as array<{HIT_TYPE}>)"

# Order of emission: chunk packs (model rules, then heuristics) before the file pack.
CHUNK_STAGE, FILE_STAGE = 0, 1


@dataclass(frozen=True)
class RuleText:
    """Fixed properties of a rule; ``{}`` in the description stands for the hit's argument."""

    rule_id: str
    severity: str
    type: str
    description: str
    source: str = ""
    stage: int = CHUNK_STAGE
    pack: int = 0
    group: int = 0


@dataclass(frozen=True)
class LineTest:
    """A rule over one line: ``when`` is the condition in SQL.

    ``needs`` are substrings of which the line must have one; they are tested first.
    """

    rule_id: str
    when: str
    needs: tuple[str, ...] = ()
    line: str = "line_no"
    minor: int = 0
    arg: str = "null"
    context: str = "null"


def hit(number: int | str, line: str, major: str, minor: str | int, arg: str = "null", context: str = "null") -> str:
    """A hit; ``chunk_no`` and ``chunk_name`` are bound where the rule is evaluated."""
    return (
        f"named_struct('rule', {number}, 'line', {line}, 'chunk_idx', chunk_no, 'function_name', chunk_name, "
        f"'major', {major}, 'minor', {minor}, 'arg', cast({arg} as string), 'context', cast({context} as string))"
    )


def concat_hits(parts: list[str]) -> str:
    if not parts:
        return NO_HITS
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def _by_test(tests: list[LineTest], field: str, usual: str) -> str:
    """The field of the test numbered ``test``: one value for most, others by their number."""
    others = [(n, getattr(t, field)) for n, t in enumerate(tests) if getattr(t, field) != usual]
    if not others:
        return usual
    grouped: dict[str, list[str]] = {}
    for n, value in others:
        grouped.setdefault(value, []).append(str(n))
    return "case " + " ".join(f"when test in ({', '.join(ns)}) then {v}" for v, ns in grouped.items()) + f" else {usual} end"


def compile_tests(tests: list[LineTest], numbers: dict[str, int], text: str, major: str = "pos") -> str:
    """All hits of a line as one array.

    Tests sharing ``needs`` are skipped together; a test that holds gives its number, and only numbers are
    turned into hits, by lists of the tests' rules and places.
    """
    gates: dict[tuple[str, ...], list[str]] = {}
    for n, test in enumerate(tests):
        gates.setdefault(test.needs, []).append(f"if({test.when}, {n}, null)")
    parts = []
    for needs, cases in gates.items():
        held = f"filter(array({', '.join(cases)}), test -> test is not null)"
        parts.append(f"if({has_any(text, needs)}, {held}, {NO_INTS})" if needs else held)
    held = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    listed = lambda values: f"get(array({', '.join(map(str, values))}), test)"
    emit = hit(
        listed(numbers[t.rule_id] for t in tests), _by_test(tests, "line", "line_no"), major, listed(t.minor for t in tests),
        _by_test(tests, "arg", "null"), _by_test(tests, "context", tests[-1].context),
    )
    return f"transform({held}, test -> {emit})"


# A finding as it leaves the rules; ``ordinal`` is its place in the order of emission.
FINDING_FIELDS = (
    "chunk_idx", "function_name", "context_lines", "line", "severity", "type", "description", "context", "confidence",
    "source", "rule_id", "ordinal",
)


def _looked_up(rules: list[RuleText], field: str) -> str:
    """The field of the hit's rule, from a list of this field's values."""
    values = [getattr(r, field) for r in rules]
    numbers = all(isinstance(v, int) for v in values)
    return f"get(array({', '.join(str(v) if numbers else literal(v) for v in values)}), hit.rule)"


def finding(rules: list[RuleText], context_lines: str = "null") -> str:
    """The finding of ``hit`` by the fixed rule list, a struct of FINDING_FIELDS."""
    order = {
        "stage": _looked_up(rules, "stage"), "chunk_idx": "coalesce(hit.chunk_idx, 0)", "pack": _looked_up(rules, "pack"),
        "grp": _looked_up(rules, "group"), "major": "hit.major", "minor": "hit.minor", "tie": "coalesce(hit.arg, '')",
    }
    described = f"replace({_looked_up(rules, 'description')}, '{{}}', coalesce(hit.arg, ''))"
    fields = {
        "chunk_idx": "hit.chunk_idx", "function_name": "hit.function_name",
        "context_lines": f"cast({context_lines} as array<string>)", "line": "hit.line",
        "severity": _looked_up(rules, "severity"), "type": _looked_up(rules, "type"), "description": described,
        "context": "hit.context", "confidence": "1.0D", "source": _looked_up(rules, "source"),
        "rule_id": _looked_up(rules, "rule_id"),
        "ordinal": "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in order.items()) + ")",
    }
    return "named_struct(" + ", ".join(f"'{name}', {fields[name]}" for name in FINDING_FIELDS) + ")"
