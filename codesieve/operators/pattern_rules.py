"""Rule pack X: patterns on the raw lines of a file, handle and memory balance, thread use."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.text import bind, has_any, let, literal, strip
from .findings import FILE_STAGE, NO_HITS, LineTest, RuleText, concat_hits, hit

SOURCE, PACK = "pattern", 2
(
    CRYPTO_GROUP, INPUT_GROUP, HANDLE_GROUP, MEMORY_GROUP, SHARED_GROUP, NO_SYNC_GROUP, RACE_GROUP,
) = range(7)

# Crypto patterns on the lower-case line, rules X1 to X4 in order.
CRYPTO_PATTERNS = {
    "X1": ("Weak Random", (r"rand\(\)", r"random\(\)")),
    "X2": ("Hardcoded Secret", (r"""password\s*=\s*["']""", r"""key\s*=\s*["']""", r"""token\s*=\s*["']""")),
    "X3": ("Weak Hash", (r"md5\(", r"sha1\(")),
    "X4": ("Insecure Protocol", ("http://", "ftp://", "telnet")),
}
# Input patterns in any case, rules X5 to X7 in order.
INPUT_PATTERNS = {
    "X5": (
        "Missing Input Validation", "MEDIUM",
        ("scanf", r"atoi\s*\(", r"strtol\s*\("),
    ),
    # First word, a plus, and last word, in this order on the line.
    "X6": ("SQL Injection Risk", "HIGH", (("sql", "user"), ("query", "input"), ("execute", "param"))),
    # Calls with two dots in their first argument.
    "X7": ("Path Traversal", "MEDIUM", ("fopen", "open", "access")),
}
# A line must have one of these for X7.
FILE_OPERATIONS = ("fopen", "open", "access", "stat", "chdir")
# Open and close patterns, type and text of the balance rules X8 and X9.
BALANCES = {
    "X8": (
        r"(?<!\w)(\w++)\s*+=\s*+fopen\s*+\(", r"fclose\s*\(\s*(\w+)",
        "Resource Leak", 'File handle "{}" may not be properly closed',
    ),
    "X9": (
        r"(?<!\w)(\w++)\s*+=\s*+(?:malloc|calloc|realloc)\s*+\(", r"free\s*\(\s*(\w+)",
        "Memory Leak", 'Allocated memory "{}" may not be freed',
    ),
}
# Race idioms in any case, rules X12 to X14 in order.
RACE_PATTERNS = {
    "X12": (r"sleep\s*\(\s*\d+\s*\)", "Sleep-based synchronization (unreliable)"),
    "X13": (r"volatile\s+(?!sig_atomic_t)", "Volatile without proper synchronization"),
    "X14": (r"signal\s*\(", "Signal handler without async-signal-safe functions"),
}
# Pattern and texts of the thread rules X10 and X11.
RACE_TYPE = "Race Condition"
SHARED_STATE = r"(global|static)\s+\w+"
SHARED_STATE_TEXT = "Global/static variable access in multi-threaded context"
NO_SYNC_TEXT = "Multi-threading detected without synchronization primitives"

# Substrings (lower case) of which a line must have one before a pattern is tried.
STEMS = {
    "X1": ("rand",), "X2": ("password", "key", "token"), "X3": ("md5(", "sha1("), "X4": ("tp://", "telnet"),
    "X5": ("scanf", "atoi", "strtol"), "X6": ("+",), "X7": ("..",),
    "X12": ("sleep",), "X13": ("volatile",), "X14": ("signal",),
}
BALANCE_STEMS = {"X8": ("fopen", "fclose"), "X9": ("alloc", "free")}
PATTERN_LINE_RULES = {*CRYPTO_PATTERNS, *INPUT_PATTERNS, *RACE_PATTERNS}


def rule_texts() -> list[RuleText]:
    def text(rule_id: str, severity: str, kind: str, description: str, group: int) -> RuleText:
        return RuleText(rule_id, severity, kind, description, SOURCE, FILE_STAGE, PACK, group)

    return [
        *[
            text(i, "MEDIUM", kind, f"Potential {kind.lower()} detected", CRYPTO_GROUP)
            for i, (kind, _) in CRYPTO_PATTERNS.items()
        ],
        *[
            text(i, severity, kind, f"{kind} vulnerability detected", INPUT_GROUP)
            for i, (kind, severity, _) in INPUT_PATTERNS.items()
        ],
        text("X8", "MEDIUM", *BALANCES["X8"][2:], HANDLE_GROUP),
        text("X9", "MEDIUM", *BALANCES["X9"][2:], MEMORY_GROUP),
        text("X10", "MEDIUM", RACE_TYPE, SHARED_STATE_TEXT, SHARED_GROUP),
        text("X11", "HIGH", RACE_TYPE, NO_SYNC_TEXT, NO_SYNC_GROUP),
        *[text(i, "MEDIUM", RACE_TYPE, words, RACE_GROUP) for i, (_, words) in RACE_PATTERNS.items()],
    ]


def _joined_words(first: str, last: str) -> str:
    """Whether ``low`` has ``first``, then a plus, then ``last``, in time linear in the line.

    Any match is one between the first ``first`` and the last ``last`` after it.
    """
    rest = f"substr(low, locate('{first}', low) + {len(first)})"
    inside = f"left({rest}, length({rest}) - length(substring_index({rest}, '{last}', -1)) - {len(last)})"
    return f"contains(low, '{first}') and contains({rest}, '{last}') and contains({inside}, '+')"


def _second_argument(name: str) -> str:
    """Whether ``low`` has the name, a bracket, the next comma, and then a closed, not empty rest.

    Cut at commas, a part that ends in an open call is followed by one that does not start with a closing
    bracket, and some later part has one.
    """
    last = "array_size(parts) - array_size(split(substring_index(low, ')', -1), ',', -1))"
    opened = f"parts[i] rlike {literal(name + r'\s*+\(')} and not startswith(parts[i + 1], ')')"
    some = f"exists(sequence(0, last - 1), i -> {opened})"
    found = bind(f"last > 0 and {some}", parts="split(low, ',', -1)", last=last)
    return f"contains(low, '{name}') and contains(low, ',') and contains(low, ')') and {found}"


def _dotted_argument(name: str) -> str:
    """Whether ``low`` has the name, a bracket, and two dots before the next comma or closing bracket.

    A closing bracket must follow, so the line is cut at its last one, and then at commas and brackets; in a
    part, only what is before its last two dots can open such a call.
    """
    closed = "left(low, length(low) - length(substring_index(low, ')', -1)))"
    before = "left(part, length(part) - length(substring_index(part, '..', -1)) - 2)"
    opened = f"{before} rlike {literal(name + r'\s*+\(')}"
    parts = f"exists(split({closed}, '[,)]', -1), part -> contains(part, '..') and {opened})"
    return f"contains(low, '{name}') and contains(low, ')') and {parts}"


def pattern_tests() -> list[LineTest]:
    """Tests on a file's line; ``low`` is the line in lower case, which must have a rule's stem."""
    context = strip("line")
    tests: list[LineTest] = []

    def add(rule_id: str, minor: int, when: str) -> None:
        tests.append(LineTest(rule_id, when, STEMS.get(rule_id, ()), minor=minor, context=context))

    minor = 0
    for rule_id, (_, patterns) in CRYPTO_PATTERNS.items():
        for pattern in patterns:
            add(rule_id, minor, f"low rlike {literal(pattern)}")
            minor += 1
    for rule_id, (_, _, patterns) in INPUT_PATTERNS.items():
        for pattern in patterns:
            if rule_id == "X6":
                test = _joined_words(*pattern)
            elif rule_id == "X7":
                test = f"{has_any('line', FILE_OPERATIONS)} and {_dotted_argument(pattern)}"
            elif pattern == "scanf":
                test = _second_argument(pattern)
            else:
                test = f"line rlike {literal('(?id)' + pattern)}"
            add(rule_id, minor, test)
            minor += 1
    add("X10", 0, f"line_no >= first_thread and line rlike {literal('(?i)' + SHARED_STATE)}")
    for minor, (rule_id, (pattern, _)) in enumerate(RACE_PATTERNS.items()):
        add(rule_id, minor, f"line rlike {literal('(?id)' + pattern)}")
    return tests


def balance_hits(rule_ids: list[str], numbers: dict[str, int]) -> str:
    """One hit at line 0 per name whose last opening lies after its last closing, for each of the rules.

    The first match of a line counts, and an opening comes before a closing of the same line.
    """

    def events(pattern: str, stem: str, kind: int) -> str:
        found = (
            f"transform(filter(body, x -> contains(x.line, {stem})), x -> named_struct("
            f"'var', regexp_extract(x.line, {pattern}, 1), 'line_no', x.line_no, 'kind', {kind}))"
        )
        return f"filter({found}, x -> x.var <> '')"

    # Sorted by name and line, the last event of each name tells whether it stays open.
    both = f"sort_array(concat({events('pair.opening', 'pair.open_stem', 0)}, {events('pair.closing', 'pair.close_stem', 1)}))"
    left_open = (
        "filter(events, (event, i_event) -> event.kind = 0 "
        "and coalesce(get(events, i_event + 1).var <> event.var, true))"
    )
    found = let(both, "events", f"transform({left_open}, event -> {hit('pair.rule', '0', '0', 0, 'event.var')})")
    rows = ", ".join(
        f"named_struct('rule', {numbers[i]}, 'opening', {literal(BALANCES[i][0])}, 'closing', {literal(BALANCES[i][1])}, "
        f"'open_stem', {literal(BALANCE_STEMS[i][0])}, 'close_stem', {literal(BALANCE_STEMS[i][1])})"
        for i in rule_ids
    )
    return f"flatten(transform(filter(array({rows}), pair -> contains(line, pair.open_stem)), pair -> {found}))"


def pattern_file_hits(numbers: dict[str, int], wanted: Callable[[str], bool]) -> str | None:
    """SQL of the hits of the wanted whole-file rules on a file, None if there are none."""
    parts = []
    if balances := [i for i in BALANCES if wanted(i)]:
        parts.append(balance_hits(balances, numbers))
    if wanted("X11"):
        no_sync = hit(numbers["X11"], "first_thread", "0", 0)
        parts.append(f"if(first_thread is not null and not has_sync, array({no_sync}), {NO_HITS})")
    return concat_hits(parts) if parts else None
