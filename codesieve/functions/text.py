"""SQL text for work on text held in one row: trimming, line counts, match positions.

Everything stays inside the row, so nothing here causes a shuffle. The helpers return SQL
expressions as text, because one ``F.expr`` builds a large plan much faster than thousands of
single column calls. Arguments are names of columns or lambda variables unless said otherwise.
"""

from __future__ import annotations

WHITESPACE = " \t\r\n\f\x0b"
SCAN_BLOCK = 64
MARK = "\x01"
NO_INTS = "cast(array() as array<int>)"


def literal(text: str | None) -> str:
    """SQL string literal."""
    if text is None:
        return "null"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def let(value: str, name: str, body: str) -> str:
    """Evaluate the expression ``value`` once and use it as ``name`` in ``body``.

    It is the start of a fold over nothing, and ``body`` its last step. A plain projection would not do: the
    optimizer may inline it into a lambda, where it would be evaluated once per array element. Taking the
    only element of a transformed array would work out the type of ``body`` for every value.
    """
    return f"aggregate({NO_INTS}, {value}, (same, none) -> same, {name} -> {body})"


def bind(body: str, /, **values: str) -> str:
    """``body`` with each name standing for its expression; later ones may use earlier ones."""
    for name, value in reversed(values.items()):
        body = let(value, name, body)
    return body


def strip(text: str) -> str:
    return f"btrim({text}, {literal(WHITESPACE)})"


def has_any(text: str, parts) -> str:
    return "(" + " or ".join(f"contains({text}, {literal(p)})" for p in parts) + ")"


def newline_count(text: str) -> str:
    return f"if(contains({text}, '\\n'), length({text}) - length(replace({text}, '\\n', '')), 0)"


def split_lines(content: str) -> str:
    """Lines as array<struct<line_no, line>>, 1-based; a trailing empty line is kept."""
    return (
        f"transform(split({content}, '\\n', -1), "
        "(text_line, i_line) -> named_struct('line_no', i_line + 1, 'line', text_line))"
    )


def _prefix_scan(values: str, combine: str) -> str:
    """Inclusive running fold of an int array; ``combine`` is SQL in {a} and {b}, identity 0.

    Works in blocks, as appending to one growing array would copy it once per element.
    """

    def running(block: str) -> str:
        step = combine.format(a="coalesce(get(done, size(done) - 1), 0)", b="next_value")
        return f"aggregate({block}, {NO_INTS}, (done, next_value) -> concat(done, array({step})))"

    starts = f"if(size(scanned) > 0, sequence(1, size(scanned), {SCAN_BLOCK}), {NO_INTS})"
    local = f"transform({starts}, at -> {running(f'slice(scanned, at, {SCAN_BLOCK})')})"
    carry = running("transform(blocks, block -> element_at(block, -1))")
    shifted = let(
        "coalesce(get(carry, i_block - 1), 0)", "before",
        f"transform(block, x_block -> {combine.format(a='before', b='x_block')})",
    )
    joined = f"flatten(transform(blocks, (block, i_block) -> {shifted}))"
    return let(values, "scanned", let(local, "blocks", let(carry, "carry", joined)))


def running_sum(values: str) -> str:
    return _prefix_scan(values, "{a} + {b}")


def running_max(values: str) -> str:
    return _prefix_scan(values, "greatest({a}, {b})")


def _cut(content: str, regex: str) -> str:
    """Text between and in the matches, alternating: array<string> of gap, match, …, gap.

    One regex pass marks the matches, and a one-character split is cheap. A text that
    already has the mark is cut by two regex passes instead.
    """
    mark = literal(MARK)
    interleaved = let(
        f"split({content}, {regex}, -1)", "gaps",
        let(
            f"regexp_extract_all({content}, {regex}, 0)", "found",
            "concat(flatten(transform(found, (one, i_one) -> array(get(gaps, i_one), one))), "
            "array(element_at(gaps, -1)))",
        ),
    )
    marked = f"split(regexp_replace({content}, {regex}, {literal(f'{MARK}$0{MARK}')}), {mark}, -1)"
    return f"if(contains({content}, {mark}), {interleaved}, {marked})"


def match_spans(content: str, pattern: str, literal_pattern: bool = True) -> str:
    """All matches as array<struct<text, first, last, after>>, with 0-based line offsets.

    ``after`` is the text up to the next match. The pattern is a text, or an SQL expression if
    ``literal_pattern`` is off. Spark has no match-offset function; running newline counts over the text
    between and in the matches give the lines.
    """
    ends = running_sum(f"transform(parts, part -> {newline_count('part')})")
    spans = (
        "filter(transform(parts, (part, i_part) -> if(i_part % 2 = 1, named_struct('text', part, "
        "'first', get(ends, i_part - 1), 'last', get(ends, i_part), 'after', get(parts, i_part + 1)), null)), "
        "span -> span is not null)"
    )
    regex = literal(pattern) if literal_pattern else pattern
    return bind(spans, parts=_cut(content, regex), ends=ends)
