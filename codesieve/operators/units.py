"""Where rules are evaluated: on chunks, their lines, the file and its lines, all inside the file's row.

A text is split once; look-ahead lines and chunk or file flags are bound by name next to the line a rule
looks at, so context rules need no window, no join and no row of their own. The result of a file is one
array of hits; only real hits ever become rows, and only the lines around real hits are copied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.text import bind, has_any, let, literal, newline_count
from ..options import ScanOptions
from .findings import NO_HITS
from .segment import CHUNK_LINES

Cutter = Callable[[DataFrame, ScanOptions], DataFrame]

# How far the look-ahead rules read, and the lines which start one.
LOOK_AHEAD = 20
LOOKS_AHEAD = ("alloc(", "free(", "open(")

# What marks threads and synchronisation (lower case).
THREAD_MARKS = ("pthread_create", "std::thread", "createthread")
SYNC_MARKS = ("mutex", "lock", "semaphore", "critical_section", "atomic")

# A line without any of these can meet no rule of its scope.
CHUNK_LINE_MARKS = ("(", "*", "+", "<<", "->", "[")
FILE_LINE_MARKS = ("(", "=", "+", "://")
FILE_LINE_WORDS = ("telnet", "static", "global", "volatile")

NO_CHUNK = {"chunk_no": "cast(null as int)", "chunk_name": "cast(null as string)"}


def around(file_lines: str, line_no: str, reach: int) -> str:
    """The lines at most ``reach`` away from a line."""
    first = f"greatest({line_no} - {reach}, 1)"
    return f"slice({file_lines}, {first}, {line_no} + {reach + 1} - {first}).line"


def _of_lines(lines: str, condition: str, hits: str) -> str:
    """Hits of all lines that may meet a rule; ``u`` is the line, ``i_u`` its place."""
    found = f"filter(transform({lines}, (u, i_u) -> if({condition}, {hits}, null)), x -> x is not null)"
    return f"flatten({found})"


def chunk_hits(chunks: str, of_chunk: str | None, of_line: str | None) -> str:
    """Hits on every chunk of ``chunks`` and on its lines.

    ``of_chunk`` is over ``line`` (the chunk's text) and ``body`` (its lines), ``of_line`` over ``line``,
    ``line_no``, ``pos``, ``ahead``, ``before``, ``has_null`` and ``has_seed``.
    """
    parts = []
    if of_chunk:
        parts.append(bind(of_chunk, line="chunk_text", body="unit_chunk.lines"))
    if of_line:
        looks = has_any("line", LOOKS_AHEAD)
        hits = bind(
            of_line, line="u.line", line_no="u.line_no", pos="i_u + 1",
            ahead=f"if({looks}, slice(unit_chunk.lines, i_u + 2, {LOOK_AHEAD}), cast(null as {CHUNK_LINES}))",
            before=f"if({looks}, get(unit_chunk.lines, i_u - 1).line, null)",
        )
        lines = _of_lines("unit_chunk.lines", has_any("u.line", CHUNK_LINE_MARKS), hits)
        parts.append(bind(lines, has_null="contains(upper(chunk_text), 'NULL')", has_seed="contains(chunk_text, 'srand(')"))
    if not parts:
        return NO_HITS
    both = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    named = bind(both, chunk_name="unit_chunk.function_name", chunk_text="array_join(unit_chunk.lines.line, '\\n')")
    return f"flatten(transform({chunks}, (unit_chunk, chunk_no) -> {named}))"


def first_thread_line(lowered: str) -> str:
    """Number of the first line that starts a thread, null if none does."""
    at = [
        f"if(contains({lowered}, {literal(mark)}), "
        + let(f"substring_index({lowered}, {literal(mark)}, 1)", "head", f"{newline_count('head')} + 1")
        + ", null)"
        for mark in THREAD_MARKS
    ]
    return f"least({', '.join(at)})"


def file_hits(content: str, file_lines: str, of_file: str | None, of_line: str | None) -> str:
    """Hits on the file and on its lines.

    ``of_file`` is over ``line`` (the text), ``body``, ``first_thread`` and ``has_sync``; ``of_line`` over
    ``line``, ``low``, ``line_no``, ``pos`` and ``first_thread``.
    """
    parts = []
    if of_file:
        parts.append(bind(of_file, line=content, body=file_lines))
    if of_line:
        condition = f"{has_any('u.line', FILE_LINE_MARKS)} or {has_any('lower(u.line)', FILE_LINE_WORDS)}"
        hits = bind(of_line, line="u.line", low="lower(line)", line_no="u.line_no", pos="u.line_no")
        parts.append(_of_lines(file_lines, condition, hits))
    if not parts:
        return NO_HITS
    both = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    threads = {"lowered": f"lower({content})", "first_thread": first_thread_line("lowered"), "has_sync": has_any("lowered", SYNC_MARKS)}
    return bind(both, **NO_CHUNK, **threads)
