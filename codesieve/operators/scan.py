"""Evaluation of the rule packs: a file's row gets the array of its findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, let, split_lines
from ..options import ALL_PACKS, HEURISTIC_PACK, MODEL_PACK, ScanOptions
from . import heuristic_rules, model_rules, pattern_rules
from .findings import RuleText, compile_tests, concat_hits, finding
from .heuristic_rules import HEURISTIC_LINE_RULES
from .model_rules import MODEL_LINE_RULES
from .pattern_rules import PATTERN_LINE_RULES
from .segment import with_chunks
from .units import Cutter, around, chunk_hits, file_hits

LINE_RULES = MODEL_LINE_RULES | HEURISTIC_LINE_RULES | PATTERN_LINE_RULES


def rule_list() -> list[RuleText]:
    """All rules in a fixed order; a hit names its rule by the place in this list."""
    return [*model_rules.rule_texts(), *heuristic_rules.rule_texts(), *pattern_rules.rule_texts()]


def _compiled(packs: frozenset[str], only: set[str] | None) -> dict[str, str | None]:
    """SQL of the hits of each scope, None where no rule of it is wanted."""
    numbers = {rule.rule_id: n for n, rule in enumerate(rule_list())}

    def wanted(rule_id: str) -> bool:
        return rule_id[0] in packs and (only is None or rule_id in only)

    def lines(tests, text: str) -> str | None:
        kept = [t for t in tests if wanted(t.rule_id)]
        return compile_tests(kept, numbers, text) if kept else None

    return {
        "chunk": heuristic_rules.heuristic_chunk_hits(numbers, wanted),
        "chunk_line": lines([*model_rules.model_tests(), *heuristic_rules.heuristic_tests()], "line"),
        "file": pattern_rules.pattern_file_hits(numbers, wanted),
        "file_line": lines(pattern_rules.pattern_tests(), "low"),
    }


def with_findings(
    files: DataFrame, options: ScanOptions = ScanOptions(), only: set[str] | None = None, cutter: Cutter = with_chunks,
    packs: frozenset[str] | None = None, count_chunks: bool = False,
) -> DataFrame:
    """Adds ``found``, all findings of a file before any filter, and ``chunks`` if they are cut.

    A narrow plan that reads the text once. ``packs`` takes the place of those in the options; chunks are
    cut for packs that look at them, or where they are to be counted.
    """
    packs = options.packs if packs is None else packs
    scopes, reach = _compiled(packs, only), options.max_context_lines
    rest = files.columns
    hits = file_hits("content", "unit_lines", scopes["file"], scopes["file_line"])
    texts = files
    if count_chunks or packs & {MODEL_PACK, HEURISTIC_PACK}:
        texts = cutter(files, options)
        rest = [*rest, "chunks"]
        if scopes["chunk"] or scopes["chunk_line"]:
            hits = f"concat({chunk_hits('chunks', scopes['chunk'], scopes['chunk_line'])}, {hits})"
    near = f"if(hit.line > 0, {around('unit_lines', 'hit.line', reach)}, null)" if reach else "null"
    found = let(hits, "hits", f"transform(hits, hit -> {finding(rule_list(), near)})")
    return texts.select(*rest, F.expr(let(split_lines("content"), "unit_lines", found)).alias("found"))


def raw_findings(
    files: DataFrame, options: ScanOptions = ScanOptions(), only: set[str] | None = None,
    cutter: Cutter = with_chunks,
) -> DataFrame:
    """Findings of all packs over files(file_id, content), before any filter, one row each; a narrow plan."""
    scanned = with_findings(files.select("file_id", "content"), options, only, cutter)
    return scanned.select("file_id", F.explode("found").alias("x")).select("file_id", "x.*")


def line_findings(lines: DataFrame, only: set[str]) -> DataFrame:
    """Findings of line-only rules over lines(file_id, line_no, line), batch or streaming.

    There is no chunk, so all lines are in chunk 0.
    """
    unknown = only - LINE_RULES
    if unknown:
        raise ValueError(f"not line-only rules: {sorted(unknown)}")
    scopes = _compiled(ALL_PACKS, only)
    parts = []
    if scopes["chunk_line"]:
        parts.append(bind(scopes["chunk_line"], chunk_no="0", chunk_name="''", pos="line_no"))
    if scopes["file_line"]:
        parts.append(bind(scopes["file_line"], chunk_no="0", chunk_name="''", pos="line_no", low="lower(line)"))
    found = let(concat_hits(parts), "hits", f"transform(hits, hit -> {finding(rule_list())})")
    return lines.select("file_id", F.expr(f"explode({found})").alias("x")).select("file_id", "x.*")
