"""Segmentation of source text into include, function and global chunks.

Each file is one row and every step works inside that row, so cutting a corpus into chunks
needs no shuffle. Lines keep their true number in the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    WHITESPACE, let, literal, match_spans, newline_count, running_max, running_sum, split_lines,
)
from ..options import ScanOptions

# Chunk types, and what counts as a directive.
INCLUDES, FUNCTION, GLOBAL, MIXED = "includes", "function", "global", "mixed"
INCLUDE_LINE = r"""^\s*#\s*include\s*[<"][^>"]*[>"]"""
DEFINE_LINE = r"^\s*#\s*define\s+\w+"
CONTROL_NAMES = ("if", "for", "while", "switch")

# All repetitions are possessive, as others recurse in java.util.regex and overflow the stack on
# prose. A run of words that turns out to be no header is consumed, too, so words are read once;
# such tokens have no brace at their end. The text to match has a newline put in front, so every
# header follows one.
FUNCTION_HEADER = (
    r"\n[ \t]*+(?:\w++\s++(?=[\w*]))*+(?:\*?\s*+(\w++)\s*+\([^)]*+\)\s*+\{)?"
)
STRING_LITERAL = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
CHAR_LITERAL = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
# An open comment runs to the end of the text.
COMMENT = r"/\*(?:[\s\S]*?\*/|[\s\S]*+)|//[^\n]*+"
# The look-ahead rejects most positions by a single test.
TOKEN = (
    r"""(?d)(?=["'/{}\n])(?:"""
    + "|".join(["[{}]", FUNCTION_HEADER, STRING_LITERAL, CHAR_LITERAL, COMMENT])
    + ")"
)

CHUNK_LINES = "array<struct<line_no:int,line:string>>"
CHUNK_ARRAY = f"array<struct<chunk_type:string,function_name:string,lines:{CHUNK_LINES}>>"
NO_CHUNKS = f"cast(array() as {CHUNK_ARRAY})"


def _brace_tokens() -> str:
    """Headers and braces of ``content`` with their lines; literals and comments left out."""
    spans = let("concat('\\n', content)", "padded", match_spans("padded", TOKEN))
    return (
        f"if(contains(content, '{{'), filter({spans}, "
        """brace -> right(brace.text, 1) in ('{', '}') and substr(brace.text, 1, 1) not in ('"', "'", '/')), """
        "cast(array() as array<struct<text:string,first:int,last:int,after:string>>))"
    )


def _levelled_tokens() -> str:
    """``tokens`` sorted by nesting level: a block's partner is then the next brace of its level."""
    depths = running_sum("transform(tokens, token -> if(token.text = '}', -1, 1))")
    levelled = (
        "array_sort(transform(bound, (token, i_token) -> named_struct("
        "'level', get(depths, i_token) - if(token.text = '}', 0, 1), 'seq', i_token, "
        "'text', token.text, 'first', token.first, 'last', token.last)))"
    )
    return let("tokens", "bound", let(depths, "depths", levelled))


def _blocks() -> str:
    """Every opening brace of ``levelled`` with its partner's line, null for a block left open."""
    header = "length(brace.text) > 1"
    margin = let(r"regexp_extract(brace.text, '^\\s*', 0)", "space", newline_count("space"))
    block = f"""named_struct(
        'seq', brace.seq, 'level', brace.level,
        'start_line', if({header}, brace.first + {margin}, brace.last),
        'open_line', brace.last,
        'close_line', {let("get(sorted, i_brace + 1)", "after", "if(after.level = brace.level and after.text = '}', after.last, null)")},
        'name', if({header}, regexp_extract(brace.text, {literal("(?d)" + FUNCTION_HEADER)}, 1), null),
        'text', brace.text)"""
    blocks = f"filter(transform(sorted, (brace, i_brace) -> {block}), block -> block.text <> '}}')"
    return let("levelled", "sorted", blocks)


def with_blocks(files: DataFrame) -> DataFrame:
    """Adds ``blocks``: the brace pairs of ``content``; ``name`` is set for function headers.

    Literals and comments are tokens of their own, so braces in them do not count. The steps
    are columns of their own only to keep each expression small; the plan stays one narrow pass.
    """
    rest = files.columns
    tokens = files.select(*rest, F.expr(_brace_tokens()).alias("tokens"))
    levelled = tokens.select(*rest, F.expr(_levelled_tokens()).alias("levelled"))
    return levelled.select(*rest, F.expr(_blocks()).alias("blocks"))


def function_ranges(options: ScanOptions) -> str:
    """Closed function ``blocks`` as array<struct<start_line, end_line, name>> in text order."""
    keep = "block.name is not null and block.close_line is not null"
    if not options.include_control_blocks:
        keep += f" and block.name not in ({', '.join(map(literal, CONTROL_NAMES))})"
    return (
        f"array_sort(transform(filter(blocks, block -> {keep}), block -> named_struct("
        "'start_line', block.start_line, 'end_line', block.close_line, 'name', block.name)))"
    )


def _chunk(kind: str, name: str, lines: str) -> str:
    return f"named_struct('chunk_type', {literal(kind)}, 'function_name', {name}, 'lines', {lines})"


def _single(kind: str, lines: str) -> str:
    return let(lines, "kept", f"""if(size(kept) > 0, array({_chunk(kind, "''", "kept")}), {NO_CHUNKS})""")


def _is(pattern: str, line: str) -> str:
    return f"(contains({line}, '#') and {line} rlike {literal(pattern)})"


def include_chunk(content: str, lines: str) -> str:
    """The include directives, then the define lines; no chunk if there are none."""
    includes = (
        f"transform(filter({lines}, x -> {_is(INCLUDE_LINE, 'x.line')}), x -> named_struct("
        f"'line_no', x.line_no, 'line', regexp_extract(x.line, {literal(INCLUDE_LINE)}, 0)))"
    )
    defines = f"filter({lines}, x -> {_is(DEFINE_LINE, 'x.line')})"
    return f"if(contains({content}, '#'), {_single(INCLUDES, f'concat({includes}, {defines})')}, {NO_CHUNKS})"


def function_chunk_array(lines: str, ranges: str) -> str:
    """One chunk of whole lines per range, without outer white space."""
    space = literal(WHITESPACE)
    head = f"if(i_x = 0, ltrim({space}, x.line), x.line)"
    line = f"if(i_x = r.end_line - r.start_line, rtrim({space}, {head}), {head})"
    body = (
        f"transform(slice({lines}, r.start_line, r.end_line - r.start_line + 1), "
        f"(x, i_x) -> named_struct('line_no', x.line_no, 'line', {line}))"
    )
    return f"transform({ranges}, r -> {_chunk(FUNCTION, 'r.name', body)})"


def global_chunk(lines: str, ranges: str) -> str:
    """Lines outside every function and not a directive, blank lines left out."""

    def before(k: str, start: str) -> str:
        return let(
            f"coalesce(get(covered, {k} - 1), 0)", "past",
            f"named_struct('at', past + 1, 'count', {start} - past - 1)",
        )

    gaps = (
        f"filter(concat(transform({ranges}, (r, i_r) -> {before('i_r', 'r.start_line')}), "
        f"array({before(f'size({ranges})', f'size({lines}) + 1')})), gap -> gap.count > 0)"
    )
    ends = running_max(f"transform({ranges}, r -> r.end_line)")
    outside = let(ends, "covered", f"flatten(transform({gaps}, gap -> slice({lines}, gap.at, gap.count)))")
    kept = (
        f"filter({outside}, x -> x.line rlike '\\\\S' "
        f"and not ({_is(INCLUDE_LINE, 'x.line')} or {_is(DEFINE_LINE, 'x.line')}))"
    )
    return _single(GLOBAL, kept)


def split_oversized(chunk: str, limit: int | None) -> str:
    """A chunk as array of chunks: itself, or greedy line packs of at most ``limit`` characters.

    Each line counts one more for its newline; a single longer line stays whole.
    """
    if limit is None:
        return f"array({chunk})"
    pack = (
        f"if(pack.used + w.size > {limit} and pack.used > 0, "
        "named_struct('used', w.size, 'at', concat(pack.at, array(w.i))), "
        "named_struct('used', pack.used + w.size, 'at', pack.at))"
    )
    starts = f"aggregate(widths, named_struct('used', 0, 'at', array(0)), (pack, w) -> {pack}, pack -> pack.at)"
    piece = (
        f"slice({chunk}.lines, start + 1, coalesce(get(starts, i_start + 1), size({chunk}.lines)) - start)"
    )
    pieces = f"transform(starts, (start, i_start) -> {_chunk(MIXED, f'{chunk}.function_name', piece)})"
    total = "aggregate(widths, 0, (total, w) -> total + w.size) - 1"
    return let(
        f"transform({chunk}.lines, (x, i_x) -> named_struct('i', i_x, 'size', length(x.line) + 1))", "widths",
        f"if({total} <= {limit}, array({chunk}), {let(starts, 'starts', pieces)})",
    )


def with_chunks(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Adds ``chunks``, all chunks of a file in order: includes, functions, global.

    Oversized ones are split in place.
    """
    rest = files.columns
    parts = (
        f"concat({include_chunk('content', 'all_lines')}, {function_chunk_array('all_lines', 'bound')}, "
        f"{global_chunk('all_lines', 'bound')})"
    )
    whole = let(split_lines("content"), "all_lines", let("ranges", "bound", parts))
    split = f"flatten(transform(whole_chunks, whole_chunk -> {split_oversized('whole_chunk', options.max_chunk_size)}))"
    ranges = with_blocks(files).select(*rest, F.expr(function_ranges(options)).alias("ranges"))
    return ranges.select(*rest, F.expr(whole).alias("whole_chunks")).select(*rest, F.expr(split).alias("chunks"))


def with_whole_text(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Adds ``chunks`` with the text as one chunk (split if oversized), for texts that are no sources."""
    one = _chunk(MIXED, "''", split_lines("content"))
    split = let(one, "whole_chunk", split_oversized("whole_chunk", options.max_chunk_size))
    return files.select("*", F.expr(split).alias("chunks"))


def explode_chunks(chunked: DataFrame) -> DataFrame:
    """Rows with ``chunks`` to one row per chunk."""
    rows = chunked.select("file_id", F.posexplode("chunks").alias("chunk_idx", "chunk"))
    return rows.select(
        "file_id",
        "chunk_idx",
        "chunk.chunk_type",
        "chunk.function_name",
        F.array_min("chunk.lines.line_no").alias("start_line"),
        F.array_max("chunk.lines.line_no").alias("end_line"),
        F.array_join("chunk.lines.line", "\n").alias("content"),
        F.col("chunk.lines").alias("lines"),
    )


def chunk_files(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """files(file_id, content) to chunks(file_id, chunk_idx, chunk_type, function_name, …)."""
    return explode_chunks(with_chunks(files, options))


def chunk_texts(texts: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Like ``chunk_files``, but cutting only by size."""
    return explode_chunks(with_whole_text(texts, options))


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """Lines of each chunk with their place in the chunk and their number in the file."""
    return chunks.select(
        "file_id", "chunk_idx", "chunk_type", "function_name", F.posexplode("lines").alias("at", "x")
    ).select(
        "file_id", "chunk_idx", "chunk_type", "function_name",
        (F.col("at") + 1).alias("pos"), "x.line_no", "x.line",
    )


def function_headers(files: DataFrame) -> DataFrame:
    """Every header found outside comments and literals, closed or not."""
    return with_blocks(files).select("file_id", F.explode("blocks").alias("b")).where(
        "b.name is not null"
    ).select("file_id", F.col("b.start_line").alias("line"), F.col("b.name").alias("function_name"))


def brace_pairs(files: DataFrame) -> DataFrame:
    """Every opening brace with the line of its partner (null if left open)."""
    return with_blocks(files).select("file_id", F.explode("blocks").alias("b")).select(
        "file_id", F.col("b.seq").alias("seq"), F.col("b.level").alias("level"),
        F.col("b.open_line").alias("open_line"), F.col("b.close_line").alias("close_line"),
    )


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """Per file: chunk total, count per type, function names in order, mean size rounded down."""
    sized = chunks.select(
        "file_id", "chunk_idx", "chunk_type", "function_name", F.length("content").alias("size")
    )
    per_type = sized.groupBy("file_id", "chunk_type").agg(
        F.count("*").alias("n"),
        F.sum("size").alias("size"),
        F.collect_list(
            F.when(F.col("function_name") != "", F.struct("chunk_idx", "function_name"))
        ).alias("named"),
    )
    return per_type.groupBy("file_id").agg(
        F.sum("n").alias("total_chunks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_type", "n")))).alias("chunk_types"),
        F.transform(
            F.array_sort(F.flatten(F.collect_list("named"))), lambda x: x["function_name"]
        ).alias("functions"),
        F.floor(F.sum("size") / F.sum("n")).alias("avg_chunk_size"),
    )
