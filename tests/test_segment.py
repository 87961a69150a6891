from pyspark.sql import functions as F

from codesieve.operators import segment
from codesieve.options import ScanOptions

SOURCE = """#include <stdio.h> // io
  #  include "own.h"
#define LIMIT 8
int total = 0;

static int add(int a, int b) {
    if (a > b) {
        return '}';
    }
    return a + b; /* } */ // }
}

int
spread(
    int a)
{
    puts("{ not a brace }");
}

char* glued(int a) {
    return 0;
}
/* int hidden(int a) { */
void open_end(int a) {
    int b;"""


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_chunks_of_a_source(files):
    chunks = segment.chunk_files(files(SOURCE))
    found = rows(chunks.select("chunk_idx", "chunk_type", "function_name", "start_line", "end_line"))
    assert found == [
        (0, "includes", "", 1, 3),
        (1, "function", "add", 6, 11),
        (2, "function", "if", 7, 9),
        (3, "function", "spread", 13, 18),
        (4, "global", "", 4, 25),
    ]
    text = {r.chunk_idx: r.content for r in chunks.collect()}
    assert text[0] == '#include <stdio.h>\n  #  include "own.h"\n#define LIMIT 8'
    assert text[2] == "if (a > b) {\n        return '}';\n    }"
    assert text[4].split("\n") == [
        "int total = 0;", "char* glued(int a) {", "    return 0;", "}",
        "/* int hidden(int a) { */", "void open_end(int a) {", "    int b;",
    ]


def test_control_blocks_can_be_left_out(files):
    chunks = segment.chunk_files(files(SOURCE), ScanOptions(include_control_blocks=False))
    assert [r.function_name for r in chunks.collect()] == ["", "add", "spread", ""]


def test_headers_include_unclosed_ones(files):
    found = rows(segment.function_headers(files(SOURCE)).select("line", "function_name").orderBy("line"))
    assert found == [(6, "add"), (7, "if"), (13, "spread"), (24, "open_end")]


def test_pairs_nest(files):
    pairs = segment.brace_pairs(files("a{\nb{c}\nd}\ne{")).select("level", "open_line", "close_line")
    assert sorted(rows(pairs), key=str) == [(0, 1, 3), (0, 4, None), (1, 2, 2)]


def test_empty_and_plain_texts(files):
    chunks = segment.chunk_files(files("", "\n\n", "words only\nno code"))
    assert rows(chunks.select("file_id", "chunk_type", "content")) == [(2, "global", "words only\nno code")]


def test_oversized_chunks_are_packed_by_lines(files):
    body = "\n".join(f"    x{i} = {i};" for i in range(200))
    text = f"int big(void) {{\n{body}\n}}"
    pieces = segment.chunk_files(files(text), ScanOptions(max_chunk_size=300)).orderBy("chunk_idx").collect()
    assert len(pieces) > 5
    assert {(p.chunk_type, p.function_name) for p in pieces} == {("mixed", "big")}
    assert "\n".join(p.content for p in pieces) == text
    for piece, following in zip(pieces, pieces[1:]):
        assert len(piece.content) + 1 <= 300
        assert len(piece.content) + 1 + len(following.content.split("\n")[0]) + 1 > 300
        assert following.start_line == piece.end_line + 1


def test_a_single_long_line_stays_whole(files):
    text = "short\n" + "y" * 500 + "\nend"
    pieces = segment.chunk_texts(files(text), ScanOptions(max_chunk_size=100)).collect()
    assert [len(p.content) for p in pieces] == [5, 500, 3]


def test_deep_and_broken_nesting_is_handled(files):
    deep = "{" * 20_000 + "}" * 20_000
    unclosed = "\nint f(int a) {" * 3_000
    pairs = segment.brace_pairs(files(deep, unclosed))
    counts = dict(rows(pairs.groupBy("file_id").agg(F.count("close_line"))))
    assert counts == {0: 20_000, 1: 0}


def test_long_prose_does_not_overflow(files):
    prose = "word " * 200_000 + "\n" + "lorem ipsum dolor ( sit amet " * 20_000
    assert segment.chunk_files(files(prose)).where("chunk_type = 'function'").count() == 0


def test_summary(files):
    summary = segment.chunk_summary(segment.chunk_files(files(SOURCE))).first()
    assert summary.total_chunks == 5
    assert summary.chunk_types == {"includes": 1, "function": 3, "global": 1}
    assert summary.functions == ["add", "if", "spread"]


def test_lines_keep_their_numbers(files):
    lines = segment.chunk_lines(segment.chunk_files(files(SOURCE))).where("chunk_type = 'global'")
    assert [(r.pos, r.line_no) for r in lines.collect()] == [
        (1, 4), (2, 20), (3, 21), (4, 22), (5, 23), (6, 24), (7, 25),
    ]


def test_headers_of_any_length_and_open_comments(spark, files):
    words = " ".join(f"w{n}" for n in range(17))
    long = f"int f({', '.join(f'int parameter{n}' for n in range(400))}) {{\n}}\n"
    texts = [f"{words} g(int a) {{\n}}\n", long, "int a;\nint b;\nvoid h (x)\n{\n}\n", "/* { \nvoid lost() {\n}\n"]
    found = {(r.file_id, r.function_name) for r in segment.function_headers(files(*texts)).collect()}
    assert found == {(0, "g"), (1, "f"), (2, "h")}
