"""Token files against the tokenizer on whole texts, and reads of parts of them."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codesieve.llm import pieces, token_files
from codesieve.llm.common import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
MARKED = ["a", "b", "'", "s", ".", "1", " ", "é", "▁", "語", "\n", "\t", "<|endoftext|>", "|", ">", ",", " a", "-"]
TOKENIZER = pieces.byte_tokenizer(PATH, False)
ENCODER = pieces.Encoder(pieces.byte_encode(TOKENIZER), pieces.token_sizes(TOKENIZER))
SCHEMA = "doc_id long, text string, ids string, part int, source string"
HARD = [
    None, "", " ", "  a", "a ", "a  b", "é b c", "a  b", "a  b", "x▁ y", "don't stop 's", "tab\t x\n y ",
    "<|endoftext|> b <|endoftext|>", "語 語 a 語", "a\u0085 b", "z　 b 　", "end",
]


@pytest.fixture(scope="module")
def whole():
    return lambda text: TOKENIZER.encode(text or "", add_special_tokens=False).ids


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 7, f"s{(i or 0) % 3}") for i, t in texts], SCHEMA)


def by_pieces(texts):
    found = pieces.cut(pa.array([t.encode() for t in texts], pa.large_binary()), at_marks=True)
    flat, counts = ENCODER.tokens(found.different)
    body = pieces.flat_take(flat, np.cumsum(counts), found.code)
    ends = np.cumsum(pieces.sums_of(counts[found.code], found.per_text)).tolist()
    return [body[a:b].tolist() for a, b in zip([0, *ends], ends)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(MARKED), max_size=9).map("".join), max_size=6))
def test_pieces_encode_like_whole_texts(texts):
    assert by_pieces(texts) == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_broken_bytes_and_failing_joins_are_encoded_one_by_one():
    found = pieces.cut(pa.array([b"a b\xff c", b" x y"], pa.large_binary()))
    whole = pieces._one_by_one(pieces.byte_encode(TOKENIZER), found.different)
    for sizes in (pieces.token_sizes(TOKENIZER), np.full(60_000, 3)):
        got = pieces.piece_tokens(pieces.byte_encode(TOKENIZER), sizes, found.different)
        assert [x.tolist() for x in got] == [x.tolist() for x in whole]


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN", 3)
    encoder = pieces.Encoder(ENCODER.encode, ENCODER.sizes)
    for text in (b"a b c d e", b"d e a x b", b"", b"c a"):
        found = pieces.cut(pa.array([text], pa.large_binary()))
        flat, counts = encoder.tokens(found.different)
        assert pieces.flat_take(flat, np.cumsum(counts), found.code).tolist() == TOKENIZER.encode(text.decode()).ids
        assert len(encoder.place) == len(encoder.ends) <= 3


def test_line_starts_are_encoded_many_at_a_time():
    calls = []
    encoder = pieces.Encoder(lambda text: calls.append(text) or ENCODER.encode(text), ENCODER.sizes, at_lines=True)
    text = "\n".join(f"Ab{chr(97 + n % 26)}{chr(97 + n // 26)}é." for n in range(600)) + " \n b\n\nc\r\nd\n e\u0085\nf"
    for _ in range(2):
        found = pieces.cut(pa.array([text.encode()], pa.large_binary()), at_marks=True)
        flat, counts = encoder.tokens(found.different)
        assert pieces.flat_take(flat, np.cumsum(counts), found.code).tolist() == TOKENIZER.encode(text).ids
    assert len(calls) < 30


@pytest.mark.parametrize("mixed", [pieces.mixed, np.zeros_like])
def test_pieces_are_told_apart_by_all_their_bytes(monkeypatch, mixed):
    monkeypatch.setattr(pieces, "mixed", mixed)
    encoder = pieces.Encoder(ENCODER.encode, ENCODER.sizes)
    texts = [b"a", b"a\0", b"a\0\0", b"", b"\0", *(b"x" * n for n in range(29, 36)), b"x" * 31 + b"y", b" " + b"x" * 31, b"x" * 31 + b"\0"]
    for _ in range(3):
        flat, counts = encoder.tokens(pa.array(texts, pa.large_binary()))
        ends = np.cumsum(counts).tolist()
        assert [flat[a:b].tolist() for a, b in zip([0, *ends], ends)] == [TOKENIZER.encode(t.decode()).ids for t in texts]


def test_round_trip_equals_whole_texts(spark, whole):
    found = {r["doc_id"]: r for r in token_files.round_trip(docs(spark, list(enumerate(HARD))), PATH, ("source", "part")).collect()}
    start = 0
    for i, text in enumerate(HARD):
        ids = [*whole(text), 2]
        assert (found[i]["start"], found[i]["n_tokens"]) == (start, len(ids))
        assert found[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_ties_null_ids_and_empty_table(spark, whole):
    rows = [(None, "b"), (3, "x y"), (3, "x y"), (3, None), (None, "a a"), (1, "k")]
    found = token_files.round_trip(docs(spark, rows), PATH).collect()
    assert sorted(r["n_tokens"] for r in found) == sorted(len(whole(t)) + 1 for _, t in rows)
    starts = sorted((r["start"], r["doc_id"]) for r in found)
    assert [i for _, i in starts] == [None, None, 1, 3, 3, 3]
    ends = sorted((r["start"] + r["n_tokens"]) for r in found)
    assert [s for s, _ in starts] == [0, *ends[:-1]]
    assert token_files.round_trip(docs(spark, []), PATH).count() == 0


def test_spans_metadata_and_long_text(spark, whole):
    texts = [(i, f"word{i} and {'more ' * (i % 5)}text") for i in range(300)] + [(300, "long text. " * 200_000)]
    folder = new_path(spark, "tokens")
    token_files.write_tokens(docs(spark, texts), folder, PATH, ("source", "ids"))
    everything = [i for _, t in texts for i in [*whole(t), 2]]
    for start, end in ((0, 10), (500, 777), (len(everything) - 5, len(everything) + 50), (9, 9)):
        got = sorted((r["start"], list(r["ids"])) for r in token_files.read_span(spark, folder, start, end).collect())
        assert [i for _, ids in got for i in ids] == everything[start:end]
    places = token_files.read_places(spark, folder)
    assert "ids" not in places.columns
    assert places.where("doc_id = 7").select("meta.source", "meta.ids").collect() == [("s1", "clash")]


def test_file_layout(spark):
    folder = new_path(spark, "tokens")
    token_files.write_tokens(docs(spark, [(i, f"a b c {i} " * 30) for i in range(5000)]), folder, PATH, row_group_bytes=1 << 17, page_rows=100)
    files = glob.glob(f"{folder.removeprefix('file:')}/tokens/*.parquet")
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in files]
    assert sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) > len(files)
    columns = {g.column(k).path_in_schema: g.column(k) for g in groups for k in range(g.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["at"].encodings
    ids = next(c for name, c in columns.items() if name.startswith("ids."))
    assert "RLE_DICTIONARY" in ids.encodings and columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index


def test_projection_and_filter_reach_the_files(spark):
    folder = new_path(spark, "tokens")
    token_files.write_tokens(docs(spark, [(i, "a b") for i in range(10)]), folder, PATH)
    plan = token_files.read_places(spark, folder).where("doc_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0] and "EqualTo(doc_id,3)" in plan
