"""Conversations repaired to a grammar of roles by the cheapest edits.

Every row has at most one fault, the first of: blank (no character but white space), duplicate (role and
text of an earlier row of the conversation), truncated (the last character that is no white space ends no
sentence). Blank and duplicate rows must go. ``role_parser`` finds the edits by generalised LR parsing.

Rows of a conversation are ordered by turn, nulls first, then role, then a hash of the text; equal rows are
counted before anything is moved. The narrow facts of all rows are sorted over the tasks by range, so a long
conversation is read by many tasks, each of which passes on one character a row. Texts are moved once, to
write the repaired rows in order; they are streamed, and no task holds those of a whole conversation.

Null roles, texts and ids count as one blank where they are compared or written; rows without an id form one
conversation; rows without a turn come first. Repeated rows are duplicates, and a row that is blank, too, is
only blank. A role's initial is its first character, if that is one of the grammar; an empty role has none.
Extra columns are ignored. An empty table gives no rows; a conversation left without rows is the empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, write_table
from .role_parser import CHAT, MUST_GO, OTHER, SPOILED_OTHER, Grammar, repair

# White space, the ends of sentences, the pairs of roles that may follow each other.
WHITE = " \t\n\x0b\f\r"
NOT_WHITE = r"[^\x20\x09-\x0D]"
SENTENCE_ENDS = (".", "!", "?")
LEGAL_PAIRS = ("su", "ua", "au")
ROLE_NAMES = {"s": "system", "u": "user", "a": "assistant"}
# The damage done to a row by crc32(`conv_id:turn`) modulo 20.
DAMAGES, DROP, EMPTY, CUT, REPEAT, RETITLE = 20, 0, 1, 2, 3, 4

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
COUNTS = ("gaps", BLANK, DUPLICATE, TRUNCATED)
EDITS = "conv string, illegal long, cost long, audit string, roles string"
TURNS = "conv string, place long, role string, text string, edit string"


def keyed(conversations: DataFrame) -> DataFrame:
    """Rows with ``conv``, their conversation's id as text, and role and text without nulls."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(
        "conv_id", text("conv_id").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text")
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Keyed rows with the damage of a test: some dropped, emptied, cut, repeated or given to the user."""
    kind = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % DAMAGES
    text = F.when(kind == EMPTY, F.lit("")).when(kind == CUT, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == RETITLE, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(kind == REPEAT, 2).otherwise(1)
    left = rows.where(kind != DROP).select(
        "conv_id", "conv", "turn", role.alias("role"), text.alias("text"), F.sequence(F.lit(1), copies).alias("copies")
    )
    return left.withColumn("copies", F.explode("copies")).drop("copies")


def _is_blank() -> Column:
    return ~F.col("text").rlike(NOT_WHITE)


def faulty(rows: DataFrame) -> DataFrame:
    """One row per different row of a conversation: its number ``n``, faults, and characters for the parser.

    ``n`` rows are equal; if the first is no duplicate, the others are.
    """
    ended = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1)).isin(*SENTENCE_ENDS)
    narrow = rows.select("conv", "turn", "role", F.md5("text").alias("digest"), _is_blank().alias(BLANK), (~ended).alias("unended"))
    keys = ["conv", "turn", "role", "digest", BLANK, "unended"]
    different = write_table(narrow.groupBy(*keys).agg(F.count("*").alias("copies")), "repair-rows")
    same = ["conv", "role", "digest"]
    earliest = write_table(
        different.groupBy(*same).agg(F.min(F.struct("turn")).alias("earliest"), F.count("*").alias("n")).where("n > 1"), "repair-earliest"
    )
    placed = join_counted(different, earliest, same, "left")
    later = F.col("earliest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earliest.turn"))
    initial = F.left("role", F.lit(1))
    known = initial.isin(*CHAT.roles)
    letter = (
        F.when(known & F.col("unended"), F.upper(initial)).when(known, initial)
        .when(F.col("unended"), F.lit(SPOILED_OTHER)).otherwise(F.lit(OTHER))
    )
    copies, gone = F.col("copies"), F.col(BLANK) | later
    first = F.when(gone, F.lit(MUST_GO)).otherwise(letter)
    repeated = lambda c, n: F.repeat(c, n.cast("int"))
    return placed.select(
        "conv", "turn", "role", "digest", copies.alias("n"),
        F.when(F.col(BLANK), copies).otherwise(0).alias(BLANK),
        F.when(F.col(BLANK), 0).when(later, copies).otherwise(copies - 1).alias(DUPLICATE),
        F.when(~gone & F.col("unended"), 1).otherwise(0).alias(TRUNCATED),
        F.concat(first, repeated(F.lit(MUST_GO), copies - 1)).alias("letters"),
        repeated(F.when(known, initial).otherwise(F.lit(OTHER)), copies).alias("initials"),
    )


def counted(faults: DataFrame) -> DataFrame:
    """Gaps in the turns and the number of each fault, per conversation."""
    by_turn = faults.groupBy("conv", "turn").agg(*[F.sum(c).alias(c) for c in COUNTS[1:]])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return by_turn.groupBy("conv").agg(gaps.cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in COUNTS[1:]])


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, letters, initials) to one row per conversation of this task, its characters joined."""
    part, conv, held = TaskContext.get().partitionId(), None, ([], [])

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([conv]), pa.array([part], pa.int32()), *[pa.array(["".join(h)]) for h in held]],
            names=["conv", "part", "letters", "initials"],
        )

    for batch in batches:
        for name, *characters in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != conv:
                if conv is not None:
                    yield row()
                conv, held = name, ([], [])
            for h, c in zip(held, characters):
                h.append(c)
    if conv is not None:
        yield row()


def _edits(grammar: Grammar):
    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, letters, initials in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                legal = sum(initials[at : at + 2] in LEGAL_PAIRS for at in range(len(initials) - 1))
                rows.append((conv, max(len(initials) - 1, 0) - legal, *repair(letters, grammar)))
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "illegal", "cost", "audit", "roles"])

    return edits


def cheapest_edits(faults: DataFrame, grammar: Grammar = CHAT) -> DataFrame:
    """Per conversation: illegal neighbours, cost, audit, and the role each edit gives.

    A task's rows are a range of the order of all rows, so its rows of one conversation are neighbours.
    """
    order = ["conv", "turn", "role", "digest"]
    ordered = faults.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "letters", "initials")
    strung = ordered.mapInArrow(_strung, "conv string, part int, letters string, initials string")
    parts = F.sort_array(F.collect_list(F.struct("part", "letters", "initials")))
    joined = strung.groupBy("conv").agg(parts.alias("parts")).select(
        "conv", F.array_join("parts.letters", "").alias("letters"), F.array_join("parts.initials", "").alias("initials")
    )
    return joined.mapInArrow(_edits(grammar), EDITS)


def _written(names: dict[str, str]):
    """Rows of conversations, each after its edits (kind 0), to the repaired rows in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits: Iterator[tuple[str, str]] = iter(())
        conv, place, out = "", 0, []

        def until_row() -> tuple[str, str] | None:
            """Writes inserted rows up to the next edit of a given row."""
            nonlocal place
            for letter, role in edits:
                if letter != "I":
                    return letter, role
                out.append((conv, place, names[role], "", "insert"))
                place += 1
            return None

        def flushed() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv", "place", "role", "text", "edit"])

        for batch in batches:
            for name, kind, role, text, audit, roles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    until_row()
                    edits, conv, place = iter(zip(audit, roles)), name, 0
                    continue
                letter, given = until_row()
                if letter != "D":
                    out.append((conv, place, role if letter == "K" else names[given], text, "keep" if letter == "K" else "rerole"))
                    place += 1
            yield flushed()
        until_row()
        yield flushed()

    return write


def repaired_turns(rows: DataFrame, edits: DataFrame, names: dict[str, str] = ROLE_NAMES) -> DataFrame:
    """(conv, place, role, text, edit): the rows that are left, and the inserted ones, in order.

    Rows of one conversation stay together and in order, for whoever goes on without a shuffle.
    """
    none = lambda t: F.lit(None).cast(t)
    given = rows.select(
        "conv", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("digest"), "text",
        none("string").alias("audit"), none("string").alias("roles"),
    )
    heads = edits.select(
        "conv", F.lit(0).alias("kind"), none(rows.schema["turn"].dataType).alias("turn"), none("string").alias("role"),
        none("string").alias("digest"), none("string").alias("text"), "audit", "roles",
    )
    order = ["conv", "kind", "turn", "role", "digest"]
    dealt = heads.unionByName(given).repartition("conv").sortWithinPartitions(*order)
    return dealt.select("conv", "kind", "role", "text", "audit", "roles").mapInArrow(_written(names), TURNS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows in order to the hash of each conversation's lines."""
    conv, digest = None, None
    for batch in batches:
        done = []
        for name, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != conv:
                if conv is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = name, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["conv", "repaired_sha256"])
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])


def digests(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """Every conversation with its faults, the cheapest repair, and the hash of the repaired lines."""
    rows = keyed(conversations)
    everyone = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    rows = damaged(rows) if damage else rows
    faults = write_table(faulty(rows), "repair-faults")
    edits = write_table(cheapest_edits(faults), "repair-edits")
    hashes = repaired_turns(rows, edits).select("conv", "role", "text").mapInArrow(_hashed, "conv string, repaired_sha256 string")
    joined = everyone.join(counted(faults), "conv", "left").join(edits, "conv", "left").join(hashes, "conv", "left")
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return joined.select(
        "conv_id", *[number(c) for c in (*COUNTS, "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
