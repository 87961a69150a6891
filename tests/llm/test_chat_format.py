"""Formatting and reading back, against plain Python."""

import hashlib

from codesieve.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, segments string"


def run(spark, rows):
    formatted = C.format_conversations(spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA))
    return {r["conv_id"]: r for r in formatted.collect()}, {r["conv_id"]: r for r in C.digests(formatted).collect()}


HARD = ["\\", "<turn>", "</turn>", "<text>", "<\\turn>", "\\<turn>", "<<turn>>", "</turn", "\\\\</turn>\\", "", "a\nb", "### Assistant:"]


def test_round_trip_of_control_strings(spark):
    rows = [(0, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HARD)]
    rows += [(1, 0, "we<text>ird\\", "x"), (1, 1, "assistant", None), (2, 0, None, None)]
    formatted, digests = run(spark, rows)
    for conv in (0, 1, 2):
        mine = [((r[2] or ""), (r[3] or "")) for r in rows if r[0] == conv]
        said = "".join(f"{role}\n{text}\n" for role, text in mine)
        loss = "".join(text for role, text in mine if role == "assistant")
        assert digests[conv]["n_turns"] == len(mine)
        assert digests[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert digests[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert digests[conv]["loss_chars"] == len(loss)
        assert digests[conv]["formatted_chars"] == len(formatted[conv]["formatted"])
        assert "".join(s["text"] for s in formatted[conv]["segments"]) == formatted[conv]["formatted"]


def test_machine_marks_wrong_orders(spark):
    orders = {
        0: ["system", "user", "assistant"], 1: ["user", "assistant", "user"], 2: ["assistant"], 3: ["user", "user", "assistant"],
        4: ["system", "system", "user"], 5: ["user", "assistant", "system", "user"], 6: ["user", "assistant"],
    }
    _, found = run(spark, [(c, i, r, "x") for c, roles in orders.items() for i, r in enumerate(roles)])
    assert {c: (r["valid"], r["bad_turn"]) for c, r in found.items()} == {
        0: (True, None), 1: (False, 3), 2: (False, 0), 3: (False, 1), 4: (False, 1), 5: (False, 2), 6: (True, None)
    }


def test_ties_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(None, 1, "assistant", "b"), (None, 1, "assistant", "a"), (None, 0, "user", "q"), (None, 0, "user", "q")]
    formatted, digests = run(spark, rows)
    assert digests[None]["n_turns"] == 4
    assert [s["text"] for s in formatted[None]["segments"] if s["loss"]] == ["a", "b"]
    assert C.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text(spark):
    _, digests = run(spark, [(0, 0, "user", "é<turn>" * 200_000), (0, 1, "assistant", "x" * 1_000_000)])
    assert digests[0]["loss_chars"] == 1_000_000 and digests[0]["valid"]
