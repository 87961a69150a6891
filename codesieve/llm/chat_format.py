"""Conversations as training text: a finite-state machine over roles and a declarative template.

Each conversation becomes a list of segments, each with a loss flag; joined they are the formatted
text. Control strings inside roles and texts are escaped, so the text can be read back exactly.

Turns are ordered by turn, then role, then text, so ties have one order; repeated rows are turns of
their own. Null texts and roles count as empty, null conversation ids form one conversation. A
conversation that breaks the turn order is still formatted and marked: ``valid`` false and
``bad_turn`` the place (from 0) of the first turn without a transition, or the number of turns if it
ends in a state that is no end. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """Control strings, trained roles, and the transitions (state, role) -> state.

    Every control string starts with ``mark``, has it nowhere else, and has no backslash. Escaping
    doubles backslashes and puts one after the mark of each control string.
    """

    open: str = "<turn>"
    middle: str = "<text>"
    close: str = "</turn>"
    mark: str = "<"
    trained: tuple[str, ...] = ("assistant",)
    transitions: tuple[tuple[str, str, str], ...] = (
        (START, "system", "briefed"), (START, "user", "asked"), ("briefed", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    )
    ends: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        for control in self.controls:
            rest = control[len(self.mark):]
            if len(self.mark) != 1 or not control.startswith(self.mark) or not rest or self.mark in rest or "\\" in control:
                raise ValueError(f"control string {control!r} must start with {self.mark!r} and have it once")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.middle, self.close)


def escaped(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in template.controls:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def _literal(control: str) -> str:
    """A regular expression for exactly this string."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in control)


def _run_machine(turns: Column, template: Template) -> Column:
    """struct(state, bad_turn) after the roles of all turns; the state is empty once a turn fails."""
    table = F.create_map(*[F.lit(x) for s, r, t in template.transitions for x in (f"{s}\n{r}", t)])

    def step(at: Column, turn: Column) -> Column:
        after = F.coalesce(F.try_element_at(table, F.concat(at["state"], F.lit("\n"), turn["role"])), F.lit(""))
        bad = F.when(at["bad_turn"] >= 0, at["bad_turn"]).when(after == "", at["seen"]).otherwise(F.lit(-1))
        return F.struct(after.alias("state"), bad.alias("bad_turn"), (at["seen"] + 1).alias("seen"))

    first = F.struct(F.lit(START).alias("state"), F.lit(-1).alias("bad_turn"), F.lit(0).alias("seen"))
    return F.aggregate(turns, first, step)


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, valid, bad_turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct("turn", text("role").alias("role"), text("text").alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def pieces(t: Column) -> Column:
        part = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template.open), escaped(t["role"], template), F.lit(template.middle))
        return F.array(
            part(head, F.lit(False)),
            part(escaped(t["text"], template), t["role"].isin(*template.trained)),
            part(F.lit(template.close), F.lit(False)),
        )

    built = grouped.select(
        "conv_id", _run_machine(F.col("turns"), template).alias("at"),
        F.flatten(F.transform("turns", pieces)).alias("segments"),
    )
    ended = F.col("at.state").isin(*template.ends)
    return built.select(
        "conv_id", "segments", F.array_join("segments.text", "").alias("formatted"), ended.alias("valid"),
        F.when(~ended, F.when(F.col("at.bad_turn") >= 0, F.col("at.bad_turn")).otherwise(F.col("at.seen"))).alias("bad_turn"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text, array<struct<role, text>>, unescaped."""
    parts = F.split(formatted, _literal(template.close), -1)
    whole = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        sides = F.split(F.substr(part, F.lit(len(template.open) + 1)), _literal(template.middle), 2)
        return F.struct(unescaped(F.get(sides, 0)).alias("role"), unescaped(F.get(sides, 1)).alias("text"))

    return F.transform(whole, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What the formatted output says, read back from it."""
    read = formatted.select(
        "conv_id", "valid", "bad_turn", read_turns(F.col("formatted"), template).alias("turns"),
        loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars", "valid", F.col("bad_turn").cast("long").alias("bad_turn"),
    )


DIGEST_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
         length(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '<text>', '<\text>'), '</turn>', '<\/turn>'))
       + length(replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '<text>', '<\text>'), '</turn>', '<\/turn>'))
       + length('<turn><text></turn>') AS chars
  FROM r
), f AS (
  SELECT *, CASE role WHEN 'system' THEN place = 0
                      WHEN 'user' THEN place = 0 OR prev = 'assistant' OR (prev = 'system' AND place = 1)
                      WHEN 'assistant' THEN prev = 'user' ELSE false END AS fine
  FROM e
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(fine) AND arg_max(role, place) = 'assistant' AS valid,
       CASE WHEN NOT bool_and(fine) THEN min(place) FILTER (NOT fine)
            WHEN arg_max(role, place) <> 'assistant' THEN count(*) END::BIGINT AS bad_turn
FROM f GROUP BY conv_id
"""
