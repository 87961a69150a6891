"""Text written by models or other tools: prompts, the annotation hook, and parsing to findings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE
from .findings import FINDING_FIELDS


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


# The prompt around an optional file name and the code.
PROMPT_OPENING = """You are a security expert analyzing C/C++ code for vulnerabilities.

Analyze the following C/C++ code"""
PROMPT_MIDDLE = """ and identify potential security vulnerabilities.

Focus on these common vulnerability types:
1. Buffer overflows (stack and heap)
2. Use-after-free vulnerabilities
3. Memory leaks
4. Format string vulnerabilities
5. Integer overflows/underflows
6. Null pointer dereferences
7. Race conditions
8. Input validation issues

For each vulnerability found, provide:
- Line number (if identifiable)
- Vulnerability type
- Brief explanation
- Severity level (Critical/High/Medium/Low)

Code to analyze:
```c
"""
PROMPT_CLOSING = """
```

Output format:
Line X: [SEVERITY] Vulnerability_Type - Brief explanation

If no vulnerabilities are found, respond with: "No obvious vulnerabilities detected."

Analysis:"""

# Sentinel text, line formats, severity words.
NOTHING_FOUND = "No obvious vulnerabilities detected"
# The type runs to the next dash. A line without one takes the rest of the text, so none is read twice; it
# has no description and is left out afterwards.
MAIN_FORMAT = r"(?imd)Line\s+(\d+):\s*\[(\w+)\]([^-]++)(?:-\s*(.+))?"
SEVERITY_FORMAT = r"(?id)(\d+):\s*(\w+)\s*:\s*(.+)"
PLAIN_FORMAT = r"(?id)Line\s+(\d+):\s*(.+)"
SEVERITY_WORDS = {
    "critical": "CRITICAL",
    "high": "HIGH",
    "medium": "MEDIUM",
    "med": "MEDIUM",
    "low": "LOW",
    "info": "LOW",
    "warning": "MEDIUM",
    "error": "HIGH",
}
DEFAULT_SEVERITY = "MEDIUM"
# Finding types with patterns on the lower-case description, first match counts.
TYPE_PATTERNS = {
    "Buffer Overflow": (
        r"buffer\s+overflow", r"buffer\s+overrun", r"bounds\s+check",
        r"gets\(\)", r"strcpy", r"strcat", r"sprintf",
    ),
    "Use After Free": (r"use\s+after\s+free", r"dangling\s+pointer", r"freed\s+memory"),
    "Memory Leak": (r"memory\s+leak", r"missing\s+free", r"malloc.*free"),
    "Format String": (r"format\s+string", r"printf.*user", r"format\s+specifier"),
    "Integer Overflow": (r"integer\s+overflow", r"arithmetic\s+overflow", r"signed\s+integer"),
    "Null Pointer Dereference": (r"null\s+pointer", r"dereference", r"null\s+check"),
    "Command Injection": (r"command\s+injection", r"system\(\)", r"shell\s+injection"),
    "Race Condition": (r"race\s+condition", r"thread\s+safety", r"concurrent\s+access"),
}
OTHER_TYPE = "Security Issue"
MODEL_SOURCE, FALLBACK_SOURCE = "llm", "llm_alt"

Predictor = Callable[[pd.Series], pd.Series]
Loader = Callable[[], Predictor]
# Bytes of prompts a model is given at a time.
BATCH_BYTES = 1 << 20
_loaded: dict[str, Predictor] = {}


def with_prompt(chunks: DataFrame, path: Column | None = None) -> DataFrame:
    """Adds the ``prompt`` for each chunk's ``content``."""
    return chunks.withColumn("prompt", prompt_of(F.col("content"), path))


def prompt_of(code: Column, path: Column | None = None) -> Column:
    named = F.lit("") if path is None else F.when(
        F.coalesce(path, F.lit("")) != "", F.concat(F.lit(" from file '"), path, F.lit("'"))
    ).otherwise("")
    return F.concat(F.lit(PROMPT_OPENING), named, F.lit(PROMPT_MIDDLE), code, F.lit(PROMPT_CLOSING))


def _model(key: str, predict: Predictor | None, load: Loader | None) -> Predictor:
    """The predictor of this worker; a loader is called once per worker process."""
    if load is None:
        return predict
    if key not in _loaded:
        _loaded[key] = load()
    return _loaded[key]


def _answers_of(model: Predictor, prompts: list[str]) -> list[str | None]:
    """Answers to all prompts; a batch that fails is split in halves, and a prompt that fails has none."""
    if not prompts:
        return []
    try:
        answers = list(model(pd.Series(prompts)))
        if len(answers) != len(prompts):
            raise ValueError("a model must give one answer per prompt")
        return [a if isinstance(a, str) else None for a in answers]
    except Exception:
        if len(prompts) == 1:
            return [None]
        half = len(prompts) // 2
        return _answers_of(model, prompts[:half]) + _answers_of(model, prompts[half:])


def _answered(model: Predictor, prompts: list[str], batch_bytes: int) -> list[str | None]:
    """Answers in batches of at most ``batch_bytes`` of prompts, one prompt at least."""
    answers, batch, size = [], [], 0
    for prompt in prompts:
        bytes_of = len(prompt.encode())
        if batch and size + bytes_of > batch_bytes:
            answers += _answers_of(model, batch)
            batch, size = [], 0
        batch.append(prompt)
        size += bytes_of
    return answers + _answers_of(model, batch)


def annotate(
    prompts: DataFrame, predict: Predictor | None = None, load: Loader | None = None, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Text of a user-supplied model for each prompt.

    ``predict`` maps a batch of prompts to texts; ``load`` makes such a function once in each worker. A
    prompt on which the model fails has a null text: no findings, but told apart from an empty answer.
    """
    keep = [c for c in ("file_id", "chunk_idx", "function_name", "start_line") if c in prompts.columns]
    keys = prompts.select(*keep, "prompt")
    schema, key = keys.drop("prompt").schema.add("text", "string"), uuid4().hex

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(key, predict, load)
        for frame in frames:
            yield frame.drop(columns="prompt").assign(text=_answered(model, list(frame["prompt"]), batch_bytes))

    return keys.mapInPandas(batches, schema)


def with_answers(
    scanned: DataFrame, predict: Predictor | None = None, load: Loader | None = None, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Adds ``answers``, what the model says about each of ``chunks``: the prompts of a file stay in its row."""
    key = uuid4().hex

    def answer(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(key, predict, load)
        for prompts in columns:
            flat = _answered(model, [p for of_file in prompts for p in of_file], batch_bytes)
            ends = prompts.map(len).cumsum()
            yield pd.Series([flat[end - len(p) : end] for p, end in zip(prompts, ends)], dtype=object)

    ask = F.pandas_udf(answer, "array<string>")
    content = lambda c: F.array_join(c["lines"]["line"], "\n")
    prompted = scanned.withColumn("prompts", F.transform("chunks", lambda c: prompt_of(content(c))))
    said = prompted.withColumn("said", ask("prompts"))
    about = F.transform("chunks", lambda c, n: F.struct(
        n.alias("chunk_idx"), c["function_name"].alias("function_name"), F.array_min(c["lines"]["line_no"]).alias("start_line"),
    ))
    named = lambda a, t: F.struct(a["chunk_idx"], a["function_name"], a["start_line"], t.alias("text"))
    return said.withColumn("answers", F.zip_with(about, "said", named)).drop("prompts", "said")


def answered_findings() -> Column:
    """Findings in all ``answers`` of a file, in the shape of the rules' findings."""

    def of_answer(a: Column) -> Column:
        return F.transform(F.coalesce(_hits(a["text"], a["start_line"]), F.array()), lambda m, n: F.struct(*[
            c.alias(name) for name, c in _finding_columns(m, n, a["chunk_idx"], a["function_name"]).items()
        ]))

    return F.flatten(F.transform("answers", of_answer))


def render_findings(findings: DataFrame) -> DataFrame:
    """Findings of pack M as the text a model would give for each chunk.

    Line numbers are relative to the chunk's first line, which parsing adds back.
    """
    line = F.format_string(
        "Line %d: [%s] %s - %s", F.col("line") - F.col("start_line"), "severity", "type", "description"
    )
    rendered = findings.groupBy("file_id", "chunk_idx", "start_line").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", line.alias("text")))).alias("found")
    )
    return rendered.select(
        "file_id", "chunk_idx", "start_line",
        F.array_join(F.transform("found", lambda x: x["text"]), "\n").alias("text"),
    )


def severity_of(word: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SEVERITY_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(strip(word))), F.lit(DEFAULT_SEVERITY))


def type_of(description: Column) -> Column:
    text = F.lower(description)
    kinds = [F.when(text.rlike("(?d)" + "|".join(p)), kind) for kind, p in TYPE_PATTERNS.items()]
    return F.coalesce(*kinds, F.lit(OTHER_TYPE))


def _matches(text: Column, pattern: str, **groups: int) -> Column:
    """All matches in ``text`` that have a description, as array of structs with the named groups.

    The text is searched once; the groups come from the short matches.
    """
    found = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.struct(*[F.regexp_extract(m, pattern, g).alias(name) for name, g in groups.items()]),
    )
    return F.filter(found, lambda m: m["description"] != "")


def _hits(text: Column, start_line: Column) -> Column:
    """Findings in ``text`` as an array of structs, null for texts without any.

    The main format counts; the two fallback formats are tried only if it does not occur.
    """

    def record(m: Column, severity: Column, kind: Column, source: str) -> Column:
        return F.struct(
            (m["line"].try_cast("int") + start_line).alias("line"), severity.alias("severity"), kind.alias("type"),
            strip(m["description"]).alias("description"), F.lit(source).alias("source"),
        )

    main = F.transform(
        _matches(text, MAIN_FORMAT, line=1, severity=2, type=3, description=4),
        lambda m: record(m, severity_of(m["severity"]), strip(m["type"]), MODEL_SOURCE),
    )
    rated = F.transform(
        _matches(text, SEVERITY_FORMAT, line=1, severity=2, description=3),
        lambda m: record(m, severity_of(m["severity"]), type_of(m["description"]), FALLBACK_SOURCE),
    )
    plain = F.transform(
        _matches(text, PLAIN_FORMAT, line=1, description=2),
        lambda m: record(m, F.lit(DEFAULT_SEVERITY), type_of(m["description"]), FALLBACK_SOURCE),
    )
    said = (text != "") & ~text.contains(NOTHING_FOUND)
    # The steps are bound one after the other, so the main format is searched for once.
    chosen = F.transform(F.array(main), lambda found: F.when(F.size(found) > 0, found).otherwise(F.concat(rated, plain)))
    return F.when(said, F.get(chosen, F.lit(0)))


def _finding_columns(m: Column, seq: Column, chunk_idx: Column, function_name: Column) -> dict[str, Column]:
    """The fields of a finding; it has no context and no rule, and its place is that of the model's pack."""
    none = lambda t: F.lit(None).cast(t)
    ordinal = F.struct(
        F.lit(0).alias("stage"), F.coalesce(chunk_idx.cast("int"), F.lit(0)).alias("chunk_idx"), F.lit(0).alias("pack"),
        F.lit(0).alias("grp"), seq.cast("int").alias("major"), F.lit(0).alias("minor"), F.lit("").alias("tie"),
    )
    own = {
        "chunk_idx": chunk_idx.cast("int"), "function_name": function_name, "context_lines": none("array<string>"),
        "context": none("string"), "confidence": F.lit(1.0), "rule_id": none("string"), "ordinal": ordinal,
    }
    return {name: own[name] if name in own else m[name] for name in FINDING_FIELDS}


def parse_model_text(responses: DataFrame) -> DataFrame:
    """responses(file_id, start_line, text) to findings in the shape of all others."""
    given = {"chunk_idx": "int", "function_name": "string"}
    kept = [c for c in responses.columns if c not in ("text", "start_line", *given)]
    rows = responses.select(
        *kept, *[(F.col(c) if c in responses.columns else F.lit(None).cast(t)).alias(c) for c, t in given.items()],
        F.posexplode(_hits(F.col("text"), F.col("start_line"))).alias("seq", "m"),
    )
    columns = _finding_columns(F.col("m"), F.col("seq"), F.col("chunk_idx"), F.col("function_name"))
    return rows.select(*kept, "seq", *[c.alias(name) for name, c in columns.items()])
