"""Findings after the rules: filter, enrich, deduplicate, order, suggest fixes.

Each step is SQL text over the fields of a finding: plain columns where findings are rows, fields of ``x``
where they are still the array in their file's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind, has_any, literal
from ..options import SEVERITY_WEIGHTS, ScanOptions

# Contexts in which a low integer overflow is no finding.
SAFE_CONTEXTS = ("for (", "while (", "if (", "printf(", "sizeof(")
# CWE number by substring of the lower-case type, first match counts.
CWE_NUMBERS = {
    "buffer overflow": "CWE-120",
    "use after free": "CWE-416",
    "memory leak": "CWE-401",
    "format string": "CWE-134",
    "integer overflow": "CWE-190",
    "command injection": "CWE-78",
    "null pointer": "CWE-476",
}
# Fixes for buffer overflows by substring of the lower-case description.
BUFFER_FIXES = {
    "gets": "Replace gets() with fgets() and specify buffer size",
    "strcpy": "Replace strcpy() with strncpy() or use safer alternatives like strlcpy()",
    "strcat": "Replace strcat() with strncat() and check buffer bounds",
    "sprintf": "Replace sprintf() with snprintf() to prevent buffer overflow",
}
BUFFER_FALLBACK = "Address buffer overflow vulnerability"
# Fixes by substring of the lower-case type, first match counts.
FIXES = {
    "use after free": "Set pointer to NULL after free() and check for NULL before use",
    "memory leak": "Ensure every malloc()/calloc() has a corresponding free()",
    "format string": 'Use printf("%s", user_input) instead of printf(user_input)',
    "command injection": "Avoid system() calls with user input; use safer alternatives",
    "integer overflow": "Use appropriate data types and check bounds before arithmetic operations",
}
GENERAL_FIX = "Review code for security best practices"

FILE_SOURCE = "pattern"


def first_match(text: str, values: dict[str, str]) -> str:
    """Value of the first key that is a substring of ``text``, else null."""
    return "case " + " ".join(f"when contains({text}, {literal(k)}) then {literal(v)}" for k, v in values.items()) + " end"


def rank_of(severity: str) -> str:
    whens = " ".join(f"when {literal(name)} then {rank}" for rank, name in enumerate(SEVERITY_WEIGHTS))
    return f"case {severity} {whens} else {len(SEVERITY_WEIGHTS)} end"


def severity_rank(severity: Column) -> Column:
    ranks = {name: rank for rank, name in enumerate(SEVERITY_WEIGHTS)}
    return F.coalesce(*[F.when(severity == name, rank) for name, rank in ranks.items()], F.lit(len(ranks)))


def is_false_positive(x: str = "") -> str:
    """Low integer overflows in safe contexts, and null pointers without a context."""
    text, place = f"lower(coalesce({x}description, ''))", f"lower(coalesce({x}context, ''))"
    safe_overflow = f"contains({text}, 'integer overflow') and {x}severity = 'LOW' and {has_any(place, SAFE_CONTEXTS)}"
    return f"(coalesce({safe_overflow}, false) or (contains({text}, 'null pointer') and {place} = ''))"


def is_kept(x: str = "") -> str:
    """The filter applies to chunk findings only; file patterns are kept as they are."""
    return f"({x}source = '{FILE_SOURCE}' or not {is_false_positive(x)})"


def is_wanted(options: ScanOptions, x: str = "") -> str:
    """Confidence threshold and ignored patterns."""
    wanted = ["true"]
    if options.confidence_threshold > 0:
        wanted.append(f"coalesce({x}confidence, 1.0D) >= {options.confidence_threshold}D")
    if options.ignore_patterns:
        place = f"concat_ws('\\n', {x}context, {x}function_name)"
        wanted.append(f"not {has_any(place, options.ignore_patterns)}")
    return " and ".join(wanted)


def cwe_of(x: str = "") -> str:
    """CWE number by type, for chunk findings only."""
    return f"if({x}source <> '{FILE_SOURCE}', {first_match(f'lower({x}type)', CWE_NUMBERS)}, null)"


def fix_of(x: str = "") -> str:
    kind = f"lower({x}type)"
    buffer_fix = f"coalesce({first_match(f'lower({x}description)', BUFFER_FIXES)}, {literal(BUFFER_FALLBACK)})"
    other = f"coalesce({first_match(kind, FIXES)}, {literal(GENERAL_FIX)})"
    return f"if(contains({kind}, 'buffer overflow'), {buffer_fix}, {other})"


def drop_false_positives(findings: DataFrame) -> DataFrame:
    return findings.where(is_kept())


def with_cwe(findings: DataFrame) -> DataFrame:
    return findings.withColumn("cwe", F.expr(cwe_of()))


def with_fixes(findings: DataFrame) -> DataFrame:
    return findings.withColumn("suggested_fix", F.expr(fix_of()))


def deduplicate(findings: DataFrame) -> DataFrame:
    """The first finding in emission order per file, line and type, for findings that are rows.

    Findings still in their file's row need no shuffle: see ``listed``.
    """
    place = Window.partitionBy("file_id", "line", "type").orderBy("ordinal")
    return findings.withColumn("__nth", F.row_number().over(place)).where("__nth = 1").drop("__nth")


def ranked(findings: DataFrame) -> DataFrame:
    """Global order by file, line, severity and place."""
    return findings.orderBy("file_id", "line", severity_rank(F.col("severity")), "ordinal")


def apply_options(findings: DataFrame, options: ScanOptions) -> DataFrame:
    """Confidence threshold, ignored patterns and the context switch."""
    kept = findings.where(is_wanted(options))
    return kept if options.include_context else kept.withColumn("context", F.lit(None).cast("string"))


def finish_findings(raw: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Raw findings to the final list: filtered, deduplicated, enriched, with fixes."""
    return with_fixes(with_cwe(deduplicate(apply_options(drop_false_positives(raw), options))))


def listed(found: str, options: ScanOptions = ScanOptions()) -> str:
    """SQL of a file's final findings in report order, from the array of its raw findings.

    Filter, deduplication by one sort, enrichment and order all stay inside the row.
    """
    kept = f"filter({found}, x -> {is_kept('x.')} and {is_wanted(options, 'x.')})"
    placed = f"sort_array(transform({kept}, x -> named_struct('line', x.line, 'type', x.type, 'ordinal', x.ordinal, 'x', x)))"
    before = "get(placed, i_place - 1)"
    firsts = f"filter(placed, (place, i_place) -> i_place = 0 or not (place.line <=> {before}.line and place.type <=> {before}.type))"
    shown = ("chunk_idx", "function_name", "context_lines", "severity", "type", "description", "confidence", "source", "rule_id")
    final = (
        f"named_struct('line', x.line, 'rank', {rank_of('x.severity')}, 'ordinal', x.ordinal, "
        + ", ".join(f"'{c}', x.{c}" for c in shown)
        + f", 'context', {'x.context' if options.include_context else 'cast(null as string)'}, "
        f"'cwe', {cwe_of('x.')}, 'suggested_fix', {fix_of('x.')})"
    )
    return bind(f"sort_array(transform({firsts}.x, x -> {final}))", placed=placed)
