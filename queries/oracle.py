"""SQL that states each registered query in another form, over the given tables.

Line rules are single conditions, context rules are EXISTS and range joins, segmentation uses
the known positions of the code corpus, and parsed answers are compared with the columns
they were written from.
"""

from __future__ import annotations

from . import expected as E
from .corpora import CODE_FILES_SQL, CODE_LINES_SQL, CONTEXTS, MODEL_LINES_SQL, NESTED_SKELETON, SKELETON

NL = "chr(10)"
WS = "' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)"


def text(value: str) -> str:
    """SQL literal; newlines are spelled with chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "(" + f" || {NL} || ".join(parts) + ")"


def has(column: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(p)})" for p in parts) + ")"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {text(pattern)})"


def hit(
    rule: str, pack: int, group: int, major: str, minor: str, severity: str, kind: str, description: str,
    context: str, source: str, body: str, line: str = "line_no",
) -> str:
    """One rule's findings in the common shape; ``description`` and ``context`` are expressions."""
    stage = 1 if rule.startswith("X") else 0
    return (
        f"SELECT file_id, CAST({line} AS INTEGER) AS line, '{severity}' AS severity, {text(kind)} AS type, "
        f"{description} AS description, {context} AS context, '{source}' AS source, '{rule}' AS rule_id, "
        f"{stage} AS o1, {pack} AS o2, {group} AS o3, CAST({major} AS INTEGER) AS o4, CAST({minor} AS INTEGER) AS o5, "
        f"'' AS o6 FROM {body}"
    )


NONE = "CAST(NULL AS VARCHAR)"
STRIPPED = f"trim(line, {WS})"


def model_hit(rule: str, body: str, line: str = "line_no", description: str | None = None) -> str:
    severity, kind, words = E.MODEL_RULES[rule]
    minor = str(int(rule[1:]))
    return hit(
        rule, 0, 0, "line_no", minor, severity, kind, description or text(words), NONE, "llm", body, line
    )


def _next_lines(reach: int, test: str) -> str:
    return (
        "EXISTS (SELECT 1 FROM cl b WHERE b.file_id = cl.file_id AND b.line_no > cl.line_no "
        f"AND b.line_no <= cl.line_no + {reach} AND {test})"
    )


def _in_file(test: str) -> str:
    return f"cl.file_id IN (SELECT b.file_id FROM cl b WHERE {test})"


CHECKS = ("if", "!", "NULL", "ERROR", "== -1")
M_SQL = {
    "M1": model_hit("M1", f"cl WHERE {has('line', 'gets(')}"),
    "M2": model_hit("M2", f"cl WHERE {has('line', 'strcpy(')} AND NOT {has('line', 'strncpy(')}"),
    "M3": model_hit("M3", f"cl WHERE {has('line', 'strcat(')} AND NOT {has('line', 'strncat(')}"),
    "M4": model_hit("M4", f"cl WHERE {has('line', 'sprintf(')} AND NOT {has('line', 'snprintf(')}"),
    "M5": model_hit(
        "M5", f"cl WHERE line LIKE '%printf(%' AND strpos(line, '%') > 0 AND {has('line', 'input', 'buffer', 'user', 'argv')}"
    ),
    "M6": model_hit(
        "M6", f"cl WHERE {has('line', 'malloc(', 'calloc(', 'realloc(')} AND NOT {_next_lines(20, has('b.line', 'free('))}"
    ),
    "M7": model_hit(
        "M7",
        "(SELECT f.file_id, f.line_no, f.var, min(u.line_no) AS use_line FROM "
        "(SELECT file_id, line_no, regexp_extract(line, 'free\\s*\\(\\s*(\\w+)', 1) AS var FROM cl "
        "WHERE contains(line, 'free(')) f JOIN cl u ON u.file_id = f.file_id AND u.line_no > f.line_no "
        "AND u.line_no <= f.line_no + 10 AND f.var <> '' AND contains(u.line, f.var) AND NOT contains(u.line, 'free(') "
        "GROUP BY ALL)",
        "use_line", "'Variable ''' || var || ''' used after free'",
    ),
    "M8": model_hit(
        "M8", f"cl WHERE {has('line', '*', '+', '<<')} AND {has('line', 'int', 'long', 'size_t')} AND NOT {has('line', 'unsigned')}"
    ),
    "M9": model_hit(
        "M9", f"cl WHERE {has('line', '->', '*')} AND NOT {has('line', 'if')} AND NOT {_in_file(has('upper(b.line)', 'NULL'))}"
    ),
    "M10": model_hit(
        "M10", f"cl WHERE line LIKE '%[%' AND line LIKE '%]%' AND {has('line', 'scanf', 'gets', 'fgets')}"
    ),
    "M11": model_hit("M11", f"cl WHERE {has('line', 'lock(')} AND NOT {has('line', 'unlock')}"),
    "M12": model_hit("M12", f"cl WHERE {has('line', 'rand()')} AND NOT {_in_file(has('b.line', 'srand('))}"),
    "M13": model_hit(
        "M13",
        f"cl WHERE {has('line', 'fopen(', 'open(')} AND NOT EXISTS (SELECT 1 FROM cl b WHERE b.file_id = cl.file_id "
        f"AND b.line_no >= cl.line_no - 1 AND b.line_no <= cl.line_no + 3 AND {has('b.line', *CHECKS)})",
    ),
    "M14": model_hit("M14", f"cl WHERE {has('line', 'system(')}"),
    "M15": model_hit("M15", f"cl WHERE {has('line', 'exec(')}"),
    "M16": model_hit("M16", f"cl WHERE {has('line', 'popen(')}"),
}


def _heuristic() -> dict[str, str]:
    out = {}
    for n, (name, (severity, kind, reason)) in enumerate(E.DANGEROUS_CALLS.items(), 1):
        out[f"H{n}"] = hit(
            f"H{n}", 1, 0, "line_no", str(n), severity, kind,
            text(f"Use of dangerous function {name}(): {reason}"), STRIPPED, "heuristic",
            f"cl WHERE {matches('line', rf'(^|[^0-9A-Za-z_]){name}\s*\(')}",
        )
    out["H9"] = hit(
        "H9", 1, 0, "line_no", "9", "HIGH", "Format String Vulnerability",
        "fn || '() with potentially user-controlled format string'", STRIPPED, "heuristic",
        f"(SELECT *, regexp_extract(line, {text(E.FORMAT_CALL)}, 1) AS fn, "
        f"regexp_extract(line, {text(E.FORMAT_CALL)}, 2) AS arg FROM cl) "
        f"WHERE fn <> '' AND NOT {has('arg', 'stderr', 'stdout')}",
    )
    forms = " OR ".join(
        matches("line", p) for p in (r"(\w+)\s*\*=?\s*(\w+)", r"(\w+)\s*\+=?\s*(\w+)", r"(\w+)\s*<<=?\s*(\w+)")
    )
    out["H10"] = hit(
        "H10", 1, 0, "line_no", "10", "MEDIUM", "Integer Overflow",
        "'Potential integer overflow in size calculation'", STRIPPED, "heuristic",
        f"cl WHERE ({forms}) AND {has('lower(line)', 'size', 'len', 'count', 'num', 'malloc', 'alloc')}",
    )
    frees = (
        "(SELECT file_id, line_no, regexp_extract(regexp_extract(line, '\\bfree\\s*\\([^)]+\\)'), "
        "'free\\s*\\(\\s*(\\w+)', 1) AS var FROM cl)"
    )
    allocs = (
        "(SELECT file_id, line_no, regexp_extract(line, "
        "'(\\w+)\\s*=\\s*(?:malloc|calloc|realloc)\\s*\\([^)]+\\)', 1) AS var FROM cl)"
    )
    out["H12"] = hit(
        "H12", 1, 1, "line_no", "0", "MEDIUM", "Memory Leak",
        "'Allocated memory (' || var || ') may not be freed'", NONE, "heuristic",
        f"(SELECT file_id, var, max(line_no) AS line_no FROM {allocs} a WHERE var <> '' AND NOT EXISTS "
        f"(SELECT 1 FROM {frees} f WHERE f.file_id = a.file_id AND f.var = a.var) GROUP BY file_id, var)",
    )
    out["H13"] = hit(
        "H13", 1, 2, "line_no", "0", "HIGH", "Double Free",
        "'Variable ' || var || ' may be freed multiple times'", NONE, "heuristic",
        f"(SELECT *, row_number() OVER (PARTITION BY file_id, var ORDER BY line_no) AS nth FROM {frees} "
        "WHERE var <> '') WHERE nth > 1",
    )
    for n, name in enumerate(E.CHECKED_CALLS):
        out[f"H{n + 14}"] = hit(
            f"H{n + 14}", 1, 3, str(n), "line_no", "MEDIUM", "Missing Error Check",
            text(f"Return value of {name}() not checked"), NONE, "heuristic",
            f"ca WHERE {matches('line', rf'{name}\s*\([^)]*\)')} AND NOT {has('area', *E.RESULT_CHECKS)}",
        )
    for n, (word, kind) in enumerate(E.SECRET_WORDS.items()):
        out[f"H{n + 24}"] = secret(n, word, kind, "cl")
    for n, name in enumerate(E.WEAK_GENERATORS):
        out[f"H{n + 29}"] = hit(
            f"H{n + 29}", 1, 5, str(n), "0", "MEDIUM", "Weak Random Number Generator",
            text(f"Use of weak random function {name}() for security-sensitive operations"), NONE, "heuristic",
            f"(SELECT file_id, min(line_no) AS line_no FROM cl WHERE {matches('line', rf'\b{name}\s*\(\s*\)')} "
            "GROUP BY file_id)",
        )
    return out


def secret(n: int, word: str, kind: str, lines: str) -> str:
    pattern = rf"""(?i){word}\s*=\s*["'][^"']+["']"""
    return hit(
        f"H{n + 24}", 1, 4, str(n), "line_no", "HIGH", kind, text(f"{kind} detected in source code"),
        "CASE WHEN length(m) > 50 THEN m[:50] || '...' ELSE m END", "heuristic",
        f"(SELECT file_id, line_no, unnest(regexp_extract_all(line, {text(pattern)})) AS m FROM {lines})",
    )


def _pattern() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}

    def add(rule, group, minor, severity, kind, words, when, lines="cl", major="line_no"):
        out.setdefault(rule, []).append(
            hit(rule, 2, group, major, str(minor), severity, kind, text(words), STRIPPED, "pattern",
                f"{lines} WHERE {when}")
        )

    low = "lower(line)"
    for minor, (rule, kind, when) in enumerate([
        ("X1", "Weak Random", has(low, "rand()")),
        ("X1", "Weak Random", has(low, "random()")),
        ("X2", "Hardcoded Secret", matches(low, r"""password\s*=\s*["']""")),
        ("X2", "Hardcoded Secret", matches(low, r"""key\s*=\s*["']""")),
        ("X2", "Hardcoded Secret", matches(low, r"""token\s*=\s*["']""")),
        ("X3", "Weak Hash", has(low, "md5(")),
        ("X3", "Weak Hash", has(low, "sha1(")),
        ("X4", "Insecure Protocol", has(low, "http://")),
        ("X4", "Insecure Protocol", has(low, "ftp://")),
        ("X4", "Insecure Protocol", has(low, "telnet")),
    ]):
        add(rule, 0, minor, "MEDIUM", kind, f"Potential {kind.lower()} detected", when)
    operations = has("line", "fopen", "open", "access", "stat", "chdir")
    for minor, (rule, kind, severity, when) in enumerate([
        ("X5", "Missing Input Validation", "MEDIUM", matches(low, r"scanf\s*\([^,]*,\s*[^)]+\)")),
        ("X5", "Missing Input Validation", "MEDIUM", matches(low, r"atoi\s*\(")),
        ("X5", "Missing Input Validation", "MEDIUM", matches(low, r"strtol\s*\(")),
        ("X6", "SQL Injection Risk", "HIGH", f"{low} LIKE '%sql%+%user%'"),
        ("X6", "SQL Injection Risk", "HIGH", f"{low} LIKE '%query%+%input%'"),
        ("X6", "SQL Injection Risk", "HIGH", f"{low} LIKE '%execute%+%param%'"),
        ("X7", "Path Traversal", "MEDIUM", matches(low, r"fopen\s*\([^,)]*\.\.[^)]*\)") + f" AND {operations}"),
        ("X7", "Path Traversal", "MEDIUM", matches(low, r"open\s*\([^,)]*\.\.[^)]*\)") + f" AND {operations}"),
        ("X7", "Path Traversal", "MEDIUM", matches(low, r"access\s*\([^,)]*\.\.[^)]*\)") + f" AND {operations}"),
    ]):
        add(rule, 1, minor, severity, kind, f"{kind} vulnerability detected", when)
    for rule, group, opening, closing, kind, words in [
        ("X8", 2, r"(\w+)\s*=\s*fopen\s*\(", r"fclose\s*\(\s*(\w+)", "Resource Leak",
         "'File handle \"' || var || '\" may not be properly closed'"),
        ("X9", 3, r"(\w+)\s*=\s*(?:malloc|calloc|realloc)\s*\(", r"free\s*\(\s*(\w+)", "Memory Leak",
         "'Allocated memory \"' || var || '\" may not be freed'"),
    ]:
        events = (
            f"(SELECT file_id, line_no, 0 AS closes, regexp_extract(line, {text(opening)}, 1) AS var FROM cl UNION ALL "
            f"SELECT file_id, line_no, 1, regexp_extract(line, {text(closing)}, 1) FROM cl)"
        )
        found = hit(
            rule, 2, group, "0", "0", "MEDIUM", kind, words, NONE, "pattern",
            f"(SELECT file_id, var, arg_max(closes, line_no * 2 + closes) AS closed FROM {events} WHERE var <> '' "
            "GROUP BY file_id, var) WHERE closed = 0", line="0",
        )
        out[rule] = [found.replace("'' AS o6", "var AS o6")]
    threads = has("lower(line)", "pthread_create", "std::thread", "createthread")
    first = f"(SELECT file_id, min(line_no) AS first_line FROM cl WHERE {threads} GROUP BY file_id)"
    add("X10", 4, 0, "MEDIUM", "Race Condition", "Global/static variable access in multi-threaded context",
        matches(low, r"(global|static)\s+\w+"),
        f"(SELECT cl.* FROM cl JOIN {first} t ON t.file_id = cl.file_id AND cl.line_no >= t.first_line)")
    sync = has("lower(b.line)", "mutex", "lock", "semaphore", "critical_section", "atomic")
    out["X11"] = [hit(
        "X11", 2, 5, "0", "0", "HIGH", "Race Condition",
        "'Multi-threading detected without synchronization primitives'", NONE, "pattern",
        f"{first} t WHERE t.file_id NOT IN (SELECT b.file_id FROM cl b WHERE {sync})", line="first_line",
    )]
    plain = "replace(lower(line), 'volatile sig_atomic_t', '#')"
    for minor, (rule, words, when) in enumerate([
        ("X12", "Sleep-based synchronization (unreliable)", matches(low, r"sleep\s*\(\s*\d+\s*\)")),
        ("X13", "Volatile without proper synchronization", matches(plain, r"volatile\s+")),
        ("X14", "Signal handler without async-signal-safe functions", matches(low, r"signal\s*\(")),
    ]):
        add(rule, 6, minor, "MEDIUM", "Race Condition", words, when)
    return out


H_SQL = _heuristic()
X_SQL = _pattern()
AREA_SQL = """
cc AS (SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM cl GROUP BY file_id),
co AS (
  SELECT file_id, line_no, line,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY file_id ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM cl
),
ca AS (
  SELECT co.*, substr(content, CAST(off + 1 AS BIGINT), length(line) + 200) AS area
  FROM co JOIN cc USING (file_id)
)"""
ALL_RULES = [*M_SQL, *H_SQL, *X_SQL]


def rule_sql(rule: str) -> str:
    if rule in M_SQL:
        return M_SQL[rule]
    if rule in H_SQL:
        return H_SQL[rule]
    return " UNION ALL ".join(X_SQL[rule])


def hits_cte(rules: list[str]) -> str:
    """WITH clause ending in ``hits``."""
    union = "\n  UNION ALL ".join(rule_sql(r) for r in rules)
    return f"WITH {CODE_LINES_SQL},{AREA_SQL},\nhits AS ({union})"


RESULT = "file_id, line, severity, type, description, context, source, rule_id"


def rules(*names: str) -> str:
    return f"{hits_cte(list(names))} SELECT {RESULT} FROM hits"


def case_of(text_column: str, values: dict[str, str], otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN contains({text_column}, {text(k)}) THEN {text(v)}" for k, v in values.items())
    return f"CASE {whens} ELSE {otherwise} END"


CWE = f"CASE WHEN source <> 'pattern' THEN {case_of('lower(type)', E.CWE_NUMBERS)} END"
FIX = (
    f"CASE WHEN contains(lower(type), 'buffer overflow') THEN "
    f"{case_of('lower(description)', E.BUFFER_FIXES, text(E.BUFFER_FALLBACK))} "
    f"ELSE {case_of('lower(type)', E.FIXES, text(E.GENERAL_FIX))} END"
)
RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
ORDER = "o1, o2, o3, o4, o5, o6"


def final_cte(names: list[str]) -> str:
    """WITH clause ending in ``final``: deduplicated, with CWE, fix and severity rank."""
    return f"""{hits_cte(names)},
numbered AS (SELECT *, row_number() OVER (PARTITION BY file_id, line, type ORDER BY {ORDER}) AS nth FROM hits),
final AS (SELECT * EXCLUDE (nth), {CWE} AS cwe, {FIX} AS suggested_fix, {RANK} AS severity_rank
          FROM numbered WHERE nth = 1)"""


FINAL = final_cte(ALL_RULES)
COUNTS = """count(*) AS total_vulnerabilities,
 count(*) FILTER (severity = 'CRITICAL') AS critical_count, count(*) FILTER (severity = 'HIGH') AS high_count,
 count(*) FILTER (severity = 'MEDIUM') AS medium_count, count(*) FILTER (severity = 'LOW') AS low_count"""
RISK = "CAST(sum(CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 ELSE 1 END) AS BIGINT)"
COMMON = """common AS (
  SELECT file_id, arg_min(type, (-n, line, severity_rank, o1, o2, o3, o4, o5, o6)) AS most_common_type FROM (
    SELECT *, count(*) OVER (PARTITION BY file_id, type) AS n FROM final) GROUP BY file_id)"""
PLACES = """placed AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line, severity_rank, o1, o2, o3, o4, o5, o6) AS place
  FROM final)"""

DOC_LINES = f"""dl AS (
  SELECT file_id, CAST(generate_subscripts(parts, 1) AS INTEGER) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id AS file_id, string_split(text, {NL}) AS parts FROM documents))"""


def document_secrets() -> str:
    """Matches counted in the whole text; the line is found from the text before each match."""
    parts = []
    for n, (word, kind) in enumerate(E.SECRET_WORDS.items()):
        pattern = rf"""(?i){word}\s*=\s*["'][^"']+["']"""
        parts.append(f"""SELECT file_id, CAST(line_no AS INTEGER) AS line, 'HIGH' AS severity, {text(kind)} AS type,
  {text(f"{kind} detected in source code")} AS description,
  CASE WHEN length(m) > 50 THEN m[:50] || '...' ELSE m END AS context, 'heuristic' AS source, 'H{n + 24}' AS rule_id
  FROM (SELECT file_id, ms[i] AS m,
          1 + sum(length(gaps[i]) - length(replace(gaps[i], {NL}, ''))) OVER w
            + coalesce(sum(length(ms[i]) - length(replace(ms[i], {NL}, ''))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no
        FROM (SELECT doc_id AS file_id, regexp_extract_all(text, {text(pattern)}) AS ms,
                     regexp_split_to_array(text, {text(pattern)}) AS gaps, unnest(range(1, len(ms) + 1)) AS i FROM documents)
        WINDOW w AS (PARTITION BY file_id ORDER BY i))""")
    return " UNION ALL ".join(parts)


def document_x2() -> str:
    parts = []
    for word in ("password", "key", "token"):
        test = matches("lower(line)", word + r"""\s*=\s*["']""")
        parts.append(
            f"SELECT file_id, line_no AS line, 'MEDIUM' AS severity, 'Hardcoded Secret' AS type, "
            f"'Potential hardcoded secret detected' AS description, trim(line, {WS}) AS context, "
            f"'pattern' AS source, 'X2' AS rule_id FROM dl WHERE {test}"
        )
    return " UNION ALL ".join(parts)


def severity_case(column: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.SEVERITY_WORDS.items())
    return f"CASE lower({column}) {whens} ELSE 'MEDIUM' END"


def type_case(column: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(matches(f"lower({column})", p) for p in patterns) + f" THEN {text(kind)}"
        for kind, patterns in E.TYPE_PATTERNS.items()
    )
    return f"CASE {whens} ELSE '{E.OTHER_TYPE}' END"


NOTE = "note: "
PARSED = f"""WITH {MODEL_LINES_SQL},
main AS (
  SELECT file_id, num + start_line AS line, {severity_case("sev")} AS severity, kind AS type, description,
         'llm' AS source FROM ml WHERE file_id % 5 = 0),
alt AS (
  SELECT file_id, num + start_line AS line, {severity_case("sev")} AS severity,
         {type_case("description")} AS type, description, 'llm_alt' AS source FROM ml WHERE file_id % 5 = 1
  UNION ALL
  SELECT file_id, num + start_line, 'MEDIUM', {type_case("description")}, description, 'llm_alt'
  FROM ml WHERE file_id % 5 = 2
  UNION ALL
  SELECT file_id, num + start_line, 'MEDIUM', {type_case(f"description[{len(NOTE) + 1}:]")},
         description[{len(NOTE) + 1}:], 'llm_alt'
  FROM ml WHERE file_id % 5 = 2 AND starts_with(description, '{NOTE}')),
parsed AS (SELECT * FROM main UNION ALL SELECT * FROM alt)"""

# Known positions of the code corpus.
FUNCTIONS = """fn AS (
  SELECT f.file_id, x.name AS function_name, x.a AS start_line, x.b AS end_line
  FROM (SELECT DISTINCT file_id FROM cl) f,
       (VALUES ('f3', 3, 12), ('if', 5, 7), ('f13', 13, 22), ('f23', 23, 32)) x(name, a, b)
  WHERE x.name <> 'if' OR f.file_id % 3 = 0)"""
CHUNKS = f"""WITH {CODE_FILES_SQL},
{FUNCTIONS},
ch AS (
  SELECT file_id, 'includes' AS chunk_type, '' AS function_name, line_no, line, 0 AS k, 0 AS s
  FROM sl WHERE line_no <= 2
  UNION ALL
  SELECT fn.file_id, 'function', function_name, line_no, line, 1, start_line
  FROM fn JOIN sl ON sl.file_id = fn.file_id AND line_no BETWEEN start_line AND end_line
  UNION ALL
  SELECT file_id, 'global', '', line_no, line, 2, 0 FROM sl WHERE line_no >= 33 AND trim(line) <> ''),
chunks AS (
  SELECT file_id, chunk_type, function_name, k, s, min(line_no) AS start_line, max(line_no) AS end_line,
         string_agg(line, chr(10) ORDER BY line_no) AS content,
         row_number() OVER (PARTITION BY file_id ORDER BY k, s) - 1 AS chunk_idx
  FROM ch GROUP BY file_id, chunk_type, function_name, k, s)"""


def chunk_type_sql(kind: str) -> str:
    return (
        f"{CHUNKS} SELECT file_id, function_name, start_line, end_line, content FROM chunks "
        f"WHERE chunk_type = '{kind}'"
    )


# Chunk lines numbered within their chunk, for rules that take a chunk for a file.
NUMBERED = """numbered AS (
  SELECT c.file_id, c.chunk_idx, c.function_name, ch.line_no AS true_line, ch.line,
         row_number() OVER (PARTITION BY c.file_id, c.chunk_idx ORDER BY ch.line_no) AS pos
  FROM ch JOIN chunks c ON c.file_id = ch.file_id AND c.k = ch.k AND c.s = ch.s)"""
AS_FILES = "cl AS (SELECT file_id * 100 + chunk_idx AS file_id, pos AS line_no, line FROM numbered)"


def annotate_sql() -> str:
    """Pack M on the chunks: the chunk takes the place of the file in the rules."""
    parts = "\n UNION ALL ".join(M_SQL.values())
    return f"""{CHUNKS},
{NUMBERED},
hits AS (WITH {AS_FILES} {parts})
SELECT n.file_id, CAST(n.chunk_idx AS INTEGER) AS chunk_idx, n.true_line AS line, severity, type, description, h.source
FROM hits h JOIN numbered n ON h.file_id = n.file_id * 100 + n.chunk_idx AND h.line = n.pos"""


def model_scan_sql() -> str:
    """The scan with one finding per chunk with ``gets`` in place of pack M; chunks with ``popen`` fail."""
    return f"""{scan_cte([*H_SQL.values()], """
  UNION ALL
  SELECT file_id, CAST(start_line + 1 AS INTEGER), 'HIGH', 'Unsafe Input', 'gets in chunk', CAST(NULL AS VARCHAR), 'llm',
         CAST(NULL AS VARCHAR), 0, CAST(chunk_idx AS INTEGER), function_name, 0, 0, 0, 0, ''
  FROM chunks WHERE contains(content, 'gets(') AND NOT contains(content, 'popen(')""")},
failed AS (SELECT file_id, count_if(contains(content, 'popen(')) AS failed_answers FROM chunks GROUP BY file_id),
worst AS (SELECT file_id, CASE WHEN bool_or(severity = 'CRITICAL') THEN 3 WHEN bool_or(severity = 'HIGH') THEN 2 ELSE 1 END AS verdict
          FROM ordered WHERE nth = 1 GROUP BY file_id)
SELECT {RESULT}, {CWE} AS cwe, CAST(failed_answers AS BIGINT) AS failed_answers, verdict
FROM ordered JOIN failed USING (file_id) JOIN worst USING (file_id) WHERE nth = 1"""


def scan_sql() -> str:
    """Everything on the code corpus: packs M and H by chunk, X by file, then post-processing."""
    return f"""{scan_cte([*M_SQL.values(), *H_SQL.values()])}
SELECT {RESULT}, chunk_idx, function_name, {CWE} AS cwe, {FIX} AS suggested_fix FROM ordered WHERE nth = 1"""


def scan_cte(chunk_rules: list[str], further: str = "") -> str:
    by_chunk = "\n UNION ALL ".join(chunk_rules)
    by_file = "\n UNION ALL ".join(sql for parts in X_SQL.values() for sql in parts)
    return f"""{CHUNKS},
{NUMBERED},
chunk_hits AS (WITH {AS_FILES}, {AREA_SQL} {by_chunk}),
file_hits AS (WITH cl AS (SELECT file_id, line_no, line FROM sl) {by_file}),
hits AS (
  SELECT n.file_id, CAST(n.true_line AS INTEGER) AS line, severity, type, description, context, source, rule_id,
         o1, CAST(n.chunk_idx AS INTEGER) AS chunk_idx, n.function_name, o2, o3, o4, o5, o6
  FROM chunk_hits h JOIN numbered n ON h.file_id = n.file_id * 100 + n.chunk_idx AND h.line = n.pos
  UNION ALL
  SELECT file_id, line, severity, type, description, context, source, rule_id,
         o1, NULL, NULL, o2, o3, o4, o5, o6 FROM file_hits{further}),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY file_id, line, type
    ORDER BY o1, coalesce(chunk_idx, 0), o2, o3, o4, o5, o6) AS nth FROM hits)"""


def scan_documents_sql() -> str:
    """All packs over the documents, which have no braces: each is one global chunk, cut by size."""
    by_chunk = "\n UNION ALL ".join([*M_SQL.values(), *H_SQL.values()])
    by_file = "\n UNION ALL ".join(sql for parts in X_SQL.values() for sql in parts)
    return f"""WITH RECURSIVE {DOC_LINES},
shown AS (SELECT file_id, line_no, line, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS r,
                 length(line) + 1 AS w, sum(length(line) + 1) OVER (PARTITION BY file_id) AS total
          FROM dl WHERE trim(line, {WS}) <> ''),
walk AS (
  SELECT file_id, r, line_no, line, w AS used, 0 AS piece, total FROM shown WHERE r = 1
  UNION ALL
  SELECT s.file_id, s.r, s.line_no, s.line,
         CASE WHEN p.total - 1 > 3000 AND p.used + s.w > 3000 THEN s.w ELSE p.used + s.w END,
         p.piece + CASE WHEN p.total - 1 > 3000 AND p.used + s.w > 3000 THEN 1 ELSE 0 END, p.total
  FROM walk p JOIN shown s ON s.file_id = p.file_id AND s.r = p.r + 1),
numbered AS (
  SELECT file_id, piece, line_no AS true_line, line, row_number() OVER (PARTITION BY file_id, piece ORDER BY r) AS pos FROM walk),
chunk_hits AS (WITH cl AS (SELECT file_id * 1000 + piece AS file_id, pos AS line_no, line FROM numbered), {AREA_SQL} {by_chunk}),
file_hits AS (WITH cl AS (SELECT file_id, line_no, line FROM dl) {by_file}),
hits AS (
  SELECT n.file_id, n.true_line AS line, severity, type, rule_id, o1, n.piece AS chunk_idx, o2, o3, o4, o5, o6
  FROM chunk_hits h JOIN numbered n ON h.file_id = n.file_id * 1000 + n.piece AND h.line = n.pos
  UNION ALL SELECT file_id, line, severity, type, rule_id, o1, 0, o2, o3, o4, o5, o6 FROM file_hits),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY file_id, line, type ORDER BY o1, chunk_idx, o2, o3, o4, o5, o6) AS nth FROM hits)
SELECT d.source AS origin, rule_id, severity, count(*) AS n
FROM ordered o JOIN documents d ON d.doc_id = o.file_id WHERE nth = 1 GROUP BY ALL"""


def text_report_sql() -> str:
    block = (
        "'Line ' || line || ': [' || severity || '] ' || type || ' - ' || description || chr(10) "
        "|| CASE WHEN coalesce(context, '') <> '' THEN '  Context: ' || context[:100] || '...' || chr(10) ELSE '' END "
        "|| CASE WHEN cwe IS NOT NULL THEN '  CWE: ' || cwe || chr(10) ELSE '' END "
        "|| '  Fix: ' || suggested_fix || chr(10)"
    )
    head = f"{E.WIDE_RULE}\n{E.TITLE}\n# File: "
    return f"""{FINAL},
{COMMON},
{PLACES},
listed AS (SELECT file_id, string_agg({block}, chr(10) ORDER BY place) AS blocks, {COUNTS}, {RISK} AS risk
           FROM placed GROUP BY file_id)
SELECT file_id, {text(head)} || 'f' || file_id || '.c' || {text(chr(10) + "# Chunks Analyzed: 1" + chr(10) + E.WIDE_RULE + chr(10) + chr(10) + "## Summary" + chr(10) + E.NARROW_RULE + chr(10) + "Total Vulnerabilities: ")}
  || total_vulnerabilities || {text(chr(10) + "Critical: ")} || critical_count || {text(chr(10) + "High:     ")} || high_count
  || {text(chr(10) + "Medium:   ")} || medium_count || {text(chr(10) + "Low:      ")} || low_count
  || {text(chr(10) + "Risk Score: ")} || risk || {text(chr(10) + "Most Common Type: ")} || most_common_type
  || {text(chr(10) + chr(10) + "## Vulnerabilities Found" + chr(10) + E.NARROW_RULE + chr(10))} || blocks
  || {text(chr(10) + E.FOOTER_RULE + chr(10) + "Report generated at: 2024-01-01T00:00:00.000000")} AS report
FROM listed JOIN common USING (file_id)"""


SIZE_SPLIT = f"""WITH RECURSIVE {DOC_LINES},
sized AS (SELECT file_id, line_no, length(line) + 1 AS w, sum(length(line) + 1) OVER (PARTITION BY file_id) AS total FROM dl),
walk AS (
  SELECT file_id, line_no, w, w AS used, 0 AS piece, total FROM sized WHERE line_no = 1
  UNION ALL
  SELECT s.file_id, s.line_no, s.w,
         CASE WHEN p.total - 1 > 3000 AND p.used + s.w > 3000 THEN s.w ELSE p.used + s.w END,
         p.piece + CASE WHEN p.total - 1 > 3000 AND p.used + s.w > 3000 THEN 1 ELSE 0 END, p.total
  FROM walk p JOIN sized s ON s.file_id = p.file_id AND s.line_no = p.line_no + 1)
SELECT file_id, CAST(piece AS INTEGER) AS chunk_idx, min(line_no) AS start_line, max(line_no) AS end_line,
       CAST(sum(w) - 1 AS INTEGER) AS n_chars
FROM walk GROUP BY file_id, piece"""

OPTION_RULES = [*H_SQL, *X_SQL]
SCAN_OPTIONS = f"""{hits_cte(OPTION_RULES)},
kept AS (SELECT * FROM hits WHERE line > 0 AND NOT (contains(coalesce(context, ''), 'system') OR contains(coalesce(context, ''), 'sleep('))),
near AS (
  SELECT a.file_id, a.line_no, string_agg(b.line, '|' ORDER BY b.line_no) AS context_lines
  FROM cl a JOIN cl b ON a.file_id = b.file_id AND b.line_no BETWEEN a.line_no - 1 AND a.line_no + 1 GROUP BY ALL)
SELECT k.file_id, k.line, context_lines, count(*) AS total_vulnerabilities,
       CAST(sum(CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 20 WHEN 'MEDIUM' THEN 4 ELSE 1 END) AS BIGINT) AS risk_score
FROM kept k JOIN near n ON n.file_id = k.file_id AND n.line_no = k.line GROUP BY ALL"""

LINE_PATHS = """'f' || file_id || '.' || (['c', 'CPP', 'cc', 'Cxx', 'h', 'hpp', 'txt', 'c.bak'])[file_id % 8 + 1]"""
CONTEXT_LIST = "[" + ", ".join(text(c) for c in CONTEXTS) + "]"
PROMPT = (
    f"{text(E.PROMPT_OPENING)} || {text(chr(32) + 'from file ' + chr(39))} || doc_id || {text(chr(39))} || {text(E.PROMPT_MIDDLE)} || text || "
    f"{text(E.PROMPT_CLOSING)}"
)
SECRET_DOCS = f"""WITH {DOC_LINES},
ds AS ({document_secrets()}),
dx AS ({document_x2()})"""

DIRECTORY_ROLLUP = f"""{FINAL},
fl AS (SELECT DISTINCT file_id FROM cl),
lv AS (
  SELECT file_id, 'directory' AS level, '/src' AS name FROM fl
  UNION ALL SELECT file_id, 'directory', '/src/d' || (file_id % 5) FROM fl
  UNION ALL SELECT file_id, 'directory', '/src/d' || (file_id % 5) || '/e' || (file_id % 3) FROM fl
  UNION ALL SELECT file_id, 'ending', (['c', 'CPP', 'cc', 'Cxx', 'h', 'hpp', 'txt', 'bak'])[file_id % 8 + 1] FROM fl
  UNION ALL SELECT file_id, 'corpus', '' FROM fl),
ct AS (SELECT level, name, {COUNTS}, {RISK} AS risk_score FROM lv JOIN final USING (file_id) GROUP BY ALL),
ty AS (SELECT level, name, type, count(*) AS n FROM lv JOIN final USING (file_id) GROUP BY ALL),
hi AS (SELECT level, name, string_agg(type || ':' || n, ',' ORDER BY type) AS vulnerability_types,
         arg_min(type, (-n, type)) AS most_common_type FROM ty GROUP BY ALL),
nf AS (SELECT level, name, count(*) AS files FROM lv GROUP BY ALL)
SELECT level, name, files, coalesce(total_vulnerabilities, 0) AS total_vulnerabilities, coalesce(critical_count, 0) AS critical_count,
  coalesce(high_count, 0) AS high_count, coalesce(medium_count, 0) AS medium_count, coalesce(low_count, 0) AS low_count,
  coalesce(risk_score, 0) AS risk_score, coalesce(vulnerability_types, '') AS vulnerability_types,
  coalesce(most_common_type, '') AS most_common_type
FROM nf LEFT JOIN ct USING (level, name) LEFT JOIN hi USING (level, name)"""


def oracle_sql() -> dict[str, str]:
    heuristic_calls = [f"H{n}" for n in range(1, 9)]
    return {
        "source_filter": f"""WITH {CODE_LINES_SQL}, f AS (SELECT file_id, {LINE_PATHS} AS path,
            string_agg(line, chr(10) ORDER BY line_no) AS content FROM cl GROUP BY file_id)
            SELECT file_id, path, CAST(length(content) AS INTEGER) AS n_chars FROM f WHERE file_id % 8 < 6""",
        "line_split": f"WITH {DOC_LINES} SELECT file_id, line_no, line FROM dl",
        "json_report": f"""{FINAL}, {PLACES}
            SELECT file_id, 'f' || file_id || '.c' AS filename, CAST(1 AS BIGINT) AS chunks_analyzed,
              count(*) OVER (PARTITION BY file_id) AS total,
              CAST(sum(CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 ELSE 1 END)
                OVER (PARTITION BY file_id) AS BIGINT) AS risk_score,
              CAST(place AS INTEGER) AS place, line, severity, type, context, cwe FROM placed""",
        "text_report": text_report_sql(),
        "scan_options": SCAN_OPTIONS,
        "includes_chunk": chunk_type_sql("includes"),
        "function_headers": f"""WITH {CODE_FILES_SQL} SELECT file_id, line_no AS line,
            regexp_extract(line, '^(?:void )?(\\w+) ?\\(', 1) AS function_name FROM sl
            WHERE line LIKE 'void f%{{' OR line = 'if (a) {{'""",
        "brace_pairs": f"""WITH {CODE_FILES_SQL},
            b AS (SELECT file_id, line_no, regexp_replace(line, '"[^"]*"|/\\*.*\\*/', '', 'g') AS line FROM sl),
            o AS (SELECT file_id, line_no, line LIKE '%{{%' AS opens FROM b WHERE line LIKE '%{{%' OR line LIKE '%}}%'),
            d AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY file_id ORDER BY line_no)
                  - CASE WHEN opens THEN 1 ELSE 0 END AS level FROM o)
            SELECT a.file_id, CAST(a.level AS INTEGER) AS level, a.line_no AS open_line, min(c.line_no) AS close_line
            FROM d a LEFT JOIN d c ON c.file_id = a.file_id AND c.level = a.level AND NOT c.opens AND c.line_no > a.line_no
            WHERE a.opens GROUP BY a.file_id, a.level, a.line_no""",
        "function_chunks": chunk_type_sql("function"),
        "global_chunk": chunk_type_sql("global"),
        "size_split": SIZE_SPLIT,
        "chunk_order": f"""{CHUNKS} SELECT file_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, chunk_type, function_name,
            start_line FROM chunks""",
        "chunk_summary": f"""{CHUNKS}, t AS (SELECT file_id, chunk_type, count(*) AS n FROM chunks GROUP BY ALL),
            tt AS (SELECT file_id, string_agg(chunk_type || ':' || n, ',' ORDER BY chunk_type) AS chunk_types FROM t GROUP BY file_id)
            SELECT file_id, count(*) AS total_chunks, any_value(chunk_types) AS chunk_types,
              string_agg(function_name, ',' ORDER BY chunk_idx) FILTER (function_name <> '') AS functions,
              CAST(sum(length(content)) // count(*) AS BIGINT) AS avg_chunk_size
            FROM chunks JOIN tt USING (file_id) GROUP BY file_id""",
        "chunk_lines": f"""{CHUNKS} SELECT c.file_id, CAST(c.chunk_idx AS INTEGER) AS chunk_idx, c.chunk_type,
            CAST(row_number() OVER (PARTITION BY c.file_id, c.chunk_idx ORDER BY line_no) AS INTEGER) AS pos, line_no, line
            FROM ch JOIN chunks c ON c.file_id = ch.file_id AND c.k = ch.k AND c.s = ch.s""",
        "m01_gets": rules("M1"),
        "m02_strcpy": rules("M2"),
        "m03_strcat": rules("M3"),
        "m04_sprintf": rules("M4"),
        "m05_printf_user": rules("M5"),
        "m06_leak_lookahead": rules("M6"),
        "m07_use_after_free": rules("M7"),
        "m08_signed_arith": rules("M8"),
        "m09_null_deref": rules("M9"),
        "m10_array_input": rules("M10"),
        "m11_lock": rules("M11"),
        "m12_unseeded_rand": rules("M12"),
        "m13_unchecked_open": rules("M13"),
        "m14_command_calls": rules("M14", "M15", "M16"),
        "h01_dangerous_calls": rules(*heuristic_calls),
        "h09_format": rules("H9"),
        "h10_size_arith": rules("H10"),
        "h12_chunk_leak": rules("H12"),
        "h13_double_free": rules("H13"),
        "h14_unchecked_return": rules(*(f"H{n}" for n in range(14, 24))),
        "h24_secrets": rules(*(f"H{n}" for n in range(24, 29))),
        "h24_secrets_documents": f"{SECRET_DOCS} SELECT {RESULT} FROM ds",
        "h29_weak_rng": rules("H29", "H30"),
        "x01_crypto": rules("X1", "X2", "X3", "X4"),
        "x02_secrets_documents": f"{SECRET_DOCS} SELECT {RESULT} FROM dx",
        "x04_page_protocols": " UNION ALL ".join(
            f"""SELECT file_id, line, 'Insecure Protocol' AS type, trim(content, {WS}) AS context FROM (
              SELECT file_id, CAST(generate_subscripts(parts, 1) AS INTEGER) AS line, unnest(parts) AS content
              FROM (SELECT page_id AS file_id, string_split(url || {NL} || html, {NL}) AS parts FROM pages))
            WHERE contains(lower(content), '{mark}')""" for mark in ("http://", "ftp://", "telnet")
        ),
        "x05_input": rules("X5"),
        "x06_sqli": rules("X6"),
        "x07_traversal": rules("X7"),
        "x08_open_handles": rules("X8"),
        "x09_unfreed": rules("X9"),
        "x10_shared_state": rules("X10"),
        "x11_no_sync": rules("X11"),
        "x12_race_idioms": rules("X12", "X13", "X14"),
        "prompt_build": f"""SELECT doc_id AS file_id, CAST(length(p) AS INTEGER) AS n_chars, md5(p) AS digest
            FROM (SELECT doc_id, {PROMPT} AS p FROM documents)""",
        "annotate_default": annotate_sql(),
        "annotate_hook": f"""{CHUNKS} SELECT file_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, start_line + 1 AS line,
            'HIGH' AS severity, 'Unsafe Input' AS type, 'gets in chunk' AS description FROM chunks
            WHERE contains(content, 'gets(')""",
        "parse_main": f"{PARSED} SELECT * FROM main",
        "parse_fallback": f"{PARSED} SELECT * FROM alt",
        "sentinel_skip": f"""WITH {MODEL_LINES_SQL} SELECT file_id,
            CAST(CASE file_id % 5 WHEN 3 THEN count(*) * 37 - 1 ELSE 0 END AS INTEGER) AS n_chars
            FROM ml WHERE file_id % 5 >= 3 GROUP BY file_id""",
        "severity_normalise": f"{PARSED} SELECT severity, count(*) AS n FROM parsed GROUP BY severity",
        "type_classify": f"{PARSED} SELECT type, description, count(*) AS n FROM alt GROUP BY ALL",
        "combine_packs": f"{hits_cte(ALL_RULES)} SELECT source, rule_id, severity, count(*) AS n FROM hits GROUP BY ALL",
        "fp_filter": f"""{PARSED}, c AS (SELECT *, ({CONTEXT_LIST})[line % {len(CONTEXTS)} + 1] AS context FROM parsed)
            SELECT file_id, line, severity, type, description, context FROM c
            WHERE NOT (contains(description, 'integer overflow') AND severity = 'LOW' AND (contains(context, 'for (') OR contains(context, 'if (')))
              AND NOT (contains(description, 'null pointer') AND context = '')""",
        "cwe_enrich": f"{hits_cte(ALL_RULES)} SELECT file_id, line, type, source, rule_id, {CWE} AS cwe FROM hits",
        "dedupe_first": f"{FINAL} SELECT {RESULT} FROM final",
        "ranked_findings": f"{FINAL} SELECT {RESULT}, cwe, CAST(severity_rank AS INTEGER) AS severity_rank FROM final",
        "fix_suggest": f"{FINAL} SELECT file_id, line, type, description, suggested_fix FROM final",
        "context_text": f"""{hits_cte(ALL_RULES)} SELECT rule_id, count(*) AS n, count(context) AS with_context,
            min(context) AS first_context, CAST(max(length(context)) AS INTEGER) AS longest FROM hits GROUP BY rule_id""",
        "severity_counts": f"{FINAL} SELECT file_id, {COUNTS} FROM final GROUP BY file_id",
        "type_histogram": f"{FINAL} SELECT file_id, type, count(*) AS n FROM final GROUP BY ALL",
        "most_common_type": f"{FINAL}, {COMMON} SELECT file_id, most_common_type FROM common",
        "risk_score": f"{FINAL} SELECT file_id, count(*) AS total_vulnerabilities, {RISK} AS risk_score FROM final GROUP BY file_id",
        "gate_verdict": f"""{SECRET_DOCS}, u AS (SELECT DISTINCT file_id, line, type FROM ds),
            n AS (SELECT file_id, count(*) AS n FROM u GROUP BY file_id)
            SELECT doc_id AS file_id, coalesce(n.n, 0) AS total_vulnerabilities,
              CASE WHEN n.n > 0 THEN 2 ELSE 0 END AS verdict
            FROM documents LEFT JOIN n ON n.file_id = doc_id
            UNION ALL SELECT -1 - item_id, 0, 4 FROM benchmark""",
        "code_verdict": f"""{FINAL} SELECT file_id, CAST(1 AS BIGINT) AS chunks_analyzed,
            count(*) AS total_vulnerabilities, {RISK} AS risk_score,
            CASE WHEN bool_or(severity = 'CRITICAL') THEN 3 WHEN bool_or(severity = 'HIGH') THEN 2 ELSE 1 END AS verdict
            FROM final GROUP BY file_id""",
        "chunk_count": f"{CHUNKS} SELECT file_id, count(*) AS chunks_analyzed FROM chunks GROUP BY file_id",
        "corpus_rollup": f"""{SECRET_DOCS},
            u AS (SELECT DISTINCT file_id, line, type, severity FROM (SELECT * FROM ds UNION ALL SELECT * FROM dx)),
            k AS (SELECT u.severity, d.source, d.lang FROM u JOIN documents d ON d.doc_id = u.file_id)
            SELECT source, lang, CAST(grouping(source, lang) AS INTEGER) AS level, {COUNTS}, {RISK} AS risk_score
            FROM k GROUP BY ROLLUP (source, lang) HAVING count(*) > 0""",
        "source_text": f"""SELECT doc_id AS file_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest
            FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE
              regexp_replace(replace(text, chr(65533), ''), '\\r\\n?', {NL}, 'g') END AS t FROM documents)""",
        "source_files": f"""SELECT (doc_id % 7) || '/' || (doc_id % 3) || '/' || doc_id || '.' || (['c', 'H', 'cpp'])[doc_id % 4 + 1] AS name,
              CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest
            FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE
              regexp_replace(replace(text, chr(65533), ''), '\\r\\n?', {NL}, 'g') END AS t FROM documents) WHERE doc_id % 4 < 3""",
        "report_sink": text_report_sql(),
        "directory_rollup": DIRECTORY_ROLLUP,
        "scan_code": scan_sql(),
        "scan_with_model": model_scan_sql(),
        "scan_documents": scan_documents_sql(),
        "secret_risk_by_source": f"""{SECRET_DOCS}, u AS (SELECT DISTINCT file_id, line FROM ds WHERE rule_id = 'H27')
            SELECT d.source AS origin, count(*) AS high_count, CAST(7 * count(*) AS BIGINT) AS risk_score
            FROM u JOIN documents d ON d.doc_id = u.file_id GROUP BY d.source""",
    }
