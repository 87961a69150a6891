"""Code corpora derived from the ``events`` table, in Spark and as SQL text.

``code_lines`` gives each event one line of C by its ids, 40 lines to a file. ``code_files``
puts a fixed skeleton of functions over the same lines. ``model_text`` gives eight events
one answer in a format a model might use. Both engines build them from the same lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.text import literal
from codesieve.sources.tables import spread, text_corpus

LINES_PER_FILE = 40

# One of these per event; {v} is a variable name by user.
CODE_TEMPLATES = [
    "gets({v});", "strcpy({v}, src);", "strcat({v}, src);", "sprintf({v}, fmt, n);",
    'scanf("%s", {v});', "fgets({v}, 8, f);", "strncpy({v}, src, 8);", "snprintf({v}, 8, fmt);",
    "system(cmd);", 'popen(cmd, "r");', "exec(cmd);", "filesystem_init();",
    "printf({v});", 'printf("%s", user);', "fprintf(stderr);", "{v} = malloc(n);",
    "{v} = (char*)malloc(n);", "{v} = calloc(n, 4);", "free({v});", "use({v});",
    "xfree(w);", "int t = a * b;", "size = len + n;", "mask = num << 3;",
    "unsigned t = a * b;", "{v}->next = 0;", "*{v} = 1;", "if ({v} != NULL) {v}->next = 0;",
    "pthread_create(&t, 0, f, 0);", "lock(m);", "  static int shared;", "sleep(5);",
    "volatile int flag;", "signal(2, h);", "unlock(m);", "volatile sig_atomic_t s;",
    "n = rand();", "n = random();", "md5({v});", 'url = "http://x";',
    'password = "abc";', 'Key = "k1";', "srand(7);", "key = read_key();",
    "n = atoi({v});", "n = strtol({v}, 0, 10);", "sql = q + user;", 'fopen("../etc", "r");',
    "sql = q;", '{v} = fopen(name, "r");', "fclose({v});", "if (!{v}) return;",
    "{v} = open_it();", 'scanf("%d", &buf[1]);', "{v} = realloc({v}, n);",
    'secret = "a rather long secret text that is cut at fifty letters {v}";',
    "token = 'tk';", "/* note */", "", "fd = socket(1, 2, 0);",
    "bind(fd, p, 4);", "telnet_open(h);", "volatile  sig_atomic_t z;", "  return;",
    "free({v});", "free({v});", "free( {v} );",
]
# Templates kept in some files only (file_id % modulus = residue), as they flip file-wide flags.
RARE_TEMPLATES = {27: (3, 0), 28: (3, 1), 29: (2, 0), 34: (2, 0), 42: (4, 0)}
RARE_FALLBACK = "use({v});"

# Lines put over the templates by position, and some of them in every third file only.
SKELETON = {
    1: "#include <stdio.h>", 2: "#define N 8",
    3: "void f3(int a) {", 12: "}", 13: "void f13(int a) {", 22: "}",
    23: "void f23(int a) {", 32: "}", 33: "void f33(int a) {",
}
NESTED_SKELETON = {5: "if (a) {", 6: 'puts("}");', 7: "}", 8: "/* { */"}

EVENTS_PER_ANSWER = 8
SEVERITY_CHOICES = ["critical", "HIGH", "medium", "Med", "low", "info", "warning", "error", "odd"]
TYPE_CHOICES = ["Buffer Overflow", "Memory Leak", "Integer Overflow", "Null Pointer", "Use After Free", "Style"]
DESCRIPTIONS = [
    "buffer overflow in copy loop", "dangling pointer after close", "missing free on error path",
    "format specifier from user", "integer overflow in size", "null pointer not tested",
    "shell injection through name", "thread safety of counter", "note: odd style - nothing else",
    "strcpy of argv", "malloc without any free", "signed integer wraps",
]
SENTINEL = "No obvious vulnerabilities detected."
CONTEXTS = ["", "for (i = 0; i < n; i++)", "x = y;", "if (p)"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(choices: list[str], index: str) -> str:
    return f"get(array({', '.join(map(literal, choices))}), cast({index} as int))"


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines(file_id, line_no, line); a narrow projection of events."""
    rows = table(spark, sf_dir, "events").selectExpr(
        f"event_id div {LINES_PER_FILE} AS file_id",
        f"cast(event_id % {LINES_PER_FILE} + 1 as int) AS line_no",
        f"(event_id * 31 + user_id * 17) % {len(CODE_TEMPLATES)} AS k",
        "concat('v', user_id % 5) AS v",
    )
    absent = " or ".join(f"(k = {k} and file_id % {m} <> {r})" for k, (m, r) in RARE_TEMPLATES.items())
    template = f"if({absent}, {literal(RARE_FALLBACK)}, {_pick(CODE_TEMPLATES, 'k')})"
    return rows.selectExpr("file_id", "line_no", f"replace({template}, '{{v}}', v) AS line")


def skeleton_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = " ".join(f"when line_no = {n} then {literal(t)}" for n, t in SKELETON.items())
    nested = " ".join(
        f"when line_no = {n} and file_id % 3 = 0 then {literal(t)}" for n, t in NESTED_SKELETON.items()
    )
    line = f"case {fixed} {nested} else line end AS line"
    return code_lines(spark, sf_dir).selectExpr("file_id", "line_no", line)


def _joined(lines: DataFrame) -> DataFrame:
    """Files of 40 lines each; event ids are unique and dense, so no file is larger.

    The files are dealt over a fixed number of tasks, as scanning a text costs far more than building it.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return spread(lines, always=True).groupBy("file_id").agg(ordered.alias("x")).select(
        "file_id",
        F.concat(F.lit("f"), F.col("file_id").cast("string"), F.lit(".c")).alias("path"),
        F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("content"),
    )


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code_lines`` as files(file_id, path, content)."""
    return _joined(code_lines(spark, sf_dir))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with functions, for segmentation."""
    return _joined(skeleton_lines(spark, sf_dir))


def model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """responses(file_id, start_line, text)."""
    number = "(event_id % 8 + 1 + user_id % 50)"
    severity = _pick(SEVERITY_CHOICES, f"(event_id * 5 + user_id) % {len(SEVERITY_CHOICES)}")
    kind = _pick(TYPE_CHOICES, f"(event_id + user_id) % {len(TYPE_CHOICES)}")
    description = _pick(DESCRIPTIONS, f"(event_id * 7 + user_id) % {len(DESCRIPTIONS)}")
    line = f"""case file_id % 5
        when 0 then concat('Line ', {number}, ': [', {severity}, '] ', {kind}, ' - ', {description})
        when 1 then concat({number}, ': ', {severity}, ' : ', {description})
        when 2 then concat('Line ', {number}, ': ', {description})
        when 3 then {literal(SENTINEL)} else '' end"""
    rows = table(spark, sf_dir, "events").withColumn("file_id", F.expr(f"event_id div {EVENTS_PER_ANSWER}"))
    ordered = F.array_sort(F.collect_list(F.struct("event_id", F.expr(line).alias("line"))))
    joined = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    return rows.groupBy("file_id").agg(ordered.alias("x")).select(
        "file_id",
        (F.col("file_id") % 100).cast("int").alias("start_line"),
        F.when(F.col("file_id") % 5 == 4, "").otherwise(joined).alias("text"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as files(file_id, path, content)."""
    return spread(text_corpus(table(spark, sf_dir, "documents"), "doc_id", "text"))


def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, and an entry without text for every benchmark item (id -1 - item_id)."""
    absent = table(spark, sf_dir, "benchmark").select(
        (-1 - F.col("item_id")).alias("file_id"), F.lit("absent").alias("path"), F.lit(None).cast("string").alias("content")
    )
    return documents(spark, sf_dir).union(absent)


def source_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, raw): documents with line ends by id, an invalid byte in some, no bytes in others."""
    ends = F.when(F.col("doc_id") % 3 == 0, "\r\n").when(F.col("doc_id") % 3 == 1, "\r").otherwise("\n")
    text = F.replace(F.col("text"), F.lit("\n"), ends).cast("binary")
    broken = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(b"\xff"), text, F.lit(b"\xc3"))).otherwise(text)
    raw = F.when(F.col("doc_id") % 11 == 0, F.lit(b"")).otherwise(broken)
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), raw.alias("raw")))


def keyed_documents(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Like ``documents``, with further columns kept in the key."""
    keyed = table(spark, sf_dir, "documents").select(
        F.struct("doc_id", *keys).alias("file_id"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")
    )
    return spread(keyed)


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_positions(lines: dict[int, str], condition: str = "") -> str:
    return " ".join(f"WHEN line_no = {n}{condition} THEN {_sql_text(t)}" for n, t in lines.items())


_RARE = " OR ".join(
    f"(k = {k} AND file_id % {m} <> {r})" for k, (m, r) in RARE_TEMPLATES.items()
)
CODE_LINES_SQL = f"""
ev AS (
  SELECT event_id // {LINES_PER_FILE} AS file_id,
         CAST(event_id % {LINES_PER_FILE} + 1 AS INTEGER) AS line_no,
         (event_id * 31 + user_id * 17) % {len(CODE_TEMPLATES)} AS k,
         concat('v', CAST(user_id % 5 AS VARCHAR)) AS v
  FROM events
),
cl AS (
  SELECT file_id, line_no,
         replace(CASE WHEN {_RARE} THEN {_sql_text(RARE_FALLBACK)}
                      ELSE ({_sql_list(CODE_TEMPLATES)})[k + 1] END, '{{v}}', v) AS line
  FROM ev
)"""
CODE_FILES_SQL = f"""{CODE_LINES_SQL},
sl AS (
  SELECT file_id, line_no,
         CASE {_sql_positions(SKELETON)}
              {_sql_positions(NESTED_SKELETON, " AND file_id % 3 = 0")}
              ELSE line END AS line
  FROM cl
)"""
MODEL_LINES_SQL = f"""
ml AS (
  SELECT event_id // {EVENTS_PER_ANSWER} AS file_id, event_id,
         CAST(event_id // {EVENTS_PER_ANSWER} % 100 AS INTEGER) AS start_line,
         CAST(event_id % 8 + 1 + user_id % 50 AS INTEGER) AS num,
         ({_sql_list(SEVERITY_CHOICES)})[(event_id * 5 + user_id) % {len(SEVERITY_CHOICES)} + 1] AS sev,
         ({_sql_list(TYPE_CHOICES)})[(event_id + user_id) % {len(TYPE_CHOICES)} + 1] AS kind,
         ({_sql_list(DESCRIPTIONS)})[(event_id * 7 + user_id) % {len(DESCRIPTIONS)} + 1] AS description
  FROM events
)"""
