"""Rules on small sources, against hand-made answers and brute force."""

import random
import re
import time

import pytest

from codesieve.operators.heuristic_rules import heuristic_tests
from codesieve.operators.model_rules import model_tests
from codesieve.operators.scan import line_findings, raw_findings, rule_list
from codesieve.operators.segment import with_whole_text
from codesieve.operators.units import CHUNK_LINE_MARKS
from codesieve.options import ScanOptions

SOURCE = """#include <stdlib.h>
static int shared;
int copy(char *dst, const char *src, int n) {
    char *buf = malloc(n * 4);
    char *kept = (char *)malloc(n);
    other = calloc(n, 4);
    gets(dst);
    strcpy(dst, src);
    printf(src);
    snprintf(dst, n, "%s", src);
    free(buf);
    dst[0] = buf[0];
    free(buf);
    return 0;
}
void run(void) {
    handle = fopen("../list", "r");
    system("ls");
    pthread_create(&t, 0, f, 0);
    static int count;
    sleep(3);
    password = "hunter2";
    n = rand();
}
"""


def found(files, *texts, options=ScanOptions(), only=None):
    frame = raw_findings(files(*texts), options, only)
    return sorted((r.rule_id, r.line) for r in frame.collect())


def test_source_findings(files):
    expected = {
        "M1": [7], "M2": [8], "M7": [12], "M8": [3, 20], "M6": [],
        "H1": [7], "H2": [8], "H9": [9], "H10": [4, 5], "H12": [6], "H13": [13], "H14": [17], "H16": [6],
        "H15": [4, 5], "H22": [19], "H24": [22], "H29": [23], "M12": [23], "M14": [18], "H6": [18],
        "X1": [23], "X2": [22], "X7": [17, 17], "X8": [0], "X9": [0], "X10": [20], "X11": [19], "X12": [21],
    }
    lines = {}
    for rule, line in found(files, SOURCE):
        lines.setdefault(rule, []).append(line)
    for rule, at in expected.items():
        if rule == "M8":
            assert set(lines.get(rule, [])) >= {3}
        else:
            assert lines.get(rule, []) == at, rule


def test_rule_ids_are_unique_and_complete():
    ids = [r.rule_id for r in rule_list()]
    assert len(ids) == len(set(ids)) == 16 + 29 + 14


def test_line_tests_need_a_mark_of_their_units():
    for test in [*model_tests(), *heuristic_tests()]:
        assert test.needs and set(test.needs) <= set(CHUNK_LINE_MARKS), test.rule_id


@pytest.mark.parametrize(
    "line, rule",
    [("x = TELNET;", "X4"), ("ftp://h", "X4"), ("VOLATILE int a;", "X13"), ("Key='a'", "X2"), ("a Query + input", "X6")],
)
def test_marks_keep_short_file_lines(files, line, rule):
    assert (rule, 1) in found(files, line, options=ScanOptions(packs=frozenset("X")))


def test_open_variables_follow_the_last_event(files):
    text = "a = fopen(p);\nfclose(a);\nb = fopen(p); fclose(b);\nfclose(c); c = fopen(p);\nd = fopen(p);\nd = fopen(q);"
    frame = raw_findings(files(text), ScanOptions(packs=frozenset("X")), {"X8"})
    assert sorted(r.description for r in frame.collect()) == ['File handle "d" may not be properly closed']


def test_line_with_close_before_open_counts_as_closed(files):
    frame = raw_findings(files("fclose(c); c = fopen(p);"), ScanOptions(packs=frozenset("X")), {"X8"})
    assert frame.count() == 0


def test_secret_context_is_cut(files):
    secret = "x" * 80
    rows = raw_findings(files(f'token = "{secret}";'), ScanOptions(), {"H27"}).collect()
    assert rows[0].context == f'token = "{secret}'[:50] + "..."


def test_volatile_look_ahead(files):
    text = "volatile sig_atomic_t a;\nvolatile  sig_atomic_t b;\nvolatile int c;"
    assert found(files, text, only={"X13"}) == [("X13", 2), ("X13", 3)]


def test_multi_line_calls_use_the_first_line(files):
    text = "void f(void) {\n  x = malloc(\n    8\n  );\n  free(\n x);\n}"
    assert found(files, text, only={"H12", "H15"}) == [("H15", 2)]


def test_check_area_ends_after_200_characters(files):
    near = "p = fopen(a);\n" + "x" * 190 + " NULL"
    far = "p = fopen(a);\n" + "x" * 199 + " NULL"
    assert found(files, near, far, only={"H14"}) == [("H14", 1)]


def test_cast_hides_the_variable_of_an_allocation(files):
    assert found(files, "a = (char*)malloc(4);\nb = malloc(4);", only={"H12"}) == [("H12", 2)]


def _brute_windows(lines):
    """Leaks without a free in 20 lines, and first uses within 10 lines after a free."""
    out = []
    for i, line in enumerate(lines):
        if "alloc(" in line and not any("free(" in x for x in lines[i + 1:i + 21]):
            out.append(("M6", i + 1))
        freed = re.search(r"free\((\w+)", line)
        if freed:
            for j in range(i + 1, min(i + 11, len(lines))):
                if freed.group(1) in lines[j] and "free(" not in lines[j]:
                    out.append(("M7", j + 1))
                    break
        if "open(" in line:
            near = lines[max(0, i - 1):i + 4]
            if not any(c in x for x in near for c in ("if", "!", "NULL", "ERROR", "== -1")):
                out.append(("M13", i + 1))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_against_brute_force(files, seed):
    pick = random.Random(seed)
    kinds = ["a = malloc(4);", "free(a);", "use(a);", "nothing;", "pad;", "f = open(b);", "if (f) {}", "free(b);", "pad;"]
    lines = [pick.choices(kinds, [1, 1, 2, 9, 9, 1, 1, 1, 9])[0] for _ in range(400)]
    options = ScanOptions(max_chunk_size=None, packs=frozenset("M"))
    frame = raw_findings(files("\n".join(lines)), options, {"M6", "M7", "M13"}, with_whole_text)
    assert sorted((r.rule_id, r.line) for r in frame.collect()) == _brute_windows(lines)


def test_result_does_not_depend_on_partitions(files):
    texts = [SOURCE, SOURCE.replace("rand", "random"), "int x;\n"]
    one = sorted(map(str, raw_findings(files(*texts).repartition(1)).collect()))
    many = sorted(map(str, raw_findings(files(*texts).repartition(7)).collect()))
    assert one == many


def test_scan_has_no_shuffle(files, spark, fresh_dir):
    path = f"{fresh_dir}/files"
    files(SOURCE).write.parquet(path)
    plan = raw_findings(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "ReadSchema: struct<file_id:bigint,content:string>" in plan


def test_only_line_rules_run_on_lines(spark):
    lines = spark.createDataFrame([(1, 1, "gets(a); md5(b);")], "file_id int, line_no int, line string")
    assert sorted(r.rule_id for r in line_findings(lines, {"M1", "H1", "X3"}).collect()) == ["H1", "M1", "X3"]
    with pytest.raises(ValueError):
        line_findings(lines, {"M6"})


def seconds(frame):
    start = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


@pytest.mark.parametrize(
    "text",
    [
        "sql+" * 250_000 + "user", "/* open\n" * 50_000, "src/*\n" * 50_000, "x" * 1_000_000, "word " * 200_000,
        "".join(f"v{n} = fopen(a, b);\n" for n in range(30_000)), "free(p);\n" * 30_000,
        "".join(f"v{n} = malloc(n);\n" for n in range(30_000)),
        "open(.." * 8_000, "scanf(" * 100_000, "scanf(" * 100_000 + ",)", "printf(" + " " * 1_000_000, "printf(" * 100_000 + ",)",
        "fopen" + "x" * 1_000_000 + " malloc", "x = malloc(" * 90_000, "free(" * 200_000, "p = fopen(a,\n" * 20_000 + ")",
        "malloc(n); " * 50_000,
    ],
    ids=["joined words", "open comments", "globs", "one word", "prose", "handles", "frees", "allocations", "open dots", "open scans",
         "scans without an argument", "blanks in a call", "open prints", "long name", "open allocations", "open frees", "open calls",
         "calls in a line"],
)
def test_long_texts_take_linear_time(files, text):
    options = ScanOptions(max_chunk_size=None)
    assert seconds(raw_findings(files(text), options)) < 20


def test_context_lines_take_linear_time(files):
    def text(functions):
        return "".join(f"void f{n}(char *a) {{\n  gets(a);\n  p{n} = malloc(4);\n}}\n" for n in range(functions))

    options = ScanOptions(max_context_lines=3)
    seconds(raw_findings(files(text(100)), options))
    times = [seconds(raw_findings(files(text(n)), options)) for n in (4_000, 16_000)]
    assert times[1] < 8 * times[0] + 2


@pytest.mark.parametrize("seed", range(4))
def test_call_patterns_against_plain_ones(files, seed):
    """Linear forms of the patterns on calls find what the plain patterns find."""
    pick = random.Random(seed)
    parts = ["printf(", "fprintf(", "stderr", "scanf(", "open(", "access (", "..", ",", ")", " ", '"', "x", "malloc(", "a = ", "free(", "calloc (", "n", "b=", "rand(", "srandom ("]
    lines = ["".join(pick.choices(parts, k=pick.randint(1, 14))) for _ in range(600)]
    found = {}
    options = ScanOptions(max_chunk_size=None)
    rows = raw_findings(files(*lines), options, {"H9", "X5", "X7", "H12", "H13", "H15", "H16", "H29", "H30", "X9"}, with_whole_text).collect()
    for row in rows:
        found.setdefault(row.file_id, []).append((row.rule_id, row.description if row.rule_id in ("H9", "X9", "H12", "H13") else ""))
    for n, line in enumerate(lines):
        expected = []
        call = re.search(r"""(printf|fprintf|sprintf|snprintf)\s*\(\s*([^,")]+)\s*\)""", line)
        if call and "stderr" not in call.group(2):
            expected.append(("H9", f"{call.group(1)}() with potentially user-controlled format string"))
        expected += [("X5", "")] * bool(re.search(r"scanf\s*\([^,]*,\s*[^)]+\)", line))
        expected += [("X7", "") for w in ("fopen", "open", "access") if re.search(w + r"\s*\([^,)]*\.\.[^)]*\)", line)]
        for match in re.finditer(r"\b(malloc|calloc|realloc)\s*\([^)]+\)", line):
            named = re.search(r"(\w+)\s*=\s*" + re.escape(match.group()), line)
            if named and named.group(1) not in re.findall(r"\bfree\s*\(\s*(\w+)", " ".join(re.findall(r"\bfree\s*\([^)]+\)", line))):
                expected.append(("H12", f"Allocated memory ({named.group(1)}) may not be freed"))
        expected = sorted(set(e for e in expected if e[0] == "H12")) + [e for e in expected if e[0] != "H12"]
        freed = [v for call in re.findall(r"\bfree\s*\([^)]+\)", line) for v in re.findall(r"free\s*\(\s*(\w+)", call)[:1]]
        expected += [("H13", f"Variable {v} may be freed multiple times") for k, v in enumerate(freed) if v in freed[:k]]
        expected += [(rule, "") for rule, name in (("H29", "rand"), ("H30", "random")) if re.search(rf"\b{name}\s*\(\s*\)", line)]
        for rule, name in (("H15", "malloc"), ("H16", "calloc")):
            expected += [(rule, "")] * len(re.findall(name + r"\s*\([^)]*\)", line))
        opened, freed = re.search(r"(\w+)\s*=\s*(?:malloc|calloc|realloc)\s*\(", line), re.search(r"free\s*\(\s*(\w+)", line)
        if opened and not (freed and freed.group(1) == opened.group(1)):
            expected.append(("X9", f'Allocated memory "{opened.group(1)}" may not be freed'))
        assert (line, sorted(found.get(n, []))) == (line, sorted(expected))


def test_equal_calls_of_a_line_count_for_the_first_name(files):
    text = "a = malloc(n); b = malloc(n);\nc = malloc(n);\nd = malloc(m); e = malloc(n);"
    rows = raw_findings(files(text), ScanOptions(packs=frozenset("H")), {"H12"}).collect()
    assert sorted((r.line, r.description.split("(")[1][0]) for r in rows) == [(1, "a"), (2, "c"), (3, "d"), (3, "e")]


def test_joined_words_in_order_only(files):
    lines = ["sql + user", "user + sql", "SQL x+y USER", "sql user +", "query+input", "+ sql user", "sql user + user", "executes + params"]
    found = raw_findings(files("\n".join(lines)), ScanOptions(packs=frozenset("X")), {"X6"}).collect()
    assert sorted(r.line for r in found) == [1, 3, 5, 7, 8]
