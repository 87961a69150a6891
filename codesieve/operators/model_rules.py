"""Rule pack M: the rules a default annotator applies to the lines of one chunk."""

from __future__ import annotations

from ..functions.text import has_any, let, literal
from .findings import CHUNK_STAGE, LineTest, RuleText

SOURCE, PACK = "llm", 0

# Rule texts as (severity, type, description), in rule order.
MODEL_RULES = {
    "M1": ("CRITICAL", "Buffer Overflow", "gets() function is unsafe and deprecated"),
    "M2": ("HIGH", "Buffer Overflow", "strcpy() without bounds checking"),
    "M3": ("HIGH", "Buffer Overflow", "strcat() without bounds checking"),
    "M4": ("HIGH", "Buffer Overflow", "sprintf() without bounds checking"),
    "M5": ("MEDIUM", "Format String Vulnerability", "User input in printf"),
    "M6": ("MEDIUM", "Memory Leak", "malloc/calloc without corresponding free"),
    "M7": ("HIGH", "Use After Free", "Variable '{}' used after free"),
    "M8": ("LOW", "Integer Overflow", "Potential arithmetic overflow with signed integers"),
    "M9": ("MEDIUM", "Null Pointer Dereference", "Pointer used without null check"),
    "M10": ("HIGH", "Buffer Overflow", "Array access with unsafe input function"),
    "M11": ("MEDIUM", "Race Condition", "Lock without corresponding unlock"),
    "M12": ("LOW", "Weak Random", "rand() without srand() seed"),
    "M13": ("MEDIUM", "Resource Management", "File operation without error checking"),
    "M14": ("HIGH", "Command Injection", "Use of dangerous function system("),
    "M15": ("HIGH", "Command Injection", "Use of dangerous function exec("),
    "M16": ("HIGH", "Command Injection", "Use of dangerous function popen("),
}
# Rules that look at one line only.
MODEL_LINE_RULES = {"M1", "M2", "M3", "M4", "M5", "M8", "M10", "M11", "M14", "M15", "M16"}

# Word lists and reaches of the rules.
USER_DATA_WORDS = ("input", "buffer", "user", "argv")
ALLOCATIONS = ("malloc(", "calloc(", "realloc(")
ARITHMETIC = ("*", "+", "<<")
SIGNED_TYPES = ("int", "long", "size_t")
INPUT_FUNCTIONS = ("scanf", "gets", "fgets")
OPEN_CHECKS = ("if", "!", "NULL", "ERROR", "== -1")
FREED_VARIABLE = r"free\s*\(\s*(\w+)"
USE_REACH = 10
OPEN_CHECK_REACH = 3

CALL, POINTER = ("(",), ("*", "->")

# The first following line that has the freed name; regexp_extract gives '' for no name.
FIRST_USE = let(
    f"regexp_extract(line, {literal(FREED_VARIABLE)}, 1)", "var",
    f"get(filter(slice(ahead, 1, {USE_REACH}), use -> var <> '' "
    "and contains(use.line, var) and not contains(use.line, 'free(')), 0).line_no",
)
OPEN_CHECKED = (
    f"({has_any('line', OPEN_CHECKS)} or coalesce({has_any('before', OPEN_CHECKS)}, false) "
    f"or exists(slice(ahead, 1, {OPEN_CHECK_REACH}), near -> {has_any('near.line', OPEN_CHECKS)}))"
)


def _unbounded(name: str, bounded: str) -> str:
    return f"contains(line, '{name}(') and not contains(line, '{bounded}(')"


def rule_texts() -> list[RuleText]:
    return [RuleText(i, *text, SOURCE, CHUNK_STAGE, PACK, 0) for i, text in MODEL_RULES.items()]


def model_tests() -> list[LineTest]:
    conditions = {
        "M1": ("contains(line, 'gets(')", CALL),
        "M2": (_unbounded("strcpy", "strncpy"), CALL),
        "M3": (_unbounded("strcat", "strncat"), CALL),
        "M4": (_unbounded("sprintf", "snprintf"), CALL),
        "M5": (f"contains(line, 'printf(') and contains(line, '%') and {has_any('line', USER_DATA_WORDS)}", CALL),
        "M6": (f"{has_any('line', ALLOCATIONS)} and not exists(ahead, next -> contains(next.line, 'free('))", CALL),
        "M7": (f"contains(line, 'free(') and {FIRST_USE} is not null", CALL),
        "M8": (f"{has_any('line', SIGNED_TYPES)} and not contains(line, 'unsigned')", ARITHMETIC),
        "M9": ("not has_null and not contains(line, 'if')", POINTER),
        "M10": (f"contains(line, ']') and {has_any('line', INPUT_FUNCTIONS)}", ("[",)),
        "M11": ("contains(line, 'lock(') and not contains(line, 'unlock')", CALL),
        "M12": ("contains(line, 'rand()') and not has_seed", CALL),
        "M13": (f"contains(line, 'open(') and not {OPEN_CHECKED}", CALL),
        "M14": ("contains(line, 'system(')", CALL),
        "M15": ("contains(line, 'exec(')", CALL),
        "M16": ("contains(line, 'popen(')", CALL),
    }
    tests = []
    for minor, (rule_id, (when, needs)) in enumerate(conditions.items(), 1):
        if rule_id == "M7":
            var = f"regexp_extract(line, {literal(FREED_VARIABLE)}, 1)"
            tests.append(LineTest(rule_id, when, needs, FIRST_USE, minor, var))
        else:
            tests.append(LineTest(rule_id, when, needs, minor=minor))
    return tests
