"""Fixed values the SQL expects, spelled out here, so that a slip in a table of the engine shows as a difference."""

# Rules: texts, call names, words.
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
DANGEROUS_CALLS = {
    "gets": ("CRITICAL", "Buffer Overflow", "No bounds checking, deprecated function"),
    "strcpy": ("HIGH", "Buffer Overflow", "No bounds checking on destination buffer"),
    "strcat": ("HIGH", "Buffer Overflow", "No bounds checking on concatenation"),
    "sprintf": ("HIGH", "Buffer Overflow", "No bounds checking on output buffer"),
    "scanf": ("MEDIUM", "Buffer Overflow", "Potential buffer overflow with %s"),
    "system": ("HIGH", "Command Injection", "Potential command injection vulnerability"),
    "exec": ("HIGH", "Command Injection", "Potential command execution vulnerability"),
    "popen": ("HIGH", "Command Injection", "Potential command injection via pipe"),
}
CHECKED_CALLS = (
    "fopen", "malloc", "calloc", "realloc", "socket", "bind", "listen", "accept",
    "pthread_create", "pthread_mutex_lock",
)
SECRET_WORDS = {
    "password": "Hardcoded Password",
    "passwd": "Hardcoded Password",
    "key": "Hardcoded Encryption Key",
    "token": "Hardcoded Token",
    "secret": "Hardcoded Secret",
}
WEAK_GENERATORS = ("rand", "random")
RESULT_CHECKS = ("if", "NULL", "== -1", "!= 0", "< 0")
FORMAT_CALL = r"""(printf|fprintf|sprintf|snprintf)\s*\(\s*([^,")]+)\s*\)"""

# Numbers and fixes, by substring; the first match counts.
CWE_NUMBERS = {
    "buffer overflow": "CWE-120",
    "use after free": "CWE-416",
    "memory leak": "CWE-401",
    "format string": "CWE-134",
    "integer overflow": "CWE-190",
    "command injection": "CWE-78",
    "null pointer": "CWE-476",
}
BUFFER_FIXES = {
    "gets": "Replace gets() with fgets() and specify buffer size",
    "strcpy": "Replace strcpy() with strncpy() or use safer alternatives like strlcpy()",
    "strcat": "Replace strcat() with strncat() and check buffer bounds",
    "sprintf": "Replace sprintf() with snprintf() to prevent buffer overflow",
}
BUFFER_FALLBACK = "Address buffer overflow vulnerability"
FIXES = {
    "use after free": "Set pointer to NULL after free() and check for NULL before use",
    "memory leak": "Ensure every malloc()/calloc() has a corresponding free()",
    "format string": 'Use printf("%s", user_input) instead of printf(user_input)',
    "command injection": "Avoid system() calls with user input; use safer alternatives",
    "integer overflow": "Use appropriate data types and check bounds before arithmetic operations",
}
GENERAL_FIX = "Review code for security best practices"

# Answers of models: prompt, severity words, types.
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

# The plain report.
WIDE_RULE, NARROW_RULE, FOOTER_RULE = "=" * 70, "-" * 40, "-" * 70
TITLE = "# C/C++ Vulnerability Analysis Report"
