"""Text rules R1-R13: lower-cased substring tests, any-of.

Substring semantics are deliberate (``ip`` matches "script", ``doc`` matches "docker").  None of the
substrings holds a regex metacharacter, so one ``rlike`` alternation per rule is exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the substring lists each rule looks for (must stay exactly these) ---
RULES: dict[str, list[str]] = {
    "defect": ["error", "bug", "fix", "issu", "mistake", "incorrect", "fault", "defect", "flaw"],
    "conditional": ["logic", "condit", "boolean"],
    "storage_configuration": ["sql", "db", "databas"],
    "file_configuration": ["file", "permiss"],
    "network_configuration": ["network", "ip", "address", "port", "tcp", "dhcp"],
    "user_configuration": ["user", "usernam", "password"],
    "cache_configuration": ["cach"],
    "dependency": ["requir", "depend", "relat", "order", "sync", "compat", "ensur", "inherit"],
    "documentation": ["doc", "comment", "spec", "licens", "copyright", "notic", "header", "readm"],
    "idempotency": ["idempot"],
    "security": ["vul", "ssl", "secr", "authent", "password", "secur", "cve"],
    "service": ["servic", "server"],
    "syntax": ["compil", "lint", "warn", "typo", "spell", "indent", "regex", "variabl", "whitespac"],
}

# Label names in their output order, with the text rules that decide each one (besides R1).
LABELS: list[tuple[str, list[str]]] = [
    ("CONDITIONAL", ["conditional"]),
    ("CONFIGURATION_DATA", ["storage_configuration", "file_configuration", "network_configuration",
                            "user_configuration", "cache_configuration"]),
    ("DEPENDENCY", ["dependency"]),
    ("DOCUMENTATION", ["documentation"]),
    ("IDEMPOTENCY", ["idempotency"]),
    ("SECURITY", ["security"]),
    ("SERVICE", ["service"]),
    ("SYNTAX", ["syntax"]),
]


def pattern(*rules: str) -> str:
    """One alternation regex covering the substrings of the given rules."""
    words: list[str] = []
    for r in rules:
        words.extend(RULES[r])
    return "|".join(words)


def has(text: Column, *rules: str) -> Column:
    """``True`` when the lower-cased text contains any substring of any of the rules (NULL -> False)."""
    return F.coalesce(F.lower(text).rlike(pattern(*rules)), F.lit(False))
