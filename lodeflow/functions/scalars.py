"""Scalar functions over columns: enums, paths, globs, digests and JSON replies."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Order of severities, extensions of languages, kinds of weaknesses and their severities.
SEVERITIES = ("critical", "high", "medium", "low", "info")
VERDICTS = ("true_positive", "false_positive", "uncertain", "unverified")
LANGUAGES = {
    "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "c++": "cpp", "h++": "cpp",
    "java": "java",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "py": "python", "pyi": "python",
    "kt": "kotlin", "kts": "kotlin",
    "php": "php", "phtml": "php", "php3": "php", "php4": "php", "php5": "php", "php7": "php", "phps": "php",
    "go": "go",
    "swift": "swift",
    "rb": "ruby", "rake": "ruby", "gemspec": "ruby",
    "cs": "csharp",
    "scala": "scala", "sc": "scala",
}
WEAKNESSES = {
    "CWE-89": "SQL Injection",
    "CWE-79": "Cross-site Scripting (XSS)",
    "CWE-78": "OS Command Injection",
    "CWE-22": "Path Traversal",
    "CWE-918": "Server-Side Request Forgery (SSRF)",
    "CWE-611": "XML External Entity (XXE)",
    "CWE-502": "Deserialization of Untrusted Data",
    "CWE-90": "LDAP Injection",
    "CWE-643": "XPath Injection",
    "CWE-94": "Code Injection",
    "CWE-117": "Log Injection",
    "CWE-601": "Open Redirect",
    "CWE-200": "Sensitive Data Exposure",
    "CWE-798": "Hardcoded Credentials",
    "CWE-327": "Use of Broken Crypto Algorithm",
    "CWE-330": "Use of Insufficiently Random Values",
    "CWE-120": "Buffer Overflow",
    "CWE-416": "Use After Free",
    "CWE-476": "NULL Pointer Dereference",
    "CWE-362": "Race Condition",
}


def severity_rank(severity: Column) -> Column:
    """1 for critical to 5 for info, whatever the case; unknown and null rank 6."""
    found = F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.lower(F.trim(severity)))
    return F.when(found > 0, found).otherwise(F.lit(6)).cast("int")


def enum_or_default(value: Column, allowed: tuple[str, ...] | list[str], default: str) -> Column:
    """The value in lower case if it is allowed, else the default (also for null)."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*allowed), low).otherwise(F.lit(default))


def described(code: Column) -> Column:
    """What a weakness code means; ``Unknown (code)`` beyond the table, null for null."""
    pairs = [F.lit(x) for kv in WEAKNESSES.items() for x in kv]
    return F.when(code.isNotNull(), F.coalesce(F.create_map(*pairs)[code], F.concat(F.lit("Unknown ("), code, F.lit(")"))))


def language_of_path(path: Column) -> Column:
    """The language of a file by its last suffix; null beyond the table."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.create_map(*pairs)[F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))]


def glob_pattern(glob: str) -> str:
    """A shell glob as an anchored regex, where ``*`` crosses directories."""
    out = []
    for part in re.split(r"(\*+|\?|\[[^\]]+\])", glob):
        out.append(".*" if part.startswith("*") and part else "." if part == "?" else part.replace("[!", "[^") if part.startswith("[") else re.sub(r"([.^$+{}()|\\\[\]])", r"\\\1", part))
    return "^" + "".join(out) + "$"


def matches_glob(path: Column, globs: list[str]) -> Column:
    """Whether the path or its last segment matches any of the globs; false for null."""
    name = F.regexp_replace(path, "^.*/", "")
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_pattern(g)) | name.rlike(glob_pattern(g))
    return F.coalesce(hit, F.lit(False))


def short_digest(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 digest."""
    return F.substring(F.sha2(text, 256), 1, 16)


def clamp(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), score))


def first_json_object(text: Column, schema: str) -> Column:
    """The first flat JSON object in a text, parsed; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(\{[^{}]*\})", 1), F.lit("")), schema)
