"""Cheap-to-expensive classification: rules, additive scores, then a provider for what stays uncertain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodeflow.functions.scalars import clamp

# Forms of string concatenation and words by which the second tier scores.
CONCATENATION = r"""\+\s*["']|["']\s*\+|\+\s*\w+\s*\+|\.concat\(|%\s|\.format\("""
SANITIZERS = r"(?i)\b(?:escape|sanitize|encodeURIComponent|parseInt|parameterize|quote|htmlspecialchars|bleach|validator)\w*\s*\("
QUIET_SINKS = ("log", "debug", "info", "warn", "error", "trace", "console", "print", "logger", "assert", "test", "mock", "spy")
QUIET_SOURCES = ("process.env", "config", "constant", "default", "static")
PATH_SINKS = (
    "readfile", "readfilesync", "writefile", "writefilesync", "createreadstream", "createwritestream", "unlink", "rmdir", "stat", "access", "open", "fs.", "path.join", "path.resolve", "sendfile", "download", "serve",
    "static",
)
PATH_SOURCES = ("req.params", "req.query", "req.body", "filename", "filepath", "path", "file", "dir", "directory", "folder")
MARKUP_SINKS = (
    "innerhtml", "outerhtml", "document.write", "document.writeln", "insertadjacenthtml", "bypasssecuritytrusthtml", "bypasssecuritytrustscript", "bypasssecuritytrusturl", "res.send", "res.write", "render",
    "dangerouslysetinnerhtml", "v-html",
)
MARKUP_SOURCES = ("req.query", "req.body", "req.params", "userinput", "search", "query", "message", "comment", "name", "title", "content")
CRITICAL, MILD = ("CWE-78", "CWE-94", "CWE-502"), ("CWE-20", "CWE-200")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return F.coalesce(hit, F.lit(False))


def _add(condition: Column, value: float) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))


def first_tier(source: Column, sink: Column, context: Column, template: Column, same_function: Column, base: float = 0.5) -> tuple[Column, Column]:
    """Score and route of a candidate: high, review or filtered.

    A sanitizer in the context or around the source filters it with score 0.
    """
    clean = F.coalesce(context.rlike(SANITIZERS), F.lit(False)) | F.coalesce(source.rlike(SANITIZERS), F.lit(False))
    last = F.substring_index(source, ".", -1)
    direct = (F.length(last) > 0) & F.contains(sink, last)
    boosted = F.lit(base) + _add(template, 0.3) + _add(same_function, 0.2) + _add(context.rlike(CONCATENATION), 0.25) + _add(direct, 0.15)
    score = F.when(clean, F.lit(0.0)).otherwise(F.least(boosted, F.lit(1.0)))
    route = F.when(clean, "filtered").when(score >= 0.85, "high").when(score >= 0.45, "review").otherwise("filtered")
    return score, route


def second_tier(score: Column, source: Column, sink: Column, callee: Column, context: Column, types: Column, template: Column, same_function: Column, same_file: Column, distance: Column) -> tuple[Column, Column]:
    """Additive score in a fixed order of addition, and the decision: vulnerable, uncertain or safe."""
    low_sink, low_source = F.lower(sink), F.lower(source)
    to_path, to_markup = _any(low_sink, PATH_SINKS), _any(low_sink, MARKUP_SINKS)
    out = score + _add(template, 0.25) + _add(same_function, 0.15) + _add(distance < 10, 0.1)
    out = out + _add(F.arrays_overlap(types, F.array(*(F.lit(c) for c in CRITICAL))), 0.1)
    out = out + _add(to_path, 0.35) + _add(to_path & _any(low_source, PATH_SOURCES), 0.15)
    out = out + _add(to_path & (F.contains(low_source, F.lit("..")) | F.contains(F.coalesce(context, F.lit("")), F.lit(".."))), 0.2)
    out = out + _add(to_markup, 0.25) + _add(to_markup & _any(low_source, MARKUP_SOURCES), 0.1)
    out = out + _add(to_markup & _any(low_sink, ("innerhtml", "document.write")), 0.15) + _add(to_markup & _any(low_sink, ("bypasssecuritytrust",)), 0.2)
    out = out + _add(~F.coalesce(same_file, F.lit(False)), -0.2)
    out = out + F.when(distance > 100, F.lit(-0.3)).when(distance > 50, F.lit(-0.15)).otherwise(F.lit(0.0))
    out = out + _add(_any(F.lower(callee), QUIET_SINKS), -0.4) + _add(_any(low_source, QUIET_SOURCES), -0.3)
    mild = F.array(*(F.lit(c) for c in MILD))
    out = out + _add((F.size(types) > 0) & (F.size(F.array_except(types, mild)) == 0), -0.15)
    strong = F.coalesce(template, F.lit(False)) | F.coalesce(same_function, F.lit(False)) | F.coalesce(distance < 10, F.lit(False))
    final = clamp(out + _add(~strong, -0.2))
    return final, F.when(final >= 0.75, "vulnerable").when(final <= 0.45, "safe").otherwise("uncertain")


def counted(df: DataFrame, column: str) -> DataFrame:
    """The sizes of the buckets a router made."""
    return df.groupBy(column).agg(F.count("*").alias("n"))
