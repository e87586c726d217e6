"""Sources: repository scans, rule files, symbols and imports of Python and JavaScript files."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeflow.functions.scalars import LANGUAGES, language_of_path, matches_glob

SYMBOLS = "path string, name string, type string, line int, parent string, visibility string, signature string"
RULES = "kind string, name string, pattern string, type string, confidence double, cwe_types array<string>, language string, enabled boolean"


def scan_repository(spark: SparkSession, root: str, exclude: list[str] | None = None, max_mb: float = 10.0, languages: list[str] | None = None) -> DataFrame:
    """path, language, size_bytes, lines, hash, content of the code files under a folder.

    Files above the size are pruned by the scan; excluded ones by glob on the path or name. Files that
    aren't UTF-8 have 0 lines and null content.
    """
    suffixes = [s for s, name in LANGUAGES.items() if not languages or "auto" in languages or name in languages]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= int(max_mb * 1024 * 1024))
    base = re.escape(str(root).rstrip("/"))
    named = files.withColumn("path", F.regexp_replace("path", f"^(?:file:)?/*{base.lstrip('/')}/+", "")).withColumn("language", language_of_path(F.col("path")))
    chosen = named.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes) & ~matches_glob(F.col("path"), exclude or []))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return chosen.select(
        "path",
        "language",
        F.col("length").alias("size_bytes"),
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias("lines"),
        F.substring(F.sha2("content", 256), 1, 16).alias("hash"),
        text.alias("content"),
    )


def _visibility(name: str) -> str:
    if name.startswith("__") and not name.endswith("__"):
        return "private"
    return "protected" if name.startswith("_") else "public"


def _python_symbols(path: str, text: str) -> list[tuple]:
    rows: list[tuple] = []

    def walk(node: ast.AST, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                rows.append((path, child.name, "class", child.lineno, parent, _visibility(child.name), child.name))
                walk(child, child.name)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                rows.append((path, child.name, "method" if parent else "function", child.lineno, parent, _visibility(child.name), f"{child.name}({ast.unparse(child.args)})"))
                walk(child, parent)
            else:
                walk(child, parent)

    walk(ast.parse(text), None)
    return rows


_JS = re.compile(
    r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<function>[A-Za-z_$][\w$]*)[ \t]*(?P<args>\([^)]*\))"
    r"|(?:abstract[ \t]+)?class[ \t]+(?P<class>[A-Za-z_$][\w$]*)|interface[ \t]+(?P<interface>[A-Za-z_$][\w$]*)"
    r"|(?:const|let|var)[ \t]+(?P<arrow>[A-Za-z_$][\w$]*)[ \t]*=[ \t]*(?:async[ \t]*)?(?P<aargs>\([^)]*\)|[\w$]+)[ \t]*=>)"
)


def _script_symbols(path: str, text: str) -> list[tuple]:
    rows = []
    for m in _JS.finditer(text):
        line = text.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1
        for kind, group in (("function", "function"), ("class", "class"), ("interface", "interface"), ("function", "arrow")):
            if m[group]:
                rows.append((path, m[group], kind, line, None, "public", m[group] + (m["args"] or m["aargs"] or "")))
    return rows


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, language, content); files that don't parse give no rows."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, language, text in zip(batch["path"], batch["language"], batch["content"], strict=True):
                if not text:
                    continue
                try:
                    rows += _python_symbols(path, text) if language == "python" else _script_symbols(path, text)
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SYMBOLS.split(", ")])

    return files.select("path", "language", "content").mapInPandas(extract, SYMBOLS)


def imports(files: DataFrame) -> DataFrame:
    """path, module: imported modules of Python and script files, by regex on the text."""
    python = F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import|import[ \t]+([\w.]+))"), F.lit(0))
    script = F.regexp_extract_all("content", F.lit(r"""(?:from\s+|require\(\s*|import\s+)["']([^"'\n]+)["']"""), F.lit(1))
    found = F.when(F.col("language") == "python", F.transform(python, lambda m: F.regexp_extract(m, r"(?:from|import)[ \t]+([\w.]+)", 1))).otherwise(script)
    return files.select("path", F.explode(F.array_distinct(found)).alias("module"))


def load_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of the JSON or YAML files of a folder (kind, name, pattern, type, confidence, ...)."""
    rows = []
    for p in sorted(Path(folder).glob("*")):
        if p.suffix == ".json":
            rows += json.loads(p.read_text())
        elif p.suffix in (".yaml", ".yml"):
            import yaml

            rows += yaml.safe_load(p.read_text()) or []
    names = [c.split()[0] for c in RULES.split(", ")]
    return spark.createDataFrame([tuple(r.get(n, True if n == "enabled" else None) for n in names) for r in rows], RULES)


def rule_errors(rules: DataFrame) -> DataFrame:
    """Rules that can't be used, with what is wrong: name, problem."""
    problems = F.array_compact(
        F.array(
            F.when(F.col("name").isNull() | F.col("pattern").isNull() | F.col("type").isNull(), F.lit("a required field is missing")),
            F.when(~F.col("confidence").between(0, 1), F.lit("the confidence is not between 0 and 1")),
            F.when(F.exists(F.coalesce("cwe_types", F.array()), lambda c: ~c.startswith("CWE-")), F.lit("a weakness has no CWE- prefix")),
        )
    )
    return rules.select("name", F.explode(problems).alias("problem"))
