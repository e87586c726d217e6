"""Report sinks: nested JSON per scan written by Spark, and short summaries as Markdown or HTML."""

from __future__ import annotations

from collections.abc import Callable
from html import escape

from pyspark.sql import DataFrame, functions as F

from lodeflow.functions.scalars import SEVERITIES, severity_rank

WRITERS: dict[str, Callable[[DataFrame, str], None]] = {}
#: Rows that a rendered summary shows at most; the counts above them are over everything.
SHOWN = 50


def writer(name: str):
    def register(func):
        WRITERS[name] = func
        return func

    return register


def summary(findings: DataFrame) -> DataFrame:
    """severity, n, n_false_positive: a row for each severity, zero where there is none."""
    counts = findings.groupBy(F.lower("severity").alias("severity")).agg(F.count("*").alias("n"), F.count_if(F.col("verification.verdict") == "false_positive").alias("n_false_positive"))
    every = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(counts, "severity", "left").na.fill(0, ["n", "n_false_positive"])


def filtered(findings: DataFrame, least_severity: str = "info", least_confidence: float = 0.0, keep_false_positives: bool = True) -> DataFrame:
    """Findings at or above a severity; the confidence is the verification's, or 1 without one."""
    rank = SEVERITIES.index(least_severity) + 1
    out = findings.where((severity_rank(F.col("severity")) <= rank) & (F.coalesce("verification.confidence", F.lit(1.0)) >= least_confidence))
    return out if keep_false_positives else out.where("verification.verdict is null or verification.verdict != 'false_positive'")


def fails(findings: DataFrame, at: str) -> bool:
    """Whether any finding is as severe as ``at`` or more: a gate for pipelines."""
    return not filtered(findings, at).limit(1).isEmpty()


def _table(findings: DataFrame) -> tuple[list, list]:
    counts = {r.severity: r.n for r in summary(findings).collect()}  # five rows
    top = findings.orderBy(severity_rank(F.col("severity")), F.desc_nulls_last("confidence"), "id").limit(SHOWN)
    return [(s, counts[s]) for s in SEVERITIES], top.select("id", "vulnerability_type", "severity", "title").collect()


@writer("json")
def write_json(findings: DataFrame, path: str) -> None:
    """One JSON document per scan, written by Spark in parallel."""
    row = F.struct(*(F.col(c) for c in findings.columns if c != "scan_id"))
    findings.groupBy("scan_id").agg(F.sort_array(F.collect_list(row)).alias("findings")).write.mode("overwrite").json(path)


@writer("jsonl")
def write_lines(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


@writer("markdown")
def write_markdown(findings: DataFrame, path: str) -> None:
    counts, top = _table(findings)
    lines = ["# Findings", "", "| severity | findings |", "|---|---|", *(f"| {s} | {n} |" for s, n in counts), "", "| id | weakness | severity | title |", "|---|---|---|---|"]
    lines += [f"| {r.id} | {r.vulnerability_type} | {r.severity} | {(r.title or '').replace('|', '/')} |" for r in top]
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(lines) + "\n")


@writer("html")
def write_html(findings: DataFrame, path: str) -> None:
    counts, top = _table(findings)
    rows = "".join(f"<tr><td>{escape(s)}</td><td>{n}</td></tr>" for s, n in counts)
    more = "".join("<tr>" + "".join(f"<td>{escape(str(x))}</td>" for x in r) + "</tr>" for r in top)
    with open(path, "w", encoding="utf-8") as out:
        out.write(f"<!doctype html><meta charset='utf-8'><title>Findings</title><table>{rows}</table><table>{more}</table>\n")


def write(findings: DataFrame, path: str, form: str) -> None:
    """Write a report in one of the registered forms."""
    if form not in WRITERS:
        raise ValueError(f"unknown report form {form!r}; known: {', '.join(sorted(WRITERS))}")
    WRITERS[form](findings, path)
