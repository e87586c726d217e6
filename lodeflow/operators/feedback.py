"""What false positives teach: sanitizers read from the traces of findings that proved harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodeflow.operators.flows import keep_first
from lodeflow.operators.text import called_names

# Words before a bracket that are no calls.
NO_CALLS = ("if", "for", "while", "return", "function", "def", "switch", "catch", "print")


def learned_sanitizers(findings: DataFrame, steps: DataFrame, least: float = 0.5) -> DataFrame:
    """method, line, confidence, finding_id: one sanitizer per (method, line), first finding wins.

    Taken from false positives with at least the given confidence. The name is the first call in the
    code of a sanitizing step, else ``sanitizer_line_n``; the confidence is the verdict's times 0.9.
    """
    harmless = findings.where((F.col("verification.verdict") == "false_positive") & (F.col("verification.confidence") >= least))
    sure = harmless.select(F.col("id").alias("finding_id"), (F.col("verification.confidence") * 0.9).alias("confidence"))
    clean = steps.where((F.lower(F.trim("step_type")) == "sanitizer") & F.col("line").isNotNull()).select("finding_id", "step_id", "line", called_names(F.col("code_snippet"), NO_CALLS).alias("names"))
    named = clean.join(sure, "finding_id").withColumn("method", F.coalesce(F.get("names", F.lit(0)), F.concat(F.lit("sanitizer_line_"), F.col("line").cast("string"))))
    return keep_first(named, ["method", "line"], ["finding_id", "step_id"]).select("method", "line", "confidence", "finding_id")
