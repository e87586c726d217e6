"""Calls of a completion provider from Spark: cached answers, a cascade, and a bounded feedback loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodeflow.session import written

#: A provider maps prompts to (label, confidence); it is called in batches inside tasks and may be repeated.
Provider = Callable[[list[str]], list[tuple[str, float]]]


def complete(df: DataFrame, prompt: str, provider: Provider, batch: int = 64, cache: DataFrame | None = None) -> DataFrame:
    """Add ``answer`` and ``answer_confidence`` for each prompt; equal prompts are asked once.

    Answers in ``cache`` (key, answer, answer_confidence; key is the prompt's SHA-256) aren't asked again.
    A failing call gives the answer ``error`` with confidence 0. Null prompts have null answers.
    Columns of these names that the rows already have are replaced.
    """
    keyed = df.drop("answer", "answer_confidence").withColumn("_key", F.sha2(F.col(prompt), 256))
    asked = keyed.where("_key is not null").groupBy("_key").agg(F.min(prompt).alias("_prompt"))
    if cache is not None:
        asked = asked.join(cache.select(F.col("key").alias("_key")), "_key", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            labels: list[tuple[str, float]] = []
            prompts = rows["_prompt"].tolist()
            for i in range(0, len(prompts), batch):
                part = prompts[i : i + batch]
                try:
                    got = list(provider(part))[: len(part)]
                except Exception:  # noqa: BLE001 - a provider may fail in any way
                    got = []
                labels += got + [("error", 0.0)] * (len(part) - len(got))
            yield pd.DataFrame({"_key": rows["_key"], "answer": [x[0] for x in labels], "answer_confidence": [float(x[1]) for x in labels]})

    answers = asked.mapInPandas(call, "_key string, answer string, answer_confidence double")
    if cache is not None:
        answers = answers.unionByName(cache.select(F.col("key").alias("_key"), "answer", "answer_confidence"))
    return keyed.join(answers, "_key", "left").drop("_key")


def feedback(df: DataFrame, key: str, prompt: str, provider: Provider, rounds: int = 3, least: float = 0.7) -> DataFrame:
    """key, answer, answer_confidence, round: ask again, with the round in the prompt, while an answer is unsure.

    At most ``rounds`` rounds; each round's open rows are written, so that lineage doesn't grow.
    """
    open_rows = df.select(key, F.col(prompt).alias("_p"))
    settled = None
    for n in range(1, rounds + 1):
        answered = complete(open_rows.withColumn("_ask", F.concat(F.lit(f"round {n}: "), "_p")), "_ask", provider)
        rows = written(answered.select(key, "_p", "answer", "answer_confidence"), "feedback")
        sure = (F.col("answer_confidence") >= least) & (F.col("answer") != "uncertain")
        done = rows if n == rounds else rows.where(F.coalesce(sure, F.lit(True)))
        part = done.select(key, "answer", "answer_confidence", F.lit(n).alias("round"))
        settled = part if settled is None else settled.unionByName(part)
        if n == rounds:
            break
        open_rows = rows.where(~F.coalesce(sure, F.lit(True))).select(key, "_p")
        if open_rows.isEmpty():
            break
    return settled
