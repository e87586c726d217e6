"""Extra columns with the operators' own names do no harm, nor do nulls in all columns."""

from pyspark.sql import functions as F

from lodeflow.llm import history, packing, pairs, pii, secrets, splits
from tests.llm.test_history import SCHEMA, both


def clash(df, *names):
    return df.select("*", *(F.lit("x").alias(n) for n in names))


def test_splits(spark):
    df = spark.createDataFrame([(1, "r/a.py", "c", 1), (2, None, "c", None), (3, None, None, None)], "example_id long, file_path string, code_context string, label int")
    files = clash(spark.createDataFrame([("r/a.py",), (None,)], "path string"), "known", "code")
    found = splits.groups(clash(df, "path", "code", "group_key", "component", "known"), files)
    assert {r.example_id: r.group_key for r in found.collect()} == {1: "r/a.py", 2: "r/a.py", 3: "example:3"}


def test_history(spark):
    rows = [(1, 0, "aa", "t", "f", "m", "n", "low", None, None, "active"), (2, 1, "AA", *[None] * 8), (3, 1, *[None] * 9)]
    links, clusters = both(clash(spark.createDataFrame(rows, SCHEMA), "fp", "key", "k_fp", "kept", "behind"))
    assert [tuple(r) for r in links.collect()] == [(1, 2)] and clusters.count() == 2


def test_packing(spark):
    df = spark.createDataFrame([(1, "a b c", 3), (None, None, None)], "doc_id long, text string, n_tokens int")
    packed = packing.pack(clash(df, "n", "loss", "shard", "token_start", "container"), "doc_id", "text", "n_tokens")
    assert [tuple(r)[1:] for r in packed.collect()] == [(1, 0, 3)]


def test_all_null(spark):
    text = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert pii.find_pii(text, "doc_id", "text").count() == 0 and secrets.find_secrets(secrets.records(text, "t", "doc_id", "text")).count() == 0
    assert pii.sanitise(text, "doc_id", "text").first().sanitised is None
    calls = spark.createDataFrame([(None, None, None, None)], "call_id long, prompt string, prompt_lang string, content string")
    assert [r.defect for r in pairs.find_defects(calls).collect()] == ["empty"]
