"""Packing: nothing is lost, nothing overflows, and the filling is near the best possible."""

import random

import pytest
from pyspark.sql import functions as F

from lodeflow.llm import packing


def docs(spark, sizes):
    return spark.createDataFrame([(i, "a " * n, n if i % 3 else None) for i, n in enumerate(sizes)], "doc_id long, text string, n_tokens int")


def test_whole_and_full(spark):
    rng = random.Random(1)
    sizes = [rng.choice([rng.randrange(1, 400), rng.randrange(1, 400), rng.randrange(400, 6000)]) for _ in range(500)] + [2048, 4096, 0]
    rows = packing.pack(docs(spark, sizes), "doc_id", "text", "n_tokens").collect()
    room, parts = {}, {}
    for r in rows:
        room[r.container] = room.get(r.container, 0) + r.token_end - r.token_start
        parts.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
    assert max(room.values()) <= 2048
    for i, n in enumerate(sizes):
        own = sorted(parts.get(i, []))
        assert sum(e - s for s, e in own) == n and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        assert len(own) == -(-n // 2048)
    assert len(room) <= -(-sum(sizes) // 2048) + 2


def test_other_limits(spark):
    limits = packing.Limits(tokens=100, segments=3, loss_tokens=20)
    df = docs(spark, [10] * 60).withColumn("loss", F.lit(9))
    used = packing.pack(df, "doc_id", "text", "n_tokens", limits, "loss").groupBy("container").agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in used) <= 2 and len(used) == 30


def test_shards_are_merged(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 20_000)
    rng = random.Random(2)
    sizes = [rng.randrange(1, 300) for _ in range(600)]
    report = packing.packing_report(packing.pack(docs(spark, sizes), "doc_id", "text", "n_tokens")).first()
    assert report.n_tokens == sum(sizes) and report.n_containers <= report.least_containers + 2


@pytest.mark.parametrize(("text", "n"), [("a_b c1, d!", 7), ("", 0), ("  \n", 0), ("éß 中文 x", 3), ("(a)", 3)])
def test_count(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(packing.count_tokens(F.col("t"))).first()[0] == n


def test_given_counts_agree(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_tokens is not null")
    assert d.where(packing.count_tokens(F.col("text")) != F.col("n_tokens")).count() == 0


def test_empty(spark):
    assert packing.pack(docs(spark, [5]).limit(0), "doc_id", "text", "n_tokens").count() == 0
    nulls = spark.createDataFrame([(1, None, None), (None, "a b", None)], "doc_id long, text string, n_tokens int")
    assert [tuple(r)[1:] for r in packing.pack(nulls, "doc_id", "text", "n_tokens").collect()] == [(None, 0, 2)]


def test_whole_pieces_have_containers_of_their_own(spark):
    df = spark.createDataFrame([(None, 2048), (None, 2048), (7, 4096), (7, 2048), (None, 5)], "doc_id long, n_tokens int").selectExpr("*", "'' as text")
    used = packing.pack(df, "doc_id", "text", "n_tokens").groupBy("container").agg(F.sum(F.expr("token_end - token_start")).alias("t")).collect()
    assert sorted(r.t for r in used) == [5, 2048, 2048, 2048, 2048, 2048]


def test_three_limits_bind(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'' as text", "cast(20 + id % 91 * 5 as int) as n", "cast(least(20 + id % 91 * 5, 5 + id % 53 * 3) as int) as loss")
    limits = packing.Limits(2048, 7, 500)
    packed = packing.pack(df, "doc_id", "text", "n", limits, "loss")
    r = packing.vector_report(packed, df.selectExpr("doc_id", "loss as loss_tokens"), limits).first()
    assert packed.count() == 4000 and r.most_tokens <= 2048 and r.most_segments == 7 and r.most_loss_tokens <= 500
    assert r.n_containers <= 1.1 * max(r.least_by_tokens, r.least_by_segments, r.least_by_loss_tokens)


def test_an_item_that_exceeds_the_loss_limit_is_cut(spark):
    df = spark.createDataFrame([(1, 1000, 900), (2, 3000, 0), (3, 10, 99), (4, 10, -1)], "doc_id long, n int, loss int").selectExpr("*", "'' as text")
    rows = packing.pack(df, "doc_id", "text", "n", packing.Limits(2048, 8, 400), "loss").collect()
    sizes = {d: sorted(r.token_end - r.token_start for r in rows if r.doc_id == d) for d in (1, 2, 3, 4)}
    assert sizes == {1: [112, 444, 444], 2: [952, 2048], 3: [10], 4: [10]}
