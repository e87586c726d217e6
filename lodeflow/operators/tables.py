"""Relational building blocks: top-k, pages, pivots, lookups, unions by key, samples and search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows; the order must end in a unique column."""
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, by: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each group (Spark limits groups before the shuffle)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """A page of the ordered rows, counted from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def zero_filled(df: DataFrame, by: list[str], column: str, values: tuple[str, ...]) -> DataFrame:
    """One count column per value, zero where it doesn't occur; other values aren't counted."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


def confusion(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """n, accuracy, precision, recall, f1 and false-positive rate; 0 where a ratio has no base."""
    t, s = F.coalesce(truth, F.lit(False)), F.coalesce(said, F.lit(False))
    sums = df.agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return sums.select(
        n.alias("n"),
        F.round(ratio(F.col("tp") + F.col("tn"), n), 6).alias("accuracy"),
        F.round(p, 6).alias("precision"),
        F.round(r, 6).alias("recall"),
        F.round(ratio(2 * p * r, p + r), 6).alias("f1"),
        F.round(ratio(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("fpr"),
    )


def resolve_by_priority(wanted: DataFrame, key: str, lookups: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Resolve keys in the first lookup that has them: key, target, priority.

    ``lookups`` are (table, key column, target column), best first; within one the smallest target
    wins. Keys that no lookup has keep a null target.
    """
    known = None
    for n, (table, column, target) in enumerate(lookups):
        part = table.select(F.col(column).alias(key), F.struct(F.lit(n).alias("priority"), F.col(target).alias("target")).alias("hit")).where(F.col(key).isNotNull())
        known = part if known is None else known.unionByName(part)
    best = known.groupBy(key).agg(F.min("hit").alias("hit"))
    return wanted.join(best, key, "left").select(*wanted.columns, F.col("hit.target").alias("target"), F.col("hit.priority").alias("priority"))


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """The rows of both, where a row of ``over`` replaces that of the same key."""
    return base.join(over.select(key), key, "left_anti").unionByName(over.select(base.columns))


def balanced(df: DataFrame, label: str, key: str) -> DataFrame:
    """As many rows of each label as the rarest has, chosen by the digest of the key (stable over runs).

    Rows are counted by the head of their digest first; whole buckets below the cut stay as they are, and only those of the bucket
    that holds the cut are ranked, so that no label is sorted in one task.
    """
    marked = df.withColumn("_d", F.sha2(F.col(key).cast("string"), 256)).withColumn("_b", F.substring("_d", 1, 3))
    counts = marked.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    least = counts.groupBy(label).agg(F.sum("_n").alias("_t")).agg(F.min("_t").alias("_least"))
    ahead = F.sum("_n").over(Window.partitionBy(label).orderBy("_b")) - F.col("_n")  # 4,096 rows a label
    room = counts.select(F.col(label).alias("_label"), F.col("_b").alias("_bucket"), ahead.alias("_ahead"), "_n").crossJoin(F.broadcast(least))  # one row
    room = room.where("_ahead < _least").select("_label", "_bucket", (F.col("_least") - F.col("_ahead")).alias("_room"), "_n")
    held = marked.join(room, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_b") == F.col("_bucket")))
    ranked = held.where("_n > _room").withColumn("_rn", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_d", key))).where("_rn <= _room")
    return held.where("_n <= _room").select(df.columns).unionByName(ranked.select(df.columns))


#: Queries and vectors that meet in one task of a search.
QUERY_BLOCK, VECTOR_BLOCK = 1_000, 50_000


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """For each query its k nearest other vectors by Euclidean distance (5 decimals): query_id, key, distance, rank.

    A stated query set meets all rows in blocks: queries and vectors are hashed into blocks, each block of queries is sent to each
    block of vectors, and a task gives the k nearest of its own; these are ranked at the end. Null vectors are left out; ties go to the smaller key.
    """
    kind = dict(vectors.dtypes)[key]
    q, v = (d.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x")) for d in (queries, vectors))
    n_q, n_v = -(-q.count() // QUERY_BLOCK) or 1, -(-v.count() // VECTOR_BLOCK) or 1
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("id", "x", block(n_q).alias("qb"), each(n_v).alias("vb"))
    right = v.select("id", "x", block(n_v).alias("vb"), each(n_q).alias("qb"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            ids, x = b["id"].to_numpy(), np.stack(b["x"].to_numpy())
            for one, y in zip(a["id"].tolist(), a["x"], strict=True):
                d = np.round(np.sqrt(((x - y) ** 2).sum(axis=1)), 5)
                order = [i for i in np.lexsort((ids, d))[: k + 1].tolist() if ids[i] != one][:k]
                rows += [(one, ids[i], d[i]) for i in order]
        return pd.DataFrame(rows, columns=["query_id", key, "distance"])

    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(search, f"query_id {kind}, {key} {kind}, distance double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key)))
    return ranked.where(F.col("rank") <= k)
