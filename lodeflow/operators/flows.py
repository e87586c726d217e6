"""Pairing of sources and sinks, their scores and their typed combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Which weakness names a flow that has several.
PRIMARY_ORDER = ("CWE-78", "CWE-89", "CWE-94", "CWE-22", "CWE-79", "CWE-918")


def pair_flows(sources: DataFrame, sinks: DataFrame, on: list[str], categories: str, line: str) -> DataFrame:
    """Sources and sinks with equal keys whose category arrays overlap.

    The categories are exploded and joined with the keys, so that sides of a hot key only meet under a category they
    share; a pair is kept under the first of its shared categories, once. Columns of the sides are prefixed
    ``source_`` and ``sink_``. Adds ``shared`` (sorted) and ``distance``. Null keys and null or empty
    categories pair with nothing.
    """
    left = sources.select(*on, *(F.col(c).alias(f"source_{c}") for c in sources.columns if c not in on), F.explode(F.array_distinct(categories)).alias("_category"))
    right = sinks.select(*on, *(F.col(c).alias(f"sink_{c}") for c in sinks.columns if c not in on), F.explode(F.array_distinct(categories)).alias("_category"))
    shared = F.array_sort(F.array_intersect(f"source_{categories}", f"sink_{categories}"))
    joined = left.join(right, [*on, "_category"]).withColumn("shared", shared).where(F.col("_category") == F.col("shared")[0]).drop("_category")
    return joined.withColumn("distance", F.abs(F.col(f"sink_{line}") - F.col(f"source_{line}")))


def heuristic_score(same_function: Column, template: Column, distance: Column, same_file: Column, base: float = 0.5) -> Column:
    """The summed evidence of a flow, at most 0.94; the order of addition is kept for equal doubles."""
    yes = lambda c, v: F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0))
    near = F.when(distance < 10, F.lit(0.2)).when(distance < 20, F.lit(0.1)).otherwise(F.lit(0.0))
    return F.least(F.lit(base) + yes(same_function, 0.3) + yes(template, 0.4) + near + yes(same_file, 0.1), F.lit(0.94))


def primary_category(shared: Column) -> Column:
    """The first of the ordered weaknesses that is shared, else the smallest shared one."""
    ordered = [F.when(F.array_contains(shared, c), F.lit(c)) for c in PRIMARY_ORDER]
    return F.coalesce(*ordered, F.array_min(shared))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the given order. Ties need an order that ends in a unique column."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def typed_pairs(sources: DataFrame, sinks: DataFrame, name: str, types: str, untyped: str = "DATA_FLOW") -> DataFrame:
    """Pairs of small specification tables by type: source, sink, type.

    Two typed sides meet on their shared types; one untyped side takes the other's types; two
    untyped sides meet once under ``untyped``. Written as equi-joins of exploded types, so that
    no full product is formed for typed sides.
    """
    s = sources.select(F.col(name).alias("source"), F.coalesce(F.col(types), F.array().cast("array<string>")).alias("st"))
    k = sinks.select(F.col(name).alias("sink"), F.coalesce(F.col(types), F.array().cast("array<string>")).alias("kt"))
    st, kt = s.select("source", F.explode("st").alias("type")), k.select("sink", F.explode("kt").alias("type"))
    bare_s, bare_k = s.where("size(st) = 0").select("source", F.lit(1).alias("_j")), k.where("size(kt) = 0").select("sink", F.lit(1).alias("_j"))
    both = st.join(kt, "type").select("source", "sink", "type")
    one = bare_s.join(kt.withColumn("_j", F.lit(1)), "_j").select("source", "sink", "type").unionByName(st.withColumn("_j", F.lit(1)).join(bare_k, "_j").select("source", "sink", "type"))
    none = bare_s.join(bare_k, "_j").select("source", "sink", F.lit(untyped).alias("type"))
    return both.unionByName(one).unionByName(none).distinct()


def with_sanitizers(pairs: DataFrame, sanitizers: DataFrame, type_column: str, confidence: str) -> DataFrame:
    """Left group-join of sanitizers by type: adds n_sanitizers and the confidence times 0.5 or 0.85."""
    counted = sanitizers.groupBy(type_column).agg(F.count("*").alias("n_sanitizers"))
    joined = pairs.join(counted, type_column, "left").withColumn("n_sanitizers", F.coalesce("n_sanitizers", F.lit(0)))
    return joined.withColumn("adjusted", F.col(confidence) * F.when(F.col("n_sanitizers") > 0, F.lit(0.5)).otherwise(F.lit(0.85)))
