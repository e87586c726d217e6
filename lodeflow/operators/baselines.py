"""Baselines of findings: fingerprints, comparison and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodeflow.functions.scalars import short_digest


def fingerprint(**parts: Column) -> Column:
    """A digest of named parts in the order of their names; null parts are left out."""
    return short_digest(F.concat_ws("|", *(F.when(parts[n].isNotNull(), F.concat(F.lit(f"{n}:"), parts[n])) for n in sorted(parts))))


def compare(current: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> DataFrame:
    """key, state: new, existing, or resolved (active in the baseline and not seen now).

    A full outer join of the distinct keys. Entries that aren't active and aren't seen are left out.
    """
    now = current.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_now", F.lit(True))
    old = baseline.groupBy(key).agg(F.max(F.col("status") == "active").alias("_active")).where(F.col(key).isNotNull())
    state = F.when(F.col("_now") & F.col("_active").isNull(), "new").when(F.col("_now"), "existing").when(F.col("_active"), "resolved")
    return now.join(old, key, "full_outer").select(key, state.alias("state")).where("state is not null")


def upsert(baseline: DataFrame, current: DataFrame, key: str = "fingerprint", keep_suppressed: bool = False) -> DataFrame:
    """key, first_seen, last_seen, status after the current findings (key, seen) are taken in.

    Seen entries become active and their last_seen moves on; new ones start; entries not seen are
    resolved, or stay suppressed by option.
    """
    now = current.groupBy(key).agg(F.min("seen").alias("_from"), F.max("seen").alias("_to")).where(F.col(key).isNotNull())
    joined = baseline.select(key, "first_seen", "last_seen", "status").join(now, key, "full_outer")
    gone = F.when((F.col("status") == "suppressed") & F.lit(keep_suppressed), "suppressed").otherwise("resolved")
    return joined.select(
        key,
        F.coalesce("first_seen", "_from").alias("first_seen"),
        F.coalesce(F.greatest("last_seen", "_to"), F.col("last_seen"), F.col("_to")).alias("last_seen"),
        F.when(F.col("_to").isNotNull(), "active").otherwise(gone).alias("status"),
    )
