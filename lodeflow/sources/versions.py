"""Versioned JSON tables: specifications and baselines that are merged and kept with their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeflow.operators.flows import keep_first


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete versions under a path, oldest first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def read_latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version; a path without versions is an empty table."""
    found = versions(spark, path)
    return spark.read.schema(schema).json(f"{path}/v{found[-1]}") if found else spark.createDataFrame([], schema)


def write_version(df: DataFrame, path: str) -> int:
    """Write the table as the next version and return its number; older versions stay."""
    number = (versions(df.sparkSession, path) or [0])[-1] + 1
    df.write.mode("overwrite").json(f"{path}/v{number}")
    return number


def merge_version(df: DataFrame, path: str, schema: str, keys: list[str]) -> int:
    """Write the newest version with new rows added; of equal keys the kept row wins."""
    old = read_latest(df.sparkSession, path, schema)
    both = old.withColumn("_n", F.lit(0)).unionByName(df.select(old.columns).withColumn("_n", F.lit(1)))
    return write_version(keep_first(both, keys, ["_n", *(c for c in old.columns if c not in keys)]).drop("_n"), path)
