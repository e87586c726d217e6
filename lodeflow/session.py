"""Session building, table loading and durable lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "lodeflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword settings (dots as ``__``) win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (ENGINE_CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    With a local master, where it may be unset (tests), a temporary folder is set. On a cluster a
    folder of one machine would lose data, so an unset one is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeflow-", dir=os.environ.get("TMPDIR"))
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lodeflow-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there stays until ``release`` or the end of the application."""
    atexit.unregister(release)
    atexit.register(release, spark)
    return f"{_tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to a new folder and read it back: a lineage cut with column pruning."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; results that read them can't be used any more."""
    with contextlib.suppress(Exception):  # the session may be gone
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables_dir(spark))
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: The option that names into how many partitions inputs are spread before compute-heavy row-local work.
SPREAD = "spark.lodeflow.spread.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Spread the rows over as many partitions as the option SPREAD says; unset, they stay where they are.

    For inputs that are one small file, and so one task, on many cores. Nothing is guessed from sizes.
    """
    wanted = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(wanted)) if wanted else df
