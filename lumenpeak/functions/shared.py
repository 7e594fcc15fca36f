"""The shared working folder: lineage is cut by tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def working_folder(spark: SparkSession) -> str:
    """Folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may run without it; it then gets a fresh folder of its
    own, since all its tasks share one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="lumenpeak-")
    context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{working_folder(spark).rstrip('/')}/lumenpeak/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later plans start from the files.

    The files survive lost executors, and their size is what Spark goes by when
    it decides whether a join side may be broadcast.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_round(df: DataFrame, name: str, settled: str) -> tuple[DataFrame, DataFrame, bool]:
    """Write the state of an iteration; (settled rows, open rows, any open).

    Whether rows are left is observed during the write, so it costs no job.
    """
    watch = Observation()
    table = written(df.observe(watch, F.max((~F.col(settled)).cast("int")).alias("open")), name)
    return table.where(settled), table.where(f"NOT {settled}"), bool(watch.get["open"])
