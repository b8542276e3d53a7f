"""Cutting the plan of an iterative operator: each round is written as a table to the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's folder under spark.checkpoint.dir. A local session without that setting gets a folder of its own; on a
    cluster the setting is required."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """A path in that folder that nothing else uses."""
    return f"{folder(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df computed once and read back from the session's folder.

    A table, not a checkpoint: a checkpoint computes df twice and carries its plan's constraints on, which in an
    iteration grow from round to round until planning no longer ends."""
    path = fresh(df.sparkSession, "round")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._kept_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that kept() made, once nothing to come reads them: what was made from them must be kept itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
