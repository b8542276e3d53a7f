"""Cutting lineage through the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; only a local master without the setting gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    ensure_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read from there: computed once, safe when executors go.

    Shuffle files of the write go as soon as it ends: the table takes their place.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables that stored() made, once nothing to come reads them: what was made from them must be stored itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
