"""Cutting lineage in loops and long chains of mutations."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"braid-checkpoints-{application}-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only for a session on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _local_folder(spark.sparkContext.applicationId)
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its rows in the shared folder, where lost executors don't matter."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
