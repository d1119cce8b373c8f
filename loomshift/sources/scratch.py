"""Intermediate results that outlive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that a folder of this machine is shared by all."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder on a local master and an error on any other."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomshift-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """df computed once: what reads it sees the same rows in the same partitions, whatever becomes of the executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
