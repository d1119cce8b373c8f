"""Helpers that every operator of the subpackage shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word rules: space, tab, newline, vertical tab, form feed, carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same for Spark's regular expressions.
SPACE_SQL = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder of this machine on a local master, and an error on any other.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context._jsc.sc().getCheckpointDir().getOrElse(None) if context._jsc else None
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomshift-")
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Queries that are built in this block delete their shuffle files when they end: what they gave is checkpointed or written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, columns: list[str], **more) -> DataFrame:
    """``columns`` of docs as one struct, payload, and ``more`` beside it: no name of docs can meet an inner one."""
    return docs.select(F.struct(*(F.col(quoted(c)) for c in columns)).alias("payload"), *(x.alias(name) for name, x in more.items()))


def numbered(docs: DataFrame, columns: list[str], *more) -> DataFrame:
    """``columns`` of docs as c0, c1, ..., and ``more`` behind them: what goes through Arrow has plain names."""
    return docs.select(*(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(columns)), *more)


def renamed(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """What ``numbered`` named plainly under its own names again, and ``more`` behind it."""
    return df.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)), *more)


def field(column: str):
    """A column out of the payload, under its own name."""
    return F.col("payload").getField(column).alias(column)
