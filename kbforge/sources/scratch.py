"""Scratch tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a query's shuffle files when it ends, not when they are collected as garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses; a local folder only where none is configured and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kbforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/kbforge/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files behind: nothing but its result is read again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder, read back with its schema: computed once, kept when executors are lost."""
    path = fresh_dir(df.sparkSession, name)
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
