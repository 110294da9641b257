"""Shared scratch folders, and rows that are held for several steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset and Spark is local (tests), under a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='arborstream-')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to a new shared folder and read them back, which ends their lineage."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_HELD: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """Keep rows that several steps of a query read, which its input determines."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    _HELD.append(held)
    return held


def release() -> None:
    """Let go of all rows held so far; what reads them later makes them again."""
    while _HELD:
        _HELD.pop().unpersist()
