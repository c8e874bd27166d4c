"""The folder all executors can reach, for tables that a caller asks for; shuffle files that are done with."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach.")
    return folder.rstrip("/")


def new_table_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no table in use needs any more. It does so once both
    garbage collectors have seen that nothing refers to them, which on a driver with little to do may
    be long after the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
