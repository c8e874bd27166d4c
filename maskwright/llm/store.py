"""Tables written between the steps of an operator."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm.common import shared_folder


def stored(df: DataFrame, stem: str) -> DataFrame:
    """Written compressed to a new table in the shared folder, and read from there: worked out once,
    whatever is lost later."""
    path = f"{shared_folder(df.sparkSession)}/{stem}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no table in use needs any more. It does so once both
    garbage collectors have seen that nothing refers to them, which on a driver with little to do may
    be long after the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
