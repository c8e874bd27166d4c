"""Writers: Parquet results and CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.folders import delete, exists, rename_new

RESULT_NAME = "output.parquet"


def result_path(out_dir: str) -> str:
    return out_dir.rstrip("/") + "/" + RESULT_NAME


def _ready_path(out_dir: str) -> str:
    """A whole result that has not taken its place yet; hidden from readers of the folder."""
    return out_dir.rstrip("/") + "/_ready.parquet"


def find_result(spark: SparkSession, out_dir: str) -> str | None:
    """Where the newest whole result of a folder is; None if there is none. That is ``output.parquet``
    but for the moment, or after a crash, between the two renames of a switch."""
    return next((p for p in (result_path(out_dir), _ready_path(out_dir)) if exists(spark, p)), None)


def _switch(spark: SparkSession, out_dir: str) -> None:
    """Put a ready result in the place of the one before, which then goes."""
    path, ready = result_path(out_dir), _ready_path(out_dir)
    old = f"{out_dir.rstrip('/')}/_old-{uuid.uuid4().hex}"
    replaced = exists(spark, path) and rename_new(spark, path, old)
    if not rename_new(spark, ready, path):
        raise RuntimeError(f"Another job has written {path} meanwhile; this one's result is {ready}")
    if replaced:
        delete(spark, old)


def write_result(df: DataFrame, out_dir: str) -> dict:
    """Write ``<out_dir>/output.parquet`` and count its rows on the way.

    The count is observed in the writing stage itself, which saves a second read. The result is
    written beside the one there may be and takes its place when it is whole: a job that fails leaves
    the old one as it was, which may also be what the job reads. One job at a time writes to a folder.
    A switch that a crash broke off is finished by the next job.
    """
    spark, path = df.sparkSession, result_path(out_dir)
    if exists(spark, _ready_path(out_dir)):
        _switch(spark, out_dir)
    staged = f"{out_dir.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    counted = Observation()
    try:
        df.observe(counted, F.count(F.lit(1)).alias("rows")).write.option("compression", "snappy").parquet(staged)
    except Exception:
        delete(spark, staged)
        raise
    rename_new(spark, staged, _ready_path(out_dir))
    _switch(spark, out_dir)
    return {"result_path": path, "row_count": counted.get["rows"]}


def write_rows(df: DataFrame, path: str) -> int:
    """A new Parquet table; returns its number of rows, counted on the way."""
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return counted.get["rows"]


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV files with a header row each; quotes are doubled.

    Spark's writer would trim the cells, which would change them.
    """
    (
        df.write.mode(mode)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
