from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from maskwright.operators.shared import new_table_path, shared_folder


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lit(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    """Texts as a SQL list."""
    return "[" + ", ".join(lit(v) for v in values) + "]"


@cache
def _own_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="suite-")


def work_path(spark: SparkSession, stem: str) -> str:
    """Where a query may write: in the session's shared folder. Where none is set, as in a local
    session for tests, one is set that goes when the program ends."""
    try:
        shared_folder(spark)
    except ValueError:
        if not spark.sparkContext.master.startswith("local"):
            raise
        spark.sparkContext.setCheckpointDir(_own_folder().name)
    return new_table_path(spark, stem)
