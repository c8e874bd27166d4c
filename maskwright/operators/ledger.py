"""The ledger of runs: a Parquet table that is appended to, and compacted now and then."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of a run record.
_RUN_FIELDS = {
    "id": T.StringType(),
    "status": T.StringType(),
    "progress": T.ShortType(),
    "file_path": T.StringType(),
    "original_filename": T.StringType(),
    "target_column": T.StringType(),
    "prompt": T.StringType(),
    "replacement_value": T.StringType(),
    "normalize_mode": T.StringType(),
    "generated_regex": T.StringType(),
    "result_path": T.StringType(),
    "row_count": T.LongType(),
    "error_message": T.StringType(),
    "created_at": T.TimestampType(),
    "updated_at": T.TimestampType(),
    "started_at": T.TimestampType(),
    "completed_at": T.TimestampType(),
}
RUN_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in _RUN_FIELDS.items()])

# The fields that a list and a status show, that a search looks at, and the
# states that end a run.
LIST_COLUMNS = ("id", "status", "progress", "original_filename", "created_at", "completed_at")
STATUS_COLUMNS = (
    "id", "status", "progress", "normalize_mode", "generated_regex", "row_count",
    "error_message", "created_at", "updated_at", "started_at", "completed_at",
)
SEARCH_COLUMNS = ("id", "original_filename", "prompt")
TERMINAL = ("SUCCESS", "FAILED", "CANCELLED")

# Fixed value: characters of an error that are kept.
MAX_ERROR = 2000


def as_runs(df: DataFrame) -> DataFrame:
    """Rows in the ledger's shape; a missing field is NULL, a long error is cut."""
    present = set(df.columns)
    fields = []
    for field in RUN_SCHEMA:
        value = F.col(field.name) if field.name in present else F.lit(None)
        if field.name == "error_message":
            value = F.left(value.cast("string"), F.lit(MAX_ERROR))
        fields.append(value.cast(field.dataType).alias(field.name))
    return df.select(*fields)


def append_runs(df: DataFrame, path: str) -> None:
    as_runs(df).write.mode("append").parquet(path)


def record_runs(spark: SparkSession, runs: Iterable[Mapping], path: str) -> None:
    """Append run records made on the driver, one or a few."""
    rows = [tuple(run.get(name) for name in RUN_SCHEMA.names) for run in runs]
    append_runs(spark.createDataFrame(rows, RUN_SCHEMA), path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def compact_runs(spark: SparkSession, path: str, new_path: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """The same runs in a new table of few files, by their time; returns it.

    Each run is appended as a file of its own, and a list of a million of them would
    open as many. The old table stays as it is: switch readers over, then drop it. A run
    that was appended twice as it is becomes one.
    """
    runs = read_ledger(spark, path).dropDuplicates()
    files = max(1, -(-runs.count() // rows_per_file))
    runs.repartitionByRange(files, "created_at", "id").sortWithinPartitions("created_at", "id").write.parquet(new_path)
    return read_ledger(spark, new_path)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def list_runs(ledger: DataFrame) -> DataFrame:
    """Newest first."""
    return ledger.select(*LIST_COLUMNS).orderBy(F.desc("created_at"), "id")


def find_runs(ledger: DataFrame, status: str | None = None, search: str | None = None) -> DataFrame:
    """Runs of a status, and with every word of the search in one of three fields.

    The status reaches the Parquet scan; the search ignores case.
    """
    found = ledger if status is None else ledger.where(F.col("status") == status)
    for word in (search or "").split():
        hits = [F.contains(F.lower(F.col(c)), F.lit(word.lower())) for c in SEARCH_COLUMNS]
        found = found.where(hits[0] | hits[1] | hits[2])
    return found


def run_status(ledger: DataFrame, run_id: str) -> DataFrame:
    return ledger.where(F.col("id") == run_id).select(*STATUS_COLUMNS)
