"""Whole jobs: read a table, rewrite a column, write Parquet, keep a record."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwright.functions.patterns import recursing_group
from maskwright.functions.redaction import literal_replacement
from maskwright.operators.catalog import (
    TTL_SECONDS,
    append_entries,
    as_entries,
    changed_entries,
    read_catalog,
    refresh_patterns,
    refresh_specs,
)
from maskwright.operators import run_events
from maskwright.operators.ledger import record_runs
from maskwright.operators.paging import in_order, sort_keys
from maskwright.operators.rewrite import known_mode, require_column, require_mode, rewrite_column
from maskwright.sinks.files import write_result, write_rows
from maskwright.sources.tables import quarantine_csv, read_table, spread, suffix_of


class UnsafePattern(ValueError):
    """The pattern must not be run."""


def check_rule(spark: SparkSession, regex: str, replacement: str = "") -> None:
    """Try the rule on one literal, so that a bad one fails here and not in tasks.

    An empty alternative at the end lets the pattern match an empty text, so that the
    replacement's group numbers are looked at as well. A pattern that a long cell would
    turn into a stack overflow, which ends the executor, is refused by its text.
    """
    if recursing_group(regex):
        raise UnsafePattern(f"The rule {regex!r} repeats a group of varying parts; repeat it possessively.")
    try:
        tried = F.regexp_replace(F.lit(""), F.lit(f"{regex}|"), F.lit(replacement))
        spark.range(1).select(F.lit("").rlike(regex), tried).collect()
    except PySparkException as problem:
        raise UnsafePattern(f"Spark cannot run the rule {regex!r}: {problem}") from problem


def transform(
    df: DataFrame,
    column: str,
    regex: str,
    replacement: str,
    out_dir: str,
    mode: str = "none",
    *,
    literal: bool = False,
    order_by: list[str] | None = None,
) -> dict:
    """Rewrite a column and write the result; ``{result_path, row_count}``.

    Without ``order_by`` the whole job is one narrow stage. With it the rows are
    range-sorted, and the stored order, hence the page order, follows. The source is
    sorted and then rewritten, so that the sort's sample costs no rewriting; only if
    the rewritten column is a key itself does the rewriting come first.
    """
    keys = sort_keys(order_by or [])
    last = bool(keys) and column not in (key.name for key in keys)
    out = in_order(df, keys) if last else df
    out = rewrite_column(out, column, regex, replacement, mode, literal=literal)
    return write_result(in_order(out, keys) if keys and not last else out, out_dir)


def run_transform(
    spark: SparkSession,
    path: str,
    column: str,
    regex: str,
    replacement: str,
    out_dir: str,
    mode: str = "none",
    *,
    literal: bool = False,
    suffix: str | None = None,
    schema: StructType | str | None = None,
    keep_strings: bool = False,
    multi_line: bool = True,
    order_by: list[str] | None = None,
    spread_bytes: int | None = None,
    quarantine_path: str | None = None,
    progress: Callable[[float], None] | None = None,
) -> dict:
    """The same from a file, folder or glob of CSV or Parquet.

    ``spread_bytes``: deal the rows into partitions of about so many bytes first, where
    a few large files that cannot be split would leave most of a cluster idle.
    ``quarantine_path``: rows of CSV files that don't fit the ``schema`` go there as they stand, and
    the result counts them as ``quarantined_rows``; see ``quarantine_csv``. ``progress`` is called with
    the share of the way behind.
    """
    require_mode(mode)
    told = progress or (lambda share: None)
    set_aside = {}
    if quarantine_path is not None:
        if schema is None or (suffix_of(path) if suffix is None else suffix.lower()) != ".csv":
            raise ValueError("Rows are set aside of CSV files with a schema.")
        df, bad = quarantine_csv(spark, path, schema, multi_line=multi_line)
        set_aside["quarantined_rows"] = write_rows(bad, quarantine_path)
    else:
        df = read_table(
            spark, path, suffix=suffix, schema=schema, keep_strings=keep_strings, multi_line=multi_line
        )
    require_column(df, column)
    told(0.1)
    rule = replacement if mode == "none" else ""
    check_rule(spark, regex, literal_replacement(rule) if literal else rule)
    if spread_bytes is not None:
        df = spread(df, path, spread_bytes)
    told(0.3)
    result = transform(
        df, column, regex, replacement, out_dir, mode, literal=literal, order_by=order_by
    )
    told(1.0)
    return {**result, **set_aside}


def pattern_for(
    spark: SparkSession, prompt: str, response: str, mode: str, catalog_path: str | None = None, ttl: int = TTL_SECONDS
) -> str:
    """The pattern for one prompt: the catalogue's, else that of the raw response.

    Repaired for redaction, and audited, by the same expressions as whole tables of
    responses, on one row. What is new or was repaired, and is safe, is added to the
    catalogue. Without one, or before its first entry, the response decides.
    """
    now = datetime.now(timezone.utc)
    row = spark.createDataFrame([(prompt, response)], "prompt string, response string")
    catalog = read_catalog(spark, catalog_path)
    if mode == "none":
        kind, value, plan = "regex", "pattern", refresh_patterns(row, catalog, now, ttl)
    else:
        kind, value, plan = "spec", "value", refresh_specs(row, catalog, now, ttl)
    found = spark.createDataFrame(plan.collect(), plan.schema)  # one row
    result = found.select("pattern", "is_safe", "reason").first()
    if not result.is_safe:
        raise UnsafePattern(f"The pattern may not run ({result.reason}): {result.pattern}")
    changed = as_entries(changed_entries(found, value), kind, now, value)
    if catalog_path and not changed.isEmpty():
        append_entries(changed, catalog_path)
    return result.pattern


class Cancelled(Exception):
    """Somebody cancelled the run."""


def run_recorded(
    spark: SparkSession,
    run: Mapping,
    response: str,
    ledger_path: str,
    catalog_path: str | None = None,
    events_path: str | None = None,
) -> dict:
    """One run from its record and the raw response, with one row in the ledger.

    The pattern comes from the catalogue where it has one for the prompt. Whatever goes
    wrong ends in a FAILED record, not in an exception. Options for reading may be given
    under ``read_options``.

    With ``events_path`` every step is an event as well, for all to see while the run goes on: it
    begins, has its pattern, has read, planned and written. Whether the run was cancelled is read
    before it begins, after its pattern is known, and before its success is put on record; a cancelled
    run does no more work, and its record says so. A run that was queued there goes on under its id.
    """

    started = datetime.now(timezone.utc)
    record = {
        "id": str(uuid.uuid4()),
        "replacement_value": "",
        "original_filename": run["file_path"].rstrip("/").rsplit("/", 1)[-1],
        "generated_regex": "",
        "result_path": "",
        "error_message": "",
        "created_at": started,
        **{k: v for k, v in run.items() if k not in ("read_options", "result_dir")},
        "normalize_mode": known_mode(run.get("normalize_mode")),
        "started_at": started,
        "progress": 10,
    }

    def tell(status: str, **fields) -> None:
        if events_path:
            run_events.record_events(spark, [{"id": record["id"], "status": status, **fields}], events_path)

    def stop_if_cancelled() -> None:
        if events_path and run_events.state_of(spark, events_path, record["id"]) == run_events.CANCELLED:
            raise Cancelled

    def progress(share: float) -> None:
        record["progress"] = max(record["progress"], min(20 + int(78 * share), 98))
        tell(run_events.RUNNING, progress=record["progress"])

    try:
        stop_if_cancelled()
        given = ("file_path", "original_filename", "target_column", "prompt", "replacement_value", "normalize_mode")
        tell(run_events.RUNNING, **{k: record.get(k) for k in given}, progress=10)
        mode = record["normalize_mode"]
        record["generated_regex"] = pattern_for(spark, run["prompt"], response, mode, catalog_path)
        stop_if_cancelled()
        record["progress"] = 20
        tell(run_events.RUNNING, generated_regex=record["generated_regex"], progress=20)
        result = run_transform(
            spark,
            run["file_path"],
            run["target_column"],
            record["generated_regex"],
            record["replacement_value"],
            f"{run['result_dir'].rstrip('/')}/{record['id']}",
            mode,
            progress=progress if events_path else None,
            **run.get("read_options", {}),
        )
        stop_if_cancelled()
        record.update(result, status=run_events.SUCCESS, progress=100)
    except Cancelled:
        record.update(status=run_events.CANCELLED)
    except Exception as problem:  # every failure is on record
        record.update(status=run_events.FAILED, error_message=f"{type(problem).__name__}: {problem}")
    record["updated_at"] = record["completed_at"] = datetime.now(timezone.utc)
    if record["status"] != run_events.CANCELLED:
        ended = {k: record.get(k) for k in ("result_path", "row_count", "error_message", "progress", "quarantined_rows")}
        tell(record["status"], **ended)
    record_runs(spark, [record], ledger_path)
    return record
