"""The same rules on files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from maskwright.operators import run_events
from maskwright.operators.folders import files_in
from maskwright.operators.rewrite import rewrite_column
from maskwright.sinks.files import find_result, write_result


def start_rewrite(
    stream: DataFrame,
    column: str,
    regex: str,
    replacement: str,
    out_path: str,
    checkpoint: str,
    mode: str = "none",
    *,
    literal: bool = False,
) -> StreamingQuery:
    """Rewrite what is there now and stop; run again for later files.

    The rules hold no state, so there is no watermark, and the file sink with its
    checkpoint writes each input row once.
    """
    return (
        rewrite_column(stream, column, regex, replacement, mode, literal=literal)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out_path)
    )


def batch_folder(out_path: str, batch: int) -> str:
    return f"{out_path.rstrip('/')}/batch-{batch:012d}"


def recorded_batches(
    name: str, column: str, regex: str, replacement: str, out_path: str, events_path: str, mode: str = "none", *, literal: bool = False
) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` does with a batch: rewrite it into a folder of its own, and record it as a
    run ``<name>-<batch>``.

    A batch may be given again, after a failure or from an older checkpoint. Its folder then is
    replaced as a whole, and its events have the same names, so that they count once: each row and each
    record is there once, however often a batch is tried.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark, run = rows.sparkSession, f"{name}-{batch:012d}"
        given = {"id": run, "target_column": column, "generated_regex": regex, "replacement_value": replacement, "normalize_mode": mode}
        if run_events.state_of(spark, events_path, run) is None:
            run_events.record_events(spark, [{**given, "event_id": f"{run} begins", "status": run_events.RUNNING, "progress": 0}], events_path)
        done = write_result(rewrite_column(rows, column, regex, replacement, mode, literal=literal), batch_folder(out_path, batch))
        ended = {"id": run, "event_id": f"{run} ends", "status": run_events.SUCCESS, **done}
        run_events.record_events(spark, [ended], events_path)

    return write


def start_recorded_rewrite(
    stream: DataFrame,
    name: str,
    column: str,
    regex: str,
    replacement: str,
    out_path: str,
    checkpoint: str,
    events_path: str,
    mode: str = "none",
    *,
    literal: bool = False,
) -> StreamingQuery:
    """As ``start_rewrite``, each batch with a record among the run events. ``name`` tells the streams
    that share them apart. ``read_batches`` reads what is written."""
    write = recorded_batches(name, column, regex, replacement, out_path, events_path, mode, literal=literal)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, out_path: str, schema) -> DataFrame:
    """All rows of the batches written so far, each batch whole or not at all."""
    root = out_path.rstrip("/")
    folders = sorted({f.rsplit("/batch-", 1)[1].split("/")[0] for f in files_in(spark, root, nested=True)})
    found = [p for n in folders if (p := find_result(spark, batch_folder(root, int(n))))]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
