"""Runs as they go: a table of events, folded to the state of each run.

Whoever works on a run appends an event when something changes: it was queued, began, got further, was
cancelled, ended. Events may be appended in any order, by several writers, and more than once; a fold
over them says how each run stands. It is one aggregate with map-side combine, so that neither a run of
very many events nor many runs are gathered anywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.operators import versions
from maskwright.operators.ledger import MAX_ERROR, RUN_SCHEMA, is_terminal
from maskwright.operators.shared import new_table_path, release

# The states of a run, and the progress of one that has not ended.
QUEUED, RUNNING, SUCCESS, FAILED, CANCELLED = "QUEUED", "RUNNING", "SUCCESS", "FAILED", "CANCELLED"
STATES = (QUEUED, RUNNING, SUCCESS, FAILED, CANCELLED)
MOST_PROGRESS = 99
#: Slices of a large table at most: each reads the whole table.
MOST_SLICES = 8

#: The fields an event may set; those that the fold works out itself are left out.
_TIMES = ("created_at", "updated_at", "started_at", "completed_at")
_FIELDS = [f for f in RUN_SCHEMA if f.name not in ("id", "status", *_TIMES)]
#: An event: the run, when it happened, a name of its own, and what it sets. ``quarantined_rows`` are the
#: rows of the input that could not be read.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("event_at", T.TimestampType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("status", T.StringType()),
        *_FIELDS,
        T.StructField("quarantined_rows", T.LongType()),
    ]
)


def as_events(df: DataFrame) -> DataFrame:
    """Rows in the events' shape; a missing field is NULL, a long error is cut. An event without a name
    is named by its content, so that one appended twice is one."""
    present = set(df.columns)
    fields = {f.name: (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType) for f in EVENT_SCHEMA}
    fields["error_message"] = F.left(fields["error_message"], F.lit(MAX_ERROR))
    content = F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items() if n != "event_id"))), 256)
    fields["event_id"] = F.coalesce(fields["event_id"], content)
    return df.select(*(c.alias(n) for n, c in fields.items()))


def append_events(df: DataFrame, path: str) -> None:
    versions.append(as_events(df), path)


def record_events(spark: SparkSession, events: Iterable[Mapping], path: str) -> None:
    """Append events made on the driver, one or a few. They are named and timed here unless they say
    otherwise."""
    rows = []
    for event in events:
        known = {"event_id": uuid.uuid4().hex, "event_at": datetime.now(timezone.utc), **event}
        rows.append(tuple(known.get(name) for name in EVENT_SCHEMA.names))
    append_events(spark.createDataFrame(rows, EVENT_SCHEMA), path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path, EVENT_SCHEMA)


def _digest(name: Column) -> Column:
    """A name by content, 64 lower-case hex digits, as the 32 bytes they spell; NULL for other names."""
    digest = F.unhex(name)
    return F.when((F.length(name) == 64) & (F.lower(F.hex(digest)) == name), digest)


def _place(name: Column) -> tuple[Column, Column]:
    """Two columns that order as names do, and are short for names by content: those are their bytes, and
    NULL. Another name is the bytes of the last name by content before it, none if there is no such, and
    itself."""
    digits = F.regexp_extract(name, "^[0-9a-f]{0,64}", 0)
    after = F.substring(name, F.length(digits) + 1, F.lit(1))
    # Before digits that end, or go on with less than a digit, come those that are less by one.
    nonzero, head = F.regexp_extract(digits, "([1-9a-f])0*$", 1), F.regexp_extract(digits, "^(.*)[1-9a-f]0*$", 1)
    less = F.concat(head, F.translate(nonzero, "123456789abcdef", "0123456789abcde"))
    below = F.when(F.length(digits) == 64, digits).when(after > "f", F.concat(digits, F.lit("f"))).when(after > "9", F.concat(digits, F.lit("9")))
    below = F.coalesce(below, F.when(nonzero != "", less))
    digest, known = _digest(name), name.isNotNull()
    return F.coalesce(digest, F.when(known, F.unhex(F.coalesce(F.rpad(below, 64, "f"), F.lit(""))))), F.when(digest.isNull(), name)


def each_once(events: DataFrame) -> DataFrame:
    """An event appended twice becomes one. Names by content are most of an event's bytes, and no shuffle
    file compresses hex digits, so these go as the bytes they spell."""
    name, digest = F.col("event_id"), F.col("__digest")
    others = [c for c in events.columns if c not in ("id", "event_id")]
    packed = events.withColumn("__digest", _digest(name)).withColumn("event_id", F.when(digest.isNull(), name))
    once = packed.groupBy("id", "__digest", "event_id").agg(F.first(F.struct(*others)).alias("__rest"))
    whole = once.withColumn("event_id", F.coalesce(F.lower(F.hex(digest)), name))
    return whole.select(*(F.col(f"__rest.{c}").alias(c) if c in others else c for c in events.columns))


def merge_events(spark: SparkSession, path: str, buckets: int = versions.BUCKETS) -> versions.Version:
    """Fold the files of single events into few, sorted by run; an event appended twice becomes one. What
    is appended meanwhile stays to be read."""
    return versions.merge_table(spark, path, EVENT_SCHEMA, "id", each_once, buckets)


def run_states(events: DataFrame) -> DataFrame:
    """One row per run, in the ledger's columns and with ``quarantined_rows``.

    Events count by their time, ties by their name. A run stands where its first ending left it: once it
    has succeeded, failed or been cancelled, later events change nothing. Before, it stands where the
    newest event says; one that begins but says QUEUED of an older time doesn't go back. Progress is the
    newest given up to the end, at most 99 before success and 100 from then on. Other fields have their
    newest value that isn't NULL, of events up to the end. ``created_at`` is the time of the first
    event, ``started_at`` that of the first RUNNING one, ``completed_at`` that of the end, ``updated_at``
    that of the last event that counts. Events without a run or a known state are left out.
    """
    order = F.struct("event_at", "__place", "__name")
    events = events.where(F.col("id").isNotNull() & F.col("status").isin(*STATES) & F.col("event_at").isNotNull())
    place, name = _place(F.col("event_id"))
    events = events.withColumns({"__place": place, "__name": name})
    # The end is known per run before other events are folded: few columns of the endings alone, combined
    # before the shuffle. A run that goes on has none.
    ends = events.where(is_terminal(F.col("status"))).groupBy(F.col("id").alias("__id")).agg(F.min(order).alias("__end"))
    # The second condition, implied by the first, has the ends shuffled once more, so that the adaptive
    # skew join can split a run of very many events.
    same = (F.col("id") == F.col("__id")) & (F.xxhash64("id") == F.xxhash64("__id"))
    counted = events.join(ends, same, "left").where(F.col("__end").isNull() | (order <= F.col("__end")))

    def newest(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), order))

    status, last = newest(F.col("status")), F.max("event_at")
    folded = counted.groupBy("id").agg(
        status.alias("status"),
        *(newest(F.col(f.name)).alias(f.name) for f in _FIELDS),
        newest(F.col("quarantined_rows")).alias("quarantined_rows"),
        F.min("event_at").alias("created_at"),
        last.alias("updated_at"),
        F.min(F.when(F.col("status") == RUNNING, F.col("event_at"))).alias("started_at"),
        F.max(F.when(is_terminal(F.col("status")), F.col("event_at"))).alias("completed_at"),
    )
    progress = F.greatest(F.lit(0), F.least(F.lit(MOST_PROGRESS), F.coalesce("progress", F.lit(0))))
    folded = folded.withColumn("progress", F.when(F.col("status") == SUCCESS, 100).otherwise(progress).cast("short"))
    return folded.select(*RUN_SCHEMA.names, "quarantined_rows")


def all_states(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``run_states`` of a whole table, or some ``columns`` of them. A large table is folded in slices by
    run, one after the other into a new table in the shared folder, so that the shuffle files of one slice
    are there at a time. All are of the same events, whatever is appended meanwhile."""
    events = read_events(spark, path)
    columns = columns or [*RUN_SCHEMA.names, "quarantined_rows"]
    slices = versions.slices_for(spark, path, MOST_SLICES)
    if slices == 1:
        return run_states(events).select(*columns)
    kept, slice_of = new_table_path(spark, "states"), versions.bucket_of(F.col("id"), slices)
    for number in range(slices):
        states = run_states(events.where(slice_of == number)).select(*columns)
        states.write.mode("append").option("compression", versions.COMPRESSION).parquet(kept)
        release(spark)
    return spark.read.schema(states.schema).parquet(kept)


def state_of(spark: SparkSession, path: str, run_id: str) -> str | None:
    """How one run stands; None if nothing is known of it. The id reaches the Parquet scan."""
    row = run_states(read_events(spark, path).where(F.col("id") == run_id)).select("status").first()
    return row.status if row else None


def cancellations(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Each request ``id, event_at`` with ``found`` (the run's state, NULL if there is no such run) and
    ``accepted``: runs that have ended can't be cancelled."""
    known = states.select(F.col("id").alias("__id"), F.col("status").alias("found"))
    joined = requests.join(known, F.col("id") == F.col("__id"), "left").drop("__id")
    return joined.withColumn("accepted", F.col("found").isNotNull() & ~is_terminal(F.coalesce("found", F.lit(""))))


def request_cancel(requests: DataFrame, path: str) -> DataFrame:
    """Append a cancel event for each request ``id, event_at`` that can be accepted; returns what became
    of the requests. A run asked for more than once is cancelled once, by the first."""
    spark = requests.sparkSession
    asked = requests.groupBy("id").agg(F.min("event_at").alias("event_at"))
    # Judged and written from one reading of the states, though the table grows by the writing.
    kept = new_table_path(spark, "cancellations")
    cancellations(asked, all_states(spark, path, ["id", "status"])).write.parquet(kept)
    judged = spark.read.parquet(kept)
    append_events(judged.where("accepted").select("id", "event_at", F.lit(CANCELLED).alias("status")), path)
    return judged


def cancel_run(spark: SparkSession, path: str, run_id: str) -> dict:
    """Cancel one run: ``{found, accepted}``."""
    found = state_of(spark, path, run_id)
    accepted = found is not None and found not in (SUCCESS, FAILED, CANCELLED)
    if accepted:
        record_events(spark, [{"id": run_id, "status": CANCELLED}], path)
    return {"found": found, "accepted": accepted}


def queue_runs(spark: SparkSession, runs: Sequence[Mapping], path: str) -> list[str]:
    """Queue runs given by their fields; returns their ids."""
    ids = [run.get("id") or str(uuid.uuid4()) for run in runs]
    names = {f.name for f in _FIELDS}
    kept = [{k: v for k, v in run.items() if k in names} for run in runs]
    record_events(spark, [{**run, "id": i, "status": QUEUED, "progress": 0} for i, run in zip(ids, kept, strict=True)], path)
    return ids
