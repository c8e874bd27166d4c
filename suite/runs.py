"""Runs as they go, tables merged beside their writers, rows set aside, recorded streams."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from maskwright.operators import catalog as C
from maskwright.operators import paging as G
from maskwright.operators import run_events as E
from maskwright.operators import versions as V
from maskwright.operators.folders import files_in
from maskwright.operators.ledger import STATUS_COLUMNS
from maskwright.plans.transform_job import run_transform
from maskwright.sinks.files import write_csv
from maskwright.sources.tables import input_files, partitions_for, quarantine_csv
from maskwright.streaming.rewrite_stream import read_batches, recorded_batches, start_recorded_rewrite
from suite.base import Query, lit, table, work_path
from suite.catalog import _CATALOG_SQL, NOW, TTL, event_catalog, event_prompts
from suite.rewriting import EMAIL

# --- run events ------------------------------------------------------------------


def _events(spark, folder):
    """Each order as a run: queued at midnight of its day, begun an hour later, with a pattern after
    two; ended after three by its status (those still open go on), but one in seven cancelled before.
    A late worker says later that it is at 30."""
    order, status, cust = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_custkey")
    orders = table(spark, folder, "orders").select(
        F.concat(F.lit("run-"), order).alias("id"), F.col("o_orderdate").cast("date").cast("timestamp").alias("day"), status.alias("s"), cust.alias("c")
    )

    def event(minutes, state, **fields):
        at = F.col("day") + F.make_dt_interval(mins=F.lit(minutes))
        return E.as_events(orders.select("id", at.alias("event_at"), state.alias("status"), *(v.alias(n) for n, v in fields.items()), "s", "c"))

    ending = F.when(F.col("s") == "F", E.SUCCESS).when(F.col("s") == "P", E.FAILED)
    ended = event(
        180, ending, progress=F.when(F.col("s") == "F", 100), row_count=F.when(F.col("s") == "F", F.col("c") * 10),
        error_message=F.when(F.col("s") == "P", "broke"),
    ).where("status IS NOT NULL")
    cancelled = event(150, F.when(F.col("c") % 7 == 0, E.CANCELLED)).where("status IS NOT NULL")
    queued = event(0, F.lit(E.QUEUED), progress=F.lit(0), prompt=F.lit("Find"), normalize_mode=F.lit("none"))
    begun = event(60, F.lit(E.RUNNING), progress=F.lit(10))
    further = event(120, F.lit(E.RUNNING), progress=F.lit(20), generated_regex=F.lit("[0-9]+"))
    late = event(240, F.when(F.col("s") != "O", E.RUNNING), progress=F.lit(30)).where("status IS NOT NULL")
    return queued, begun, further, cancelled, ended, late


def _clock(df):
    """Times as text, so that both sides print them alike."""
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm") for n in df.columns if n.endswith("_at")})


def run_states(spark, folder):
    """Events appended out of order and some twice, merged between two appends."""
    path = work_path(spark, "events")
    queued, begun, further, cancelled, ended, late = _events(spark, folder)
    E.append_events(late.unionByName(ended), path)
    E.append_events(further, path)
    E.merge_events(spark, path, buckets=4)
    E.append_events(queued.unionByName(further), path)
    E.append_events(cancelled.unionByName(begun).unionByName(ended), path)
    return _clock(E.all_states(spark, path, STATUS_COLUMNS))


_CANCELLED = "o_custkey % 7 = 0"
_STATE = f"CASE WHEN {_CANCELLED} THEN 'CANCELLED' WHEN o_orderstatus = 'F' THEN 'SUCCESS' WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'RUNNING' END"


def _at(minutes):
    return f"strftime(date_trunc('day', o_orderdate) + INTERVAL {minutes} MINUTE, '%Y-%m-%d %H:%M')"


_STATES_SQL = f"""
SELECT 'run-' || o_orderkey::VARCHAR AS id, {_STATE} AS status, CASE WHEN {_STATE} = 'SUCCESS' THEN 100 ELSE 20 END AS progress,
  'none' AS normalize_mode, '[0-9]+' AS generated_regex, CASE WHEN {_STATE} = 'SUCCESS' THEN o_custkey * 10 END AS row_count,
  CASE WHEN {_STATE} = 'FAILED' THEN 'broke' END AS error_message, {_at(0)} AS created_at,
  CASE {_STATE} WHEN 'CANCELLED' THEN {_at(150)} WHEN 'RUNNING' THEN {_at(120)} ELSE {_at(180)} END AS updated_at, {_at(60)} AS started_at,
  CASE {_STATE} WHEN 'CANCELLED' THEN {_at(150)} WHEN 'RUNNING' THEN NULL ELSE {_at(180)} END AS completed_at
FROM orders
"""


def run_cancelled(spark, folder):
    """Every third customer's runs are asked to be cancelled, and some that do not exist: what became of
    the requests, and how the runs stand then, after a worker that hadn't noticed says it succeeded."""
    path = work_path(spark, "events")
    queued, begun, further, cancelled, ended, _ = _events(spark, folder)
    for part in (begun, cancelled.unionByName(ended), queued):
        E.append_events(part, path)
    orders = table(spark, folder, "orders").where("o_custkey % 3 = 0")
    at = F.lit(datetime(2030, 1, 1, tzinfo=timezone.utc)).alias("event_at")
    asked = orders.select(F.explode(F.array(F.lit("run-"), F.lit("none-"))).alias("kind"), "o_orderkey").select(
        F.concat("kind", F.col("o_orderkey").cast("string")).alias("id"), at
    )
    became = E.request_cancel(asked, path)
    unaware = became.where("accepted").select("id", F.lit(datetime(2030, 1, 2, tzinfo=timezone.utc)).alias("event_at"), F.lit(E.SUCCESS).alias("status"))
    E.append_events(unaware, path)
    states = E.all_states(spark, path, ["id", "status", "progress"]).withColumnRenamed("id", "__id")
    return became.select("id", "found", "accepted").join(states, F.col("id") == F.col("__id"), "left").drop("__id")


_CANCEL_SQL = f"""
SELECT 'run-' || o_orderkey::VARCHAR AS id, {_STATE} AS found, {_STATE} = 'RUNNING' AS accepted,
  CASE WHEN {_STATE} = 'RUNNING' THEN 'CANCELLED' ELSE {_STATE} END AS status, CASE WHEN {_STATE} = 'SUCCESS' THEN 100 ELSE 10 END AS progress
FROM orders WHERE o_custkey % 3 = 0
UNION ALL SELECT 'none-' || o_orderkey::VARCHAR, NULL, false, NULL, NULL FROM orders WHERE o_custkey % 3 = 0
"""


def merge_beside_writers(spark, folder):
    """Events appended after a merge has read and before it is published, and after that."""
    path = work_path(spark, "events")
    queued, begun, further, cancelled, ended, _ = _events(spark, folder)
    E.append_events(queued.repartition(7), path)
    E.append_events(begun, path)
    draft = V.draft_merge(spark, path, E.EVENT_SCHEMA, "id", E.each_once, 4)
    E.append_events(further, path)
    before = E.read_events(spark, path).count()
    V.publish(spark, draft)
    after = E.read_events(spark, path).count()
    E.merge_events(spark, path)
    E.append_events(cancelled.unionByName(ended), path)
    E.merge_events(spark, path)
    gone = V.clear_away(spark, path, keep=0)
    events = E.read_events(spark, path).groupBy("id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") == E.RUNNING).alias("running"))
    return events.withColumns({"none_lost": F.lit(before == after), "cleared": F.lit(len(gone) > 7)})


_BESIDE_SQL = f"""
SELECT 'run-' || o_orderkey::VARCHAR AS id, 3 + (CASE WHEN {_CANCELLED} THEN 1 ELSE 0 END) + (CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END) AS events,
  2 AS running, true AS none_lost, true AS cleared FROM orders
"""

# --- catalogue -------------------------------------------------------------------


def catalog_merge(spark, folder):
    """Entries appended by day of the month, merged three times; lookups read the snapshot and what was
    appended since. Each merge rewrites only the buckets that new keys fall into."""
    path = work_path(spark, "catalog")
    entries, day = event_catalog(spark, folder), F.dayofmonth("created_at")
    C.append_entries(entries.where(day > 20), path)
    C.merge_catalog(spark, path, buckets=8)
    C.append_entries(entries.where(day <= 10), path)
    C.merge_catalog(spark, path)
    middle = entries.where((day > 10) & (day <= 20)).withColumn("bucket", V.bucket_of(F.col("key"), 8))
    one = middle.agg(F.min("bucket")).first()[0]
    C.append_entries(middle.where(F.col("bucket") == one), path)
    others = {f for f in V.current(spark, path).files if f"/__bucket={one}/" not in f}
    C.merge_catalog(spark, path)
    kept = others == {f for f in V.current(spark, path).files if f"/__bucket={one}/" not in f}
    C.append_entries(entries.where((day > 10) & (day <= 20)), path)
    catalog = C.read_catalog(spark, path)
    newest = C.newest_per_key(catalog).select("key", "kind", "value", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    hits = C.look_up(event_prompts(spark, folder), catalog, NOW, TTL).groupBy("key").agg(F.max("cached").alias("cached"), F.count(F.lit(1)).alias("prompts"))
    return newest.join(hits, "key", "left").withColumn("others_kept", F.lit(kept))


_MERGE_SQL = f"""
SELECT e.key, e.kind, e.value, strftime(e.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, prompts, cached, true AS others_kept
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, value DESC) AS place FROM ({_CATALOG_SQL})) e
LEFT JOIN (SELECT p.key, count(*) AS prompts, any_value(l.value) AS cached FROM (
    SELECT 'regex_cache:' || sha256('user ' || (user_id * 2)::VARCHAR) AS key FROM events) p
  LEFT JOIN (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, value DESC) AS place
      FROM ({_CATALOG_SQL}) WHERE created_at > TIMESTAMP '2024-01-11 00:00:00') WHERE place = 1 AND value <> '') l USING (key)
  GROUP BY p.key) h ON h.key = e.key
WHERE e.place = 1
"""

# --- offsets ---------------------------------------------------------------------


def page_appended(spark, folder):
    """A dataset that grows: its index is extended by the new files alone, rows keep their numbers, and a
    page spans the border between what was there and what came."""
    path, index = work_path(spark, "grown"), work_path(spark, "index")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    middle = orders.count() // 2
    half = orders.orderBy("o_orderkey").limit(middle).agg(F.max("o_orderkey")).first()[0]
    G.in_order(orders.where(F.col("o_orderkey") <= half), ["o_orderkey"]).write.parquet(path)
    first = {r.file_path: r.first_row for r in G.extend_offsets(spark, path, index).collect()}
    G.in_order(orders.where(F.col("o_orderkey") > half), ["o_orderkey"]).write.mode("append").parquet(path)
    offsets = G.extend_offsets(spark, path, index)
    kept = all(r.first_row == first.get(r.file_path, r.first_row) for r in offsets.collect())
    G.merge_offsets(spark, index)
    offsets = G.extend_offsets(spark, path, index)
    page = G.stored_page(spark, path, middle // 300 + 1, 300, offsets=offsets)
    numbered = G.with_row_ids(spark, path, "number", offsets=offsets)
    whole = numbered.join(page.select("o_orderkey", "row_id"), "o_orderkey", "left")
    return whole.withColumn("kept", F.lit(kept))


_APPENDED_SQL = """
SELECT o_orderkey, number, o_custkey, CASE WHEN number // 300 = total // 2 // 300 THEN number END AS row_id, true AS kept
FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS number, count(*) OVER () AS total FROM orders)
"""

# --- rows set aside ----------------------------------------------------------------

_ORDER = "o_orderkey bigint, o_custkey int, o_totalprice double, o_orderdate date"


def _odd_orders(spark, folder):
    """Orders as CSV lines, of which some have a cell too many, one too few, or a word for a number."""
    orders = table(spark, folder, "orders")
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    cells = F.concat_ws(",", key, F.col("o_custkey").cast("string"), F.lit("12.5"), day)
    kind = F.col("o_orderkey") % 11
    line = F.when(kind == 1, F.concat(cells, F.lit(",more"))).when(kind == 2, F.concat_ws(",", key, F.lit("7")))
    line = line.when(kind == 3, F.concat_ws(",", key, F.lit("seven"), F.lit("12.5"), day)).when(kind == 4, F.concat_ws(",", key, F.lit(""), F.lit("12.5"), F.lit("2024-02-30")))
    line = line.when(kind == 5, F.concat_ws(",", key, F.lit(""), F.lit("12.5"), day)).otherwise(cells)
    path = work_path(spark, "odd") + ".csv"
    lines = orders.select(F.lit(1).alias("at"), line.alias("value")).repartition(3)
    with_header = lines.select("value").mapInArrow(_headed, "value string")
    with_header.write.text(path)
    return path


def _headed(batches):
    """The header in front of each file's lines."""
    import pyarrow as pa

    yield pa.RecordBatch.from_arrays([pa.array(["o_orderkey,o_custkey,o_totalprice,o_orderdate"])], names=["value"])
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])


def csv_quarantine(spark, folder):
    """What fits and what does not, each as it stands; a job over the same files, and what it set aside."""
    path, aside = _odd_orders(spark, folder), work_path(spark, "aside")
    good, bad = quarantine_csv(spark, path, _ORDER, multi_line=False)
    rows = good.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.lit(None).cast("string").alias("row_text"))
    set_aside = bad.select(
        F.split_part("row_text", F.lit(","), F.lit(1)).cast("bigint").alias("o_orderkey"), F.lit(None).cast("int").alias("o_custkey"),
        F.lit(None).cast("string").alias("o_orderdate"), "row_text",
    )
    result = run_transform(
        spark, path, "o_custkey", "^[0-9]", "#", work_path(spark, "job"), schema=_ORDER, multi_line=False, quarantine_path=aside
    )
    counts = {"written": F.lit(result["row_count"]), "aside": F.lit(spark.read.parquet(aside).count()), "told": F.lit(result["quarantined_rows"])}
    return rows.unionByName(set_aside).withColumns(counts)


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_CSV_SQL = f"""
WITH line AS (
  SELECT o_orderkey, o_orderkey % 11 AS kind, o_custkey::VARCHAR AS cust, {_DAY} AS day FROM orders
), cut AS (
  SELECT o_orderkey, kind IN (1, 2, 3, 4) AS odd, CASE WHEN kind = 5 THEN NULL ELSE cust::INT END AS cust, day,
    CASE kind WHEN 1 THEN o_orderkey || ',' || cust || ',12.5,' || day || ',more' WHEN 2 THEN o_orderkey || ',7'
      WHEN 3 THEN o_orderkey || ',seven,12.5,' || day WHEN 4 THEN o_orderkey || ',,12.5,2024-02-30' END AS row_text
  FROM line
)
SELECT o_orderkey, CASE WHEN NOT odd THEN cust END AS o_custkey, CASE WHEN NOT odd THEN day END AS o_orderdate, row_text,
  (SELECT count(*) FROM cut WHERE NOT odd) AS written, (SELECT count(*) FROM cut WHERE odd) AS aside, (SELECT count(*) FROM cut WHERE odd) AS told
FROM cut
"""

# --- recorded streams ----------------------------------------------------------------


# Bytes of the documents, as they are stored, for each file of a batch.
BATCH_FILE_BYTES = 32 * 1024 * 1024


def stream_recorded(spark, folder):
    """Documents in three batches, of a file each or as many more as there is to read; then all batches are
    given once more, as after a crash, and one fails halfway. Each row and each record is there once."""
    source, out, events = work_path(spark, "source"), work_path(spark, "stream"), work_path(spark, "events")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    size = input_files(spark, f"{folder}/documents.parquet").agg(F.sum("length")).first()[0]
    docs.repartition(3 * partitions_for(size, BATCH_FILE_BYTES), "doc_id").write.parquet(source)
    files = -(-len(files_in(spark, source)) // 3)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(source)
    for checkpoint in (work_path(spark, "progress"), work_path(spark, "progress")):
        start_recorded_rewrite(stream, "mails", "text", EMAIL, "[REDACTED]", out, checkpoint, events).awaitTermination()
    try:
        failing = F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("no such luck")).cast("string"))
        recorded_batches("mails", "text", EMAIL, "", out, events)(docs.withColumn("text", failing), 0)
    except Exception:  # noqa: BLE001  the batch before it stays
        pass
    states = E.run_states(E.read_events(spark, events))
    told = states.agg(F.count_if(F.col("status") == E.SUCCESS).alias("records"), F.sum("row_count").alias("rows_told")).first()
    return read_batches(spark, out, docs.schema).withColumns({n: F.lit(v) for n, v in told.asDict().items()})


QUERIES = {
    "run_states": Query(run_states, _STATES_SQL),
    "run_cancelled": Query(run_cancelled, _CANCEL_SQL),
    "merge_beside_writers": Query(merge_beside_writers, _BESIDE_SQL),
    "catalog_merge": Query(catalog_merge, _MERGE_SQL),
    "page_appended": Query(page_appended, _APPENDED_SQL),
    "csv_quarantine": Query(csv_quarantine, _CSV_SQL),
    "stream_recorded": Query(
        stream_recorded,
        f"SELECT doc_id, regexp_replace(text, {lit(EMAIL)}, '[REDACTED]', 'g') AS text, 3 AS records,"
        " (SELECT count(*) FROM documents) AS rows_told FROM documents",
    ),
}
