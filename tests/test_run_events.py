import random
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from maskwright.operators import run_events as E
from maskwright.operators.ledger import RUN_SCHEMA, list_runs

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def event(run, minute, status, **fields):
    return {"id": run, "event_at": T0 + timedelta(minutes=minute), "status": status, **fields}


def fold(spark, events):
    names = E.EVENT_SCHEMA.names
    rows = [tuple({"event_id": f"e{i}", **e}.get(n) for n in names) for i, e in enumerate(events)]
    return {r.id: r for r in E.run_states(spark.createDataFrame(rows, E.EVENT_SCHEMA).repartition(3)).collect()}


def test_states_fold_whatever_the_order(spark):
    events = [
        event("a", 9, "SUCCESS", row_count=5, progress=100), event("a", 0, "QUEUED", prompt="p"), event("a", 1, "RUNNING", progress=10),
        event("a", 5, "RUNNING", progress=60, generated_regex="x"), event("a", 10, "RUNNING", progress=70), event("a", 11, "CANCELLED"),
        event("b", 2, "RUNNING", progress=130), event("b", 0, "QUEUED"), event("c", 3, "CANCELLED"), event("c", 4, "SUCCESS", row_count=1),
        event("d", 1, "FAILED", error_message="broke", progress=20), event("e", 0, "QUEUED"), event(None, 0, "QUEUED"), event("f", 0, "WAITING"),
        event("g", None or 0, "RUNNING", progress=-4),
    ]
    got = fold(spark, events)
    assert {k: (r.status, r.progress) for k, r in got.items()} == {
        "a": ("SUCCESS", 100), "b": ("RUNNING", 99), "c": ("CANCELLED", 0), "d": ("FAILED", 20), "e": ("QUEUED", 0), "g": ("RUNNING", 0),
    }
    a = got["a"]
    assert (a.row_count, a.prompt, a.generated_regex) == (5, "p", "x") and got["c"].row_count is None
    naive = [t.replace(tzinfo=None) for t in (T0, T0 + timedelta(minutes=1), T0 + timedelta(minutes=9))]
    assert [a.created_at, a.started_at, a.completed_at] == naive and a.updated_at == naive[2]
    assert got["b"].completed_at is None
    assert fold(spark, events[::-1]) .keys() == got.keys()


def test_events_are_named_cut_and_merged(spark, tmp_path):
    path = str(tmp_path / "events")
    E.record_events(spark, [event("a", 0, "QUEUED")], path)
    late = spark.createDataFrame([("a", T0 + timedelta(minutes=3), "FAILED", "x" * 3000)], "id string, event_at timestamp, status string, error_message string")
    E.append_events(late, path)
    E.append_events(late, path)
    assert E.read_events(spark, path).count() == 3
    E.merge_events(spark, path)
    assert E.read_events(spark, path).count() == 2
    states = E.run_states(E.read_events(spark, path))
    assert len(states.first().error_message) == 2000 and states.columns == [*RUN_SCHEMA.names, "quarantined_rows"]
    assert [r.status for r in list_runs(states).collect()] == ["FAILED"]
    assert E.run_states(E.read_events(spark, str(tmp_path / "none"))).count() == 0


def test_cancelling(spark, tmp_path):
    path = str(tmp_path / "events")
    ids = E.queue_runs(spark, [{"id": "a", "prompt": "p"}, {"prompt": "q"}], path)
    assert ids[0] == "a" and E.state_of(spark, path, ids[1]) == "QUEUED" and E.state_of(spark, path, "z") is None
    assert E.cancel_run(spark, path, "a") == {"found": "QUEUED", "accepted": True}
    assert E.cancel_run(spark, path, "a") == {"found": "CANCELLED", "accepted": False}
    assert E.cancel_run(spark, path, "z") == {"found": None, "accepted": False}
    asked = spark.createDataFrame([(i,) for i in ("a", ids[1], ids[1], "z", None)], "id string").withColumn("event_at", F.current_timestamp())
    got = {(r.id, r.found, r.accepted) for r in E.request_cancel(asked, path).collect()}
    assert got == {("a", "CANCELLED", False), (ids[1], "QUEUED", True), ("z", None, False), (None, None, False)}
    assert E.state_of(spark, path, ids[1]) == "CANCELLED"


def test_a_run_of_very_many_events(spark):
    events = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id").cast("string"))).alias("id"),
        F.timestamp_seconds(F.col("id")).alias("event_at"), F.lit("RUNNING").alias("status"), (F.col("id") % 90).cast("int").alias("progress"),
    )
    got = E.run_states(E.as_events(events))
    assert got.count() == 20_000 - 6667 + 1
    assert got.where("id = 'hot'").first().progress == 19_998 % 90


def test_only_endings_are_looked_at_for_the_end(spark):
    rows = [event("a", 0, "RUNNING"), event("a", 2, "SUCCESS"), event("a", 3, "RUNNING", progress=7), event("b", 1, "RUNNING", progress=5)]
    got = fold(spark, rows)
    assert {i: (r.status, r.progress) for i, r in got.items()} == {"a": ("SUCCESS", 100), "b": ("RUNNING", 5)}
    states = E.run_states(spark.createDataFrame([], E.EVENT_SCHEMA))
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan


def test_batches_grow_with_the_documents(spark, tmp_path, monkeypatch):
    from maskwright.operators.folders import files_in
    from maskwright.operators.shared import shared_folder
    from suite import runs

    docs = spark.range(0, 600, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("to a@b.org "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(runs, "BATCH_FILE_BYTES", 8_000)
    made = []
    monkeypatch.setattr(runs, "work_path", lambda s, stem: made.append(f"{shared_folder(s)}/grown-{stem}-{len(made)}") or made[-1])
    rows = runs.stream_recorded(spark, str(tmp_path)).collect()
    assert len(rows) == 600 and {(r.records, r.rows_told) for r in rows} == {(3, 600)}
    assert len(files_in(spark, made[0])) >= 6


def test_an_event_named_in_any_way_is_kept_once(spark, monkeypatch):
    """Names by content are shuffled as the bytes they spell; others, and those like them, as they are."""
    digest = "0a" * 32
    names = [digest, digest.upper(), digest[:-1], digest + "0", "g" * 64, "", "e1", None, "0b" * 32]
    rows = [tuple({**event("a", 1, "RUNNING"), "event_id": n}.get(c) for c in E.EVENT_SCHEMA.names) for n in names * 2]
    once = E.each_once(spark.createDataFrame(rows, E.EVENT_SCHEMA).repartition(3))
    assert once.schema == E.EVENT_SCHEMA
    assert sorted(r.event_id or "" for r in once.collect()) == sorted(n or "" for n in names)
    assert {r.status for r in once.collect()} == {"RUNNING"}
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "__digest" in plan.split("hashpartitioning(id")[1].split("\n")[0]


def test_names_order_as_text_does_when_they_are_packed(spark):
    """A tie in time goes by the whole name, whichever of the names are by content."""
    rnd = random.Random(3)
    digests = ["".join(rnd.choices("0123456789abcdef", k=64)) for _ in range(40)] + ["0" * 64, "f" * 64, "0" * 63 + "1", "9" + "f" * 63]
    ends = ["", "-", "/", ":", "G", "`", "g", "\u00e9", "\n", "0", "9", "a", "f", "A", "00-", "0" * 64]
    names = {"", *digests, *(d[:n] + rnd.choice(ends) for d in digests for n in (0, 1, 2, 31, 62, 63, 64))}
    place, name = E._place(F.col("n"))
    rows = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string").select("n", place.alias("place"), name.alias("name"))
    got = [r.n for r in rows.orderBy(F.struct("place", "name")).collect()]
    assert got == [None, *sorted(names, key=str.encode)]
    assert rows.where("name IS NULL AND n IS NOT NULL").count() == len({n for n in names if re.fullmatch("[0-9a-f]{64}", n)})


def test_large_tables_are_folded_in_slices(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "events")
    runs = [f"r{i}" for i in range(40)]
    E.record_events(spark, [event(r, 0, "QUEUED", prompt=r) for r in runs] + [event(None, 0, "QUEUED")], path)
    ends = [event(r, 5, "SUCCESS", row_count=i, event_id="ab" * 32) for i, r in enumerate(runs) if i % 3]
    E.record_events(spark, ends + [{**e, "status": "FAILED", "event_id": "b"} for e in ends], path)
    E.merge_events(spark, path, 2)
    E.record_events(spark, [event(r, 9, "RUNNING", progress=7) for r in runs], path)
    want = sorted(E.run_states(E.read_events(spark, path)).collect(), key=lambda r: r.id)
    assert len(want) == 40 and want[1].status == "SUCCESS"
    assert sorted(E.all_states(spark, path).collect(), key=lambda r: r.id) == want
    calls, fold = [], E.run_states
    monkeypatch.setattr(E, "run_states", lambda events: calls.append(1) or fold(events))
    monkeypatch.setattr(E.versions, "SLICE_BYTES", 1)
    assert sorted(E.all_states(spark, path).collect(), key=lambda r: r.id) == want and len(calls) == E.MOST_SLICES
    some = E.all_states(spark, path, ["id", "status"])
    assert some.columns == ["id", "status"] and sorted(map(tuple, some.collect())) == [(r.id, r.status) for r in want]
    assert E.all_states(spark, str(tmp_path / "none")).count() == 0
