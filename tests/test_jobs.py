import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from plan_text import ROOT, plan_of
from maskwright.operators import run_events as E
from maskwright.operators.ledger import read_ledger
from maskwright.operators.paging import stored_page
from maskwright.plans import transform_job as J
from maskwright.sinks.files import write_csv
from maskwright.sinks.files import find_result
from maskwright.streaming.rewrite_stream import read_batches, recorded_batches, start_rewrite

PEOPLE = """id,name,email,notes
1,Ada Byron,ada.byron@gmail.com,Write to ada.byron@gmail.com
2,Max Born,max@yahoo.com,max@yahoo.com answers
3,Lise Meitner,lise.m@gmail.com,"see lise.m@gmail.com, or max@yahoo.com"
"""


@pytest.fixture
def people(tmp_path):
    path = tmp_path / "people.csv"
    path.write_text(PEOPLE)
    return str(path)


def test_redaction_job(spark, people, tmp_path):
    out = str(tmp_path / "out")
    result = J.run_transform(spark, people, "notes", r"[a-z.]+@gmail\.com", "[REDACTED]", out)
    assert result == {"result_path": out + "/output.parquet", "row_count": 3}
    df = spark.read.parquet(result["result_path"])
    assert df.columns == ["id", "name", "email", "notes"]
    assert [r.notes for r in df.orderBy("id").collect()] == [
        "Write to [REDACTED]", "max@yahoo.com answers", "see [REDACTED], or max@yahoo.com",
    ]


def test_standardising_job_on_contacts(spark, tmp_path):
    path = str(tmp_path / "contacts.csv")
    phone = F.format_string("(%03d) 555-%04d", F.col("id") % 700 + 201, F.col("id"))
    write_csv(spark.range(1, 2001, 1, 4).select("id", phone.alias("phone")), path)
    result = J.run_transform(spark, path, "phone", r"\d{3}", "", str(tmp_path / "o"), "e164", order_by=["id"])
    df = spark.read.parquet(result["result_path"])
    assert result["row_count"] == 2000 == df.where(F.col("phone").rlike(r"^\+1[0-9]{10}$")).count()
    assert [r.id for r in stored_page(spark, result["result_path"], 3, 300).collect()] == list(range(601, 901))


def test_a_sorted_job_rewrites_each_cell_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(df, column, *args, **kwargs):
        def count(rows):
            for row in rows:
                seen.add(1)
                yield row

        return spark.createDataFrame(df.rdd.mapPartitions(count), df.schema)

    monkeypatch.setattr(J, "rewrite_column", counted)
    df = spark.range(0, 2000, 1, 4).select("id", F.col("id").cast("string").alias("cell"))
    J.transform(df, "cell", "1", "", str(tmp_path / "o"), order_by=["id"])
    assert seen.value == 2000


def test_job_errors(spark, people, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="Unknown mode"):
        J.run_transform(spark, people, "notes", "x", "", out, "e165")
    with pytest.raises(FileNotFoundError):
        J.run_transform(spark, people + "x.csv", "notes", "x", "", out)
    with pytest.raises(ValueError, match="no column 'Notes'"):
        J.run_transform(spark, people, "Notes", "x", "", out)
    for regex, replacement in (("(", ""), ("(?P<n>a)", ""), ("a", "$5.00"), ("a", "$"), ("(a|b)+", ""), ("(?:[a-z]b?)+", "")):
        with pytest.raises(J.UnsafePattern):
            J.run_transform(spark, people, "notes", regex, replacement, out)
    assert not os.path.exists(out)
    assert J.run_transform(spark, people, "notes", "a", "$5.00", out, literal=True)["row_count"] == 3
    assert J.run_transform(spark, people, "notes", r"(?x)(a) # group", "$1$1", out)["row_count"] == 3


def test_splittable_job_has_no_shuffle(spark, people, tmp_path):
    df = J.read_table(spark, people, keep_strings=True, multi_line=False)
    assert "Exchange" not in plan_of(J.rewrite_column(df, "notes", "x", ""))


def test_recorded_runs(spark, people, tmp_path):
    ledger = str(tmp_path / "ledger")
    base = {"file_path": people, "target_column": "notes", "result_dir": str(tmp_path / "results")}
    ok = J.run_recorded(
        spark,
        {**base, "prompt": "emails ending with gmail.com", "replacement_value": "***"},
        " `[a-z.]+@[a-z]+\\.gmail.com$` ",
        ledger,
    )
    assert (ok["status"], ok["progress"], ok["row_count"]) == ("SUCCESS", 100, 3)
    assert ok["generated_regex"] == "[a-z.]+@gmail.com$"
    notes = [r.notes for r in spark.read.parquet(ok["result_path"]).orderBy("id").collect()]
    assert notes[0] == "Write to ***"

    phones = J.run_recorded(
        spark,
        {**base, "prompt": "phones", "normalize_mode": "e164"},
        "PATTERN: \\d{3}\\d{3}\\d{4}3\nNORMALIZE: none",
        ledger,
    )
    # Standardising takes the pattern without repairs, and the mode of the run.
    assert (phones["status"], phones["generated_regex"]) == ("SUCCESS", r"\d{3}\d{3}\d{4}3")

    unsafe = J.run_recorded(spark, {**base, "prompt": "x"}, "(a+)+", ledger)
    missing = J.run_recorded(spark, {**base, "prompt": "x", "target_column": "z"}, "a", ledger)
    empty = J.run_recorded(spark, {**base, "prompt": "x", "normalize_mode": "iso8601"}, "hello", ledger)
    runs = {r.id: r for r in read_ledger(spark, ledger).collect()}
    assert len(runs) == 5
    assert "nested quantifier" in runs[unsafe["id"]].error_message
    assert "no column 'z'" in runs[missing["id"]].error_message
    assert "missing" in runs[empty["id"]].error_message
    assert {r.status for r in runs.values()} == {"SUCCESS", "FAILED"}
    assert all(r.completed_at >= r.started_at for r in runs.values())


def test_runs_share_a_catalogue(spark, people, tmp_path):
    ledger, known = str(tmp_path / "ledger"), str(tmp_path / "catalog")
    base = {"file_path": people, "target_column": "notes", "result_dir": str(tmp_path / "results")}

    def run(prompt, response, **more):
        return J.run_recorded(spark, {**base, "prompt": prompt, **more}, response, ledger, known)

    assert run("Mails", "[a-z]+@")["generated_regex"] == "[a-z]+@"
    # The second run of a prompt takes what the first one left, whatever the response is now.
    assert run(" mails ", "(")["generated_regex"] == "[a-z]+@"
    assert run("other", "(a|b)+")["status"] == "FAILED"
    spec = run("phones", "PATTERN: [0-9]{3}\nNORMALIZE: e164", normalize_mode="e164")
    assert run("phones", "nothing", normalize_mode="e164")["generated_regex"] == spec["generated_regex"] == "[0-9]{3}"
    entries = {(r.kind, r.value) for r in spark.read.parquet(known).collect()}
    assert entries == {("regex", "[a-z]+@"), ("spec", '{"pattern":"[0-9]{3}","normalize":"e164"}')}


def steps_of(spark, events, run):
    rows = E.read_events(spark, events).where(F.col("id") == run).orderBy("event_at").collect()
    return [(r.status, r.progress) for r in rows]


def test_runs_are_seen_as_they_go(spark, people, tmp_path):
    ledger, events = str(tmp_path / "ledger"), str(tmp_path / "events")
    base = {"file_path": people, "target_column": "notes", "result_dir": str(tmp_path / "results"), "prompt": "x"}
    (queued,) = E.queue_runs(spark, [base], events)
    done = J.run_recorded(spark, {**base, "id": queued}, "[0-9]+", ledger, events_path=events)
    assert done["status"] == "SUCCESS"
    assert steps_of(spark, events, queued) == [("QUEUED", 0), *(("RUNNING", p) for p in (10, 20, 27, 43, 98)), ("SUCCESS", 100)]
    state = E.run_states(E.read_events(spark, events)).first()
    assert (state.status, state.row_count, state.generated_regex, state.target_column) == ("SUCCESS", 3, "[0-9]+", "notes")
    failed = J.run_recorded(spark, {**base, "target_column": "z"}, "a", ledger, events_path=events)
    assert E.state_of(spark, events, failed["id"]) == "FAILED"


def test_cancelled_runs_do_no_work(spark, people, tmp_path, monkeypatch):
    ledger, events = str(tmp_path / "ledger"), str(tmp_path / "events")
    base = {"file_path": people, "target_column": "notes", "result_dir": str(tmp_path / "results"), "prompt": "x"}
    (early,) = E.queue_runs(spark, [base], events)
    E.cancel_run(spark, events, early)
    monkeypatch.setattr(J, "run_transform", lambda *a, **k: pytest.fail("cancelled runs do not begin"))
    assert J.run_recorded(spark, {**base, "id": early}, "a", ledger, events_path=events)["status"] == "CANCELLED"
    pattern_for = J.pattern_for

    def meanwhile(*args):
        E.cancel_run(spark, events, "later")
        return pattern_for(*args)

    monkeypatch.setattr(J, "pattern_for", meanwhile)
    assert J.run_recorded(spark, {**base, "id": "later"}, "a", ledger, events_path=events)["status"] == "CANCELLED"
    assert steps_of(spark, events, "later") == [("RUNNING", 10), ("CANCELLED", None)]
    assert {r.status for r in read_ledger(spark, ledger).collect()} == {"CANCELLED"}


def test_a_failing_job_leaves_the_old_result(spark, tmp_path):
    out = str(tmp_path / "out")
    first = J.write_result(spark.range(5), out)
    broken = spark.range(9).withColumn("id", F.when(F.col("id") == 8, F.raise_error(F.lit("no such luck")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no such luck"):
        J.write_result(broken, out)
    assert find_result(spark, out) == first["result_path"] and spark.read.parquet(first["result_path"]).count() == 5
    assert sorted(os.listdir(out)) == ["output.parquet"]
    # A job may read what it replaces.
    again = J.write_result(spark.read.parquet(first["result_path"]).where("id < 2"), out)
    assert again == {"result_path": first["result_path"], "row_count": 2} and spark.read.parquet(again["result_path"]).count() == 2


def test_a_switch_that_broke_off_is_finished(spark, tmp_path):
    out = str(tmp_path / "out")
    assert find_result(spark, out) is None
    path = J.write_result(spark.range(5), out)["result_path"]
    os.rename(path, f"{out}/_ready.parquet")  # as a crash between the renames leaves it
    assert spark.read.parquet(find_result(spark, out)).count() == 5
    assert J.write_result(spark.range(3), out)["row_count"] == 3
    assert spark.read.parquet(path).count() == 3 and sorted(os.listdir(out)) == ["output.parquet"]


def test_rows_that_do_not_fit_are_set_aside(spark, tmp_path):
    src, aside = tmp_path / "in.csv", str(tmp_path / "aside")
    src.write_text('id,notes,born\n1,"a, ""b""\nc",2024-01-01\n2,x\n3,y,2024-01-01,more\nfour,z,2024-01-01\n5,,\n6,w,2024-02-30\n')
    result = J.run_transform(spark, str(src), "notes", "b", "#", str(tmp_path / "out"), schema="id int, born date, notes string", quarantine_path=aside)
    assert (result["row_count"], result["quarantined_rows"]) == (2, 4)
    rows = spark.read.parquet(result["result_path"]).orderBy("id").collect()
    assert [(r.id, r.notes) for r in rows] == [(1, 'a, "#"\nc'), (5, None)] and rows[0].asDict().keys() == {"id", "born", "notes"}
    assert sorted(r.row_text for r in spark.read.parquet(aside).collect()) == ["2,x", "3,y,2024-01-01,more", "6,w,2024-02-30", "four,z,2024-01-01"]
    for bad in ({"schema": None}, {"schema": "id int", "suffix": ".parquet"}):
        with pytest.raises(ValueError):
            J.run_transform(spark, str(src), "notes", "b", "#", str(tmp_path / "o"), quarantine_path=aside, **bad)
    with pytest.raises(ValueError, match="names the columns"):
        J.run_transform(spark, str(src), "notes", "b", "#", str(tmp_path / "o"), schema="id int", quarantine_path=aside)


def test_recorded_batches_count_once(spark, tmp_path):
    out, events = str(tmp_path / "out"), str(tmp_path / "events")
    rows = spark.createDataFrame([(1, "a1"), (2, "b2")], "id int, cell string")
    write = recorded_batches("s", "cell", "[0-9]", "#", out, events)
    for _ in range(2):
        write(rows, 0)
    write(rows.limit(0), 1)
    assert sorted(tuple(r) for r in read_batches(spark, out, rows.schema).collect()) == [(1, "a#"), (2, "b#")]
    states = E.run_states(E.read_events(spark, events)).orderBy("id").collect()
    assert [(r.status, r.row_count, r.progress) for r in states] == [("SUCCESS", 2, 100), ("SUCCESS", 0, 100)]
    assert read_batches(spark, str(tmp_path / "none"), rows.schema).count() == 0


def test_every_failure_is_on_record(spark, people, tmp_path, monkeypatch):
    def broken(*args, **kwargs):
        raise ZeroDivisionError("no such luck")

    monkeypatch.setattr(J, "run_transform", broken)
    ledger = str(tmp_path / "ledger")
    run = {"file_path": people, "target_column": "notes", "result_dir": str(tmp_path / "r"), "prompt": "x"}
    assert J.run_recorded(spark, run, "a", ledger)["status"] == "FAILED"
    assert "no such luck" in read_ledger(spark, ledger).first().error_message


def test_script(people, tmp_path):
    out = str(tmp_path / "out")
    done = subprocess.run(
        [sys.executable, os.path.join(ROOT, "jobs", "run_transform.py"), "--file", people,
         "--column", "email", "--regex", "@.*", "--replacement", "@x", "--out", out],
        env={**os.environ, "PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300,
    )
    assert "'row_count': 3" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("mode", ["none", "iso8601"])
def test_stream_equals_batch(spark, tmp_path, mode):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def batch(start):
        return spark.range(start, start + 100, 1, 2).select(
            "id", F.concat(F.lit("1/"), F.col("id") % 40, F.lit("/2024")).alias("cell")
        )

    def run():
        stream = spark.readStream.schema("id bigint, cell string").parquet(src)
        start_rewrite(stream, "cell", "1", "#", out, str(tmp_path / "ck"), mode).awaitTermination(120)

    batch(0).write.mode("append").parquet(src)
    run()
    batch(100).write.mode("append").parquet(src)
    run()
    want = J.rewrite_column(batch(0).union(batch(100)), "cell", "1", "#", mode)
    got = spark.read.parquet(out)
    assert sorted(got.collect()) == sorted(want.collect())
