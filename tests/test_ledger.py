from datetime import datetime, timezone

from pyspark.sql import functions as F

from plan_text import plan_of
from maskwright.operators import ledger as L

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def run(i, **fields):
    base = {
        "id": f"RUN-{i:03d}", "status": "SUCCESS", "progress": 100, "original_filename": f"file{i}.csv",
        "prompt": "Find Emails", "row_count": i, "created_at": T0.replace(hour=i),
    }
    return {**base, **fields}


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "ledger")
    L.record_runs(spark, [run(1)], path)
    L.record_runs(spark, [run(2, status="FAILED", error_message="x" * 3000)], path)
    ledger = L.read_ledger(spark, path)
    assert len(L.RUN_SCHEMA) == 17 and ledger.schema.names == L.RUN_SCHEMA.names
    assert ledger.count() == 2
    failed = L.run_status(ledger, "RUN-002")
    assert failed.columns == list(L.STATUS_COLUMNS)
    assert len(failed.first().error_message) == 2000
    assert [r.id for r in L.list_runs(ledger).collect()] == ["RUN-002", "RUN-001"]
    assert L.list_runs(ledger).columns == list(L.LIST_COLUMNS)


def test_find(spark, tmp_path):
    path = str(tmp_path / "ledger")
    runs = [run(1), run(2, prompt="Redact phones"), run(3, status="FAILED", prompt=None), run(4, status="QUEUED")]
    L.record_runs(spark, runs, path)
    ledger = L.read_ledger(spark, path)

    def ids(**kwargs):
        return sorted(r.id[-1] for r in L.find_runs(ledger, **kwargs).collect())

    assert ids() == ["1", "2", "3", "4"]
    assert ids(status="SUCCESS") == ["1", "2"]
    assert ids(search="EMAIL") == ["1", "4"]
    assert ids(search="run-002") == ["2"]
    assert ids(search="FILE3") == ["3"]
    assert ids(search="find file4.csv") == ["4"]
    assert ids(search="50%") == []
    assert "EqualTo(status,FAILED)" in plan_of(L.find_runs(ledger, status="FAILED"))
    done = ledger.where(L.is_terminal(F.col("status")))
    assert sorted(r.id[-1] for r in done.collect()) == ["1", "2", "3"]


def test_compacting(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for i in range(1, 7):
        L.record_runs(spark, [run(i)], path)
    L.record_runs(spark, [run(3)], path)
    out = L.compact_runs(spark, path, str(tmp_path / "new"), rows_per_file=4)
    assert sorted(r.id[-1] for r in out.collect()) == list("123456")
    assert out.select(F.input_file_name()).distinct().count() <= 2
    assert L.read_ledger(spark, path).count() == 7
