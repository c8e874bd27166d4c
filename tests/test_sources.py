import csv
import io
import re

import pytest
from plan_text import plan_of
from maskwright.sinks.files import write_csv, write_result
from maskwright.sources import tables as S


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    return str(tmp_path / name)


CELLS = 'id,zip,note,a.b\n1,02134,"two\nlines, ""quoted""",x\n2,,"",é\n'


def test_csv(spark, tmp_path):
    path = write(tmp_path, "in.CSV", CELLS)
    df = S.read_table(spark, path)
    assert df.dtypes == [("id", "int"), ("zip", "int"), ("note", "string"), ("a.b", "string")]
    assert [tuple(r) for r in df.collect()] == [
        (1, 2134, 'two\nlines, "quoted"', "x"), (2, None, None, "é"),
    ]
    kept = S.read_table(spark, path, keep_strings=True)
    assert kept.first()[1] == "02134" and set(t for _, t in kept.dtypes) == {"string"}
    by_name = S.read_table(spark, path, schema="note string, zip string, `a.b` string, id bigint")
    assert by_name.columns == ["note", "zip", "a.b", "id"]
    assert tuple(by_name.first()) == ('two\nlines, "quoted"', "02134", "x", 1)
    with pytest.raises(ValueError, match="schema names the columns"):
        S.read_table(spark, path, schema="id bigint, zip string, note string, x string")


def test_files_with_another_header_are_refused(spark, tmp_path):
    write(tmp_path, "one.csv", "a,b\n1,2\n")
    write(tmp_path, "two.csv", "b,a\n2,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        S.read_table(spark, str(tmp_path / "*.csv"), schema="a string, b string", multi_line=False).collect()


def test_dispatch(spark, tmp_path):
    with pytest.raises(ValueError, match="No reader for '.bin'"):
        S.read_table(spark, write(tmp_path, "corrupt.bin", "<?binary?>"))
    with pytest.raises(ValueError, match=r"\(no suffix\)"):
        S.read_table(spark, str(tmp_path))
    with pytest.raises(ValueError, match="'.xls'"):
        S.read_table(spark, str(tmp_path / "a.xls"))
    for name in ("none.csv", "none.parquet"):
        with pytest.raises(FileNotFoundError, match="no input"):
            S.read_table(spark, str(tmp_path / name))
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert S.read_table(spark, str(tmp_path / "t.parquet")).count() == 3
    write(tmp_path, "one.csv", "a\n1\n")
    write(tmp_path, "two.csv", "a\n2\n")
    assert S.read_table(spark, str(tmp_path / "*.csv")).count() == 2
    assert S.read_table(spark, write(tmp_path, "empty.csv", "")).columns == []


def test_csv_sink_changes_nothing(spark, tmp_path):
    rows = [(1, " padded\t", 'q"uo"te'), (2, "a,b", "line\nbreak"), (3, "back\\slash", None), (4, '"', "\\")]
    df = spark.createDataFrame(rows, "id int, a string, b string").coalesce(1)
    path = str(tmp_path / "out.csv")
    write_csv(df, path)
    assert sorted(tuple(r) for r in S.read_table(spark, path).collect()) == rows
    # and a plain reader agrees
    file = next((tmp_path / "out.csv").glob("*.csv"))
    plain = list(csv.reader(io.StringIO(file.read_text(encoding="utf-8"), newline="")))
    assert plain[0] == ["id", "a", "b"]
    assert plain[1:] == [[str(i), a, b or ""] for i, a, b in rows]


def test_result_sink_counts_while_writing(spark, tmp_path):
    df = spark.range(0, 1000, 1, 5).where("id % 3 = 0")
    result = write_result(df, str(tmp_path / "job") + "/")
    assert result == {"result_path": str(tmp_path / "job" / "output.parquet"), "row_count": 334}
    assert spark.read.parquet(result["result_path"]).count() == 334
    assert list((tmp_path / "job" / "output.parquet").glob("*.snappy.parquet"))
    assert write_result(spark.range(7), str(tmp_path / "job"))["row_count"] == 7


def test_partition_numbers(spark, tmp_path):
    mib = 1024 * 1024
    assert S.partitions_for(None) == 4
    assert S.partitions_for(0) == S.partitions_for(255 * mib) == 1
    assert S.partitions_for(256 * mib) == 2
    assert S.partitions_for(10**12, most=64) == 64
    assert S.partitions_for(100 * 10**12) == 745058
    path = write(tmp_path, "in.csv", "a\n" + "1\n" * 5000)
    df = S.read_table(spark, path)
    spread = S.spread(df, path, target=1000)
    assert "RoundRobinPartitioning(10)" in plan_of(spread) and spread.count() == 5000
    assert re.search(r"ReadSchema: struct<.*length:bigint>", plan_of(S.input_files(spark, path)))
    assert "content" not in plan_of(S.input_files(spark, path))


def test_rows_of_a_large_file_are_dealt_without_a_sort(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "DEALT_AT_ONCE", 1000)
    path = write(tmp_path, "in.csv", "a\n" + "1\n" * 5000)  # copies of one row are spread too
    df = S.read_table(spark, path)
    few = S.spread(df, path, target=1000)
    assert "RoundRobin" not in plan_of(few) and few.columns == ["a"]
    sizes = [len(part) for part in few.rdd.glom().collect()]
    assert len(sizes) == 10 and sum(sizes) == 5000 and max(sizes) < 700
    monkeypatch.setattr(S, "FIRST_DEAL", 4)
    many = S.spread(df, path, target=1000)
    assert "RoundRobinPartitioning(10)" in plan_of(many) and "hashpartitioning(__number0" in plan_of(many)
    assert many.count() == 5000
