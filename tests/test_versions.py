import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from maskwright.operators import versions as V
from maskwright.operators.folders import exists, files_in, read_text, rename_new, write_text

KIND = "k string, n int"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), KIND)


def largest(df):
    return df.groupBy("k").agg(F.max("n").alias("n"))


def held(spark, path):
    return sorted(((r.k or "", r.n) for r in V.read(spark, path, KIND).collect()))


def test_small_files(spark, tmp_path):
    one, two = str(tmp_path / "a [1].txt"), str(tmp_path / "b.txt")
    write_text(spark, one, "naïve")
    assert read_text(spark, one) == "naïve" and exists(spark, one)
    assert rename_new(spark, one, two) and not exists(spark, one)
    write_text(spark, one, "other")
    assert not rename_new(spark, one, two) and read_text(spark, two) == "naïve"
    assert files_in(spark, str(tmp_path / "none")) == []


def test_a_table_before_its_first_row(spark, tmp_path):
    path = str(tmp_path / "t")
    assert held(spark, path) == [] and V.current(spark, path) == V.Version()
    assert V.draft_merge(spark, path, KIND, "k", largest) is None
    assert V.merge_table(spark, path, KIND, "k", largest).number == 0


def test_merges_keep_what_they_should(spark, tmp_path):
    path = str(tmp_path / "t [x]")
    V.append(rows(spark, ("a", 1), ("b", 1), (None, 1)), path)
    V.append(rows(spark, ("a", 3), (None, 2)), path)
    assert len(held(spark, path)) == 5
    first = V.merge_table(spark, path, KIND, "k", largest, buckets=8)
    assert (first.number, first.buckets) == (1, 8) and held(spark, path) == [("", 2), ("a", 3), ("b", 1)]
    V.append(rows(spark, ("b", 7), ("c", 1)), path)
    assert held(spark, path) == [("", 2), ("a", 3), ("b", 1), ("b", 7), ("c", 1)]
    V.merge_table(spark, path, KIND, "k", largest, buckets=3)
    assert V.current(spark, path).buckets == 8  # a table keeps those it began with
    assert held(spark, path) == [("", 2), ("a", 3), ("b", 7), ("c", 1)]
    assert V.merge_table(spark, path, KIND, "k", largest).number == 2  # nothing new


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    V.append(rows(spark, *((f"k{i}", i) for i in range(200))), path)
    before = V.merge_table(spark, path, KIND, "k", largest, buckets=8)
    V.append(rows(spark, ("k5", 999)), path)
    after = V.merge_table(spark, path, KIND, "k", largest)
    assert len(set(before.files) - set(after.files)) == 1 and len(set(after.files) - set(before.files)) == 1
    assert dict(held(spark, path))["k5"] == 999 and len(held(spark, path)) == 200


def test_rows_appended_while_a_merge_runs_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    V.append(rows(spark, ("a", 1), ("a", 2)), path)
    draft = V.draft_merge(spark, path, KIND, "k", largest)
    V.append(rows(spark, ("a", 5), ("b", 1)), path)
    assert held(spark, path) == [("a", 1), ("a", 2), ("a", 5), ("b", 1)]  # a draft is not read
    V.publish(spark, draft)
    assert held(spark, path) == [("a", 2), ("a", 5), ("b", 1)]


def test_of_two_merges_the_first_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    V.append(rows(spark, ("a", 1)), path)
    one = V.draft_merge(spark, path, KIND, "k", largest)
    V.append(rows(spark, ("a", 2)), path)
    two = V.draft_merge(spark, path, KIND, "k", largest)
    V.publish(spark, two)
    with pytest.raises(V.Conflict):
        V.publish(spark, one)
    assert held(spark, path) == [("a", 2)]


def test_clearing_away(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(4):
        V.append(rows(spark, ("a", n), (f"b{n}", n)), path)
        V.merge_table(spark, path, KIND, "k", largest)
    want = held(spark, path)
    old = V.current(spark, path)
    assert V.clear_away(spark, path, keep=9) == []
    assert V.clear_away(spark, path, keep=1) and held(spark, path) == want
    assert V.clear_away(spark, path, keep=0) and held(spark, path) == want
    assert files_in(spark, path) == [] and V.current(spark, path) == old
    V.append(rows(spark, ("a", 9)), path)
    done = V.merge_table(spark, path, KIND, "k", largest)
    assert set(done.covered) == {f.rsplit("/", 1)[-1] for f in files_in(spark, path)} and dict(held(spark, path))["a"] == 9


def test_a_large_bucket_has_several_files(spark, tmp_path):
    """Whatever its size, no task sorts more of it than the session deals to one."""
    path = str(tmp_path / "t")
    rows = spark.range(0, 40_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").alias("n"))
    V.append(rows, path)
    name, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set(name, "200KB")
    try:
        version = V.merge_table(spark, path, "key string, n bigint", "key", lambda r: r.dropDuplicates(["key"]), 1)
    finally:
        spark.conf.set(name, before)
    assert len(version.files) > 1 and all("/__bucket=0/" in f for f in version.files)
    assert V.read(spark, path, "key string, n bigint").agg(F.count("n"), F.count_distinct("key")).first()[:] == (40_000, 40_000)
    for file in version.files[:2]:
        keys = [r.key for r in spark.read.parquet(f"{path}/{file}").collect()]
        assert keys == sorted(keys)


def test_a_large_merge_goes_bucket_by_bucket(spark, tmp_path, monkeypatch):
    """Each step sees the rows of its own buckets alone; the table is the same as by one step."""
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    first = rows(spark, *((f"k{i}", i) for i in range(100)), (None, 4), ("k5", 999))
    later = rows(spark, ("k5", 1000), ("k6", 1), ("new", 1), (None, 9))
    for path, size, steps in ((one, V.SLICE_BYTES, [1, 1]), (many, 1, [3, 2])):
        monkeypatch.setattr(V, "SLICE_BYTES", size)
        monkeypatch.setattr(V, "MOST_STEPS", 3)
        for added, wanted in zip((first, later), steps, strict=True):
            V.append(added, path)
            seen = []

            def merge(some, seen=seen):
                seen.append({r[0] for r in some.select(V.bucket_of(F.col("k"), 5)).distinct().collect()})
                return largest(some)

            V.merge_table(spark, path, KIND, "k", merge, 5)
            assert len(seen) == wanted and sum(map(len, seen)) == len(set().union(*seen))
    assert held(spark, one) == held(spark, many) and dict(held(spark, many))["k5"] == 1000
    for file in V.current(spark, many).files:
        keys = [r.k or "" for r in spark.read.parquet(f"{many}/{file}").collect()]
        assert keys == sorted(keys)


def test_files_are_compressed_by_zstd(spark, tmp_path):
    """Spark's default leaves hex digits, most of an event, as long as they are."""
    path = str(tmp_path / "t")
    V.append(spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.lit(1).alias("n")), path)
    version = V.merge_table(spark, path, KIND, "k", largest)
    for file in (*version.files, *version.covered):
        assert pq.ParquetFile(f"{path}/{file}").metadata.row_group(0).column(0).compression == "ZSTD"
    assert sum(os.path.getsize(f"{path}/{f}") for f in version.files) < 5000 * 48
