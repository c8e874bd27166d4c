import os
import re

import pytest
from pyspark.sql import functions as F

from plan_text import plan_of
from maskwright.operators import paging as G


def stored(spark, tmp_path, sizes):
    """A dataset with the given rows per file, values counting up in file order."""
    path = str(tmp_path / "a dir" / "data")
    start = 0
    for i, size in enumerate(sizes):
        part = spark.range(start, start + size, 1, 1).select(F.col("id").alias("v"))
        part.write.parquet(f"{path}.{i}")
        start += size
    target = tmp_path / "a dir" / "data"
    target.mkdir()
    for i in range(len(sizes)):
        file = next((tmp_path / "a dir" / f"data.{i}").glob("part-*.parquet"))
        # Beyond five digits the names no longer sort by number.
        number = 99_998 + i
        file.replace(target / re.sub(r"part-\d+", f"part-{number:05d}", file.name))
    return path


def values(df):
    return [r.v for r in df.collect()]


@pytest.mark.parametrize("size", [1, 7, 100, 150, 299, 1000])
def test_pages_put_together_are_the_table(spark, tmp_path, size):
    path = stored(spark, tmp_path, [150, 0, 149, 1])
    total = 300
    pages = G.pages_in(total, size)
    wanted = range(1, pages + 1) if pages < 10 else [1, 2, pages // 2, pages]
    for number in wanted:
        rows = G.stored_page(spark, path, number, size, total).collect()
        first = (number - 1) * size
        assert [r.row_id for r in rows] == [r.v for r in rows] == list(range(first, min(first + size, total)))


def test_page_across_files_opens_only_those(spark, tmp_path):
    path = stored(spark, tmp_path, [150, 150, 150])
    page = G.stored_page(spark, path, 2, 100)
    assert values(page) == list(range(100, 200))
    assert len(page.inputFiles()) == 2


def test_row_ids_without_gaps(spark, tmp_path):
    path = stored(spark, tmp_path, [5, 7, 0, 3])
    rows = G.with_row_ids(spark, path)
    assert rows.columns == ["row_id", "v"]
    assert sorted((r.row_id, r.v) for r in rows.collect()) == [(i, i) for i in range(15)]
    plan = plan_of(rows)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_number_rows_by_key_with_a_hot_leading_key(spark, tmp_path):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id"
    ).repartition(7)
    rows = G.number_rows(df, ["k", "id"], str(tmp_path / "t")).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(4000))
    assert [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)


@pytest.mark.parametrize("copies", [False, True])
def test_hot_key_and_copies_are_split_over_ranges(spark, tmp_path, copies):
    """A third of all rows share their key, or are copies of one row."""
    hot = F.col("id") % 3 == 0
    df = spark.range(0, 30000, 1, 12).select(
        F.when(hot, 7).otherwise(F.col("id")).alias("k"),
        (F.when(hot, 0) if copies else F.when(hot, F.col("id"))).alias("v"),
        F.create_map(F.lit("m"), F.lit(1)).alias("m"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        sizes = G.in_order(df, ["k"]).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 12000
    numbered = G.number_rows(df, ["k"], str(tmp_path / "t")).select("row_id", "k").orderBy("row_id").collect()
    assert [r.row_id for r in numbered] == list(range(30000))
    assert [r.k for r in numbered] == sorted(r.k for r in numbered)


def test_sorted_pages(spark, monkeypatch):
    df = spark.range(0, 5000, 1, 8).select((F.col("id") % 10).alias("k"), F.col("id").alias("v"))
    keys = [G.SortKey("k", descending=True)]
    whole = [tuple(r) for n in range(1, 6) for r in G.sorted_page(df, keys, n, 1000).collect()]
    assert [r[0] for r in whole] == list(range(5000))
    assert [r[1] for r in whole] == sorted((r[1] for r in whole), reverse=True)
    assert sorted(r[2] for r in whole) == list(range(5000))
    # Cut into ranges, the same pages come out, by plans that sort a small range only.
    monkeypatch.setattr(G, "ROWS_TO_SORT", 300)
    pages = [G.sorted_page(df, keys, n, 1000) for n in range(1, 6)]
    assert [tuple(r) for p in pages for r in p.collect()] == whole
    assert all("rangepartitioning" not in plan_of(p).split("Window")[-1] for p in pages)


def test_sorted_pages_of_odd_rows(spark, monkeypatch):
    """NULLs, NaN, maps, a hot key and many copies of one row; page borders lose and repeat none."""
    monkeypatch.setattr(G, "ROWS_TO_SORT", 50)
    kinds = "d double, s string, m map<string,int>"
    rows = [(float("nan") if i % 7 == 0 else None if i % 5 == 0 else i % 11 / 2, f"s{i % 3}", {"a": i % 4}) for i in range(400)]
    rows += [(1.0, "copy", {"a": 1})] * 300
    df = spark.createDataFrame(rows, kinds).repartition(5)
    for keys in (["d"], [G.SortKey("d", True), "s"], ["s", G.SortKey("d")]):
        pages = [r for n in range(1, 8) for r in G.sorted_page(df, keys, n, 100).collect()]
        assert [r.row_id for r in pages] == list(range(700))
        order = [k.order for k in G.sort_keys(keys)]
        want = df.orderBy(*order).collect()
        names = [k.name for k in G.sort_keys(keys)]
        assert [[str(r[n]) for n in names] for r in pages] == [[str(r[n]) for n in names] for r in want]
        assert sorted(str(tuple(r)[1:]) for r in pages) == sorted(str(tuple(r)) for r in want)


def test_row_ids_of_very_many_files(spark, tmp_path, monkeypatch):
    path = stored(spark, tmp_path, [5, 7, 0, 3, 4])
    monkeypatch.setattr(G, "FILES_AT_ONCE", 2)
    rows = G.with_row_ids(spark, path)
    assert sorted((r.row_id, r.v) for r in rows.collect()) == [(i, i) for i in range(19)]
    assert "hashpartitioning(__file_path" not in plan_of(rows)


def test_pages_of_a_dataset_that_grew(spark, tmp_path):
    """A folder named like a file, partitions of mixed type, a later column, globs in a name."""
    path = str(tmp_path / "odd {x}" / "part-00000.snappy.parquet")
    spark.range(0, 20, 1, 2).withColumn("k", F.lit("1")).write.partitionBy("k").parquet(path)
    later = spark.range(20, 40, 1, 2).withColumn("k", F.lit("x")).withColumn("more", F.lit(2.5))
    later.write.mode("append").partitionBy("k").parquet(path)
    pages = [G.stored_page(spark, path, n, 15) for n in (1, 2, 3)]
    assert {str(p.dtypes) for p in pages} == {str([("row_id", "bigint"), ("id", "bigint"), ("more", "double"), ("k", "string")])}
    rows = [r for p in pages for r in p.collect()]
    assert [r.row_id for r in rows] == list(range(40))
    assert sorted((r.id, r.k, r.more) for r in rows) == [(i, "1" if i < 20 else "x", None if i < 20 else 2.5) for i in range(40)]
    file = str(next((tmp_path / "odd {x}").rglob("part-*-*.parquet")))
    alone = G.stored_page(spark, file, 1, 5)
    assert alone.columns[:2] == ["row_id", "id"] and alone.count() == 5


def test_page_prunes_by_row_id(spark, tmp_path):
    path = str(tmp_path / "numbered")
    G.number_rows(spark.range(1000), ["id"], path + "-sorted").write.parquet(path)
    page = G.page(spark.read.parquet(path), 3, 100, total_rows=1000)
    assert [r.id for r in page.collect()] == list(range(200, 300))
    pushed = re.search(r"PushedFilters: \[.*?\]", plan_of(page)).group()
    assert "GreaterThanOrEqual(row_id,200)" in pushed and "LessThan(row_id,300)" in pushed


def test_a_taken_name_is_refused(spark, tmp_path):
    path = str(tmp_path / "numbered")
    G.number_rows(spark.range(10), ["id"], path + "-sorted").write.parquet(path)
    for call in (G.with_row_ids, G.stored_page):
        with pytest.raises(ValueError, match="already"):
            call(spark, path)
    page = G.stored_page(spark, path, 1, 5, row_id="at")
    assert page.columns == ["at", "row_id", "id"] and page.count() == 5
    assert G.page(page, 1, 3, row_id="at").count() == 3


def test_limits(spark, tmp_path):
    df = spark.range(2500).withColumnRenamed("id", "row_id")
    assert G.page(df, 1, 5000).count() == 1000
    assert G.page(df, 3, 1000).count() == 500
    for number in (0, 4):
        with pytest.raises(ValueError, match=f"no page {number}"):
            G.page(df, number, 1000)
    with pytest.raises(ValueError, match="at least 1"):
        G.page(df, 1, 0)
    empty = str(tmp_path / "empty")
    spark.range(0).write.parquet(empty)
    assert G.stored_page(spark, empty).collect() == []
    with pytest.raises(ValueError, match="no page 2"):
        G.stored_page(spark, empty, 2)
    assert G.number_rows(spark.range(0), ["id"], str(tmp_path / "none")).count() == 0


def test_counters(spark):
    def counters(rows, **kwargs):
        return tuple(G.page_counters(spark.range(rows), **kwargs).first())

    assert counters(2501, page=2) == (2501, 2, 100, 26)
    assert counters(2500, page_size=9999) == (2500, 1, 1000, 3)
    assert counters(0) == (0, 1, 100, 1)


def test_counts(spark, tmp_path):
    path = stored(spark, tmp_path, [5, 7, 3])
    df = spark.read.parquet(path)
    assert G.row_count(df).first().row_count == 15
    per_file = G.rows_per_file(df)
    assert sorted(r.rows for r in per_file.collect()) == [3, 5, 7]
    assert "ReadSchema: struct<>" in plan_of(per_file)


def test_columnar_page_is_bounded(spark):
    df = spark.range(1001).select(F.col("id").alias("row_id"), "id")
    assert len(G.page_columns(df.limit(1000)).first().id) == 1000
    with pytest.raises(Exception, match="at most 1000 rows"):
        G.page_columns(df).collect()


def test_page_with_stored_offsets(spark, tmp_path):
    path = stored(spark, tmp_path, [150, 150])
    kept = str(tmp_path / "offsets")
    G.file_offsets(spark, path).write.parquet(kept)
    offsets = spark.read.parquet(kept)
    assert values(G.stored_page(spark, path, 2, 100, 300, offsets)) == list(range(100, 200))


def test_pages_of_a_partitioned_dataset(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(0, 40, 1, 4).select("id", (F.col("id") % 2).alias("odd")).write.partitionBy("odd").parquet(path)
    rows = [r for n in (1, 2, 3, 4) for r in G.stored_page(spark, path, n, 10).collect()]
    assert [r.row_id for r in rows] == list(range(40))
    assert sorted((r.id, r.odd) for r in rows) == [(i, i % 2) for i in range(40)]


def test_columnar_page_keeps_order_and_nulls(spark):
    rows = [(i, None if i % 2 else f"v{i}", {"m": i}) for i in range(6)]
    df = spark.createDataFrame(rows, "row_id bigint, `a.b` string, c map<string,int>").repartition(3)
    out = G.page_columns(df)
    assert out.columns == ["a.b", "c"]
    row = out.first()
    assert row[0] == ["v0", None, "v2", None, "v4", None]
    assert row[1] == [{"m": i} for i in range(6)]


def test_an_index_is_extended_by_new_files_only(spark, tmp_path, monkeypatch):
    path, index = str(tmp_path / "t"), str(tmp_path / "index")
    spark.range(0, 70).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(path)
    first = {r.file_path: (r.rows, r.first_row) for r in G.extend_offsets(spark, path, index).collect()}
    assert sum(n for n, _ in first.values()) == 70
    spark.range(70, 100).repartitionByRange(2, "id").sortWithinPartitions("id").write.mode("append").parquet(path)
    asked = []
    offsets = G._offsets
    monkeypatch.setattr(G, "_offsets", lambda df: asked.append(len(df.inputFiles())) or offsets(df))
    second = G.extend_offsets(spark, path, index)
    assert asked == [2] and {r.file_path: (r.rows, r.first_row) for r in second.collect()}.items() >= first.items()
    G.merge_offsets(spark, index)
    third = G.extend_offsets(spark, path, index)
    assert asked == [2] and third.count() == second.count()
    numbered = G.with_row_ids(spark, path, "at", offsets=third).collect()
    assert all(r["at"] == r.id for r in numbered) and len(numbered) == 100
    page = G.stored_page(spark, path, 4, 20, offsets=third)
    assert [r.id for r in page.collect()] == list(range(60, 80))
    for name in os.listdir(path):
        if name.startswith("part-00000"):
            os.remove(os.path.join(path, name))
    with pytest.raises(ValueError, match="no longer"):
        G.extend_offsets(spark, path, index)


def test_places_among_cuts(spark):
    import itertools
    import random

    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b", "c"]), rng.choice([None, 0.5, float("nan")])) for _ in range(300)]
    df = spark.createDataFrame(rows, "x int, y string, z double")
    for flags in itertools.product([False, True], repeat=3):
        keys = [G.SortKey(n, d) for n, d in zip("xyz", flags, strict=True)]
        cuts = [tuple(r) for r in df.distinct().orderBy(*(k.order for k in keys)).collect()][::3]
        got = df.select(G._place_among(keys, df, cuts).alias("p"), *(F.struct(G._before(keys, df, c), G._equal(keys, df, c)).alias(f"c{i}") for i, c in enumerate(cuts))).collect()
        for r in got:
            before = sum(not r[f"c{i}"][0] and not r[f"c{i}"][1] for i in range(len(cuts)))
            equal = [i for i in range(len(cuts)) if r[f"c{i}"][1]]
            assert r.p == (2 * equal[0] + 1 if equal else 2 * before)


def test_a_count_that_no_longer_holds(spark, monkeypatch):
    monkeypatch.setattr(G, "ROWS_TO_SORT", 10)
    with pytest.raises(ValueError, match="empty"):
        G.sorted_page(spark.range(0), ["id"], 2, 10, total_rows=1000).collect()


def test_parts_have_several_files(spark, tmp_path, monkeypatch):
    """No task sorts a whole part."""
    from maskwright.operators.folders import files_in
    from suite import paging as queries

    rows = spark.range(0, 3000, 1, 2).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.element_at(F.array(*map(F.lit, "FOP")), (F.col("id") % 3 + 1).cast("int")).alias("o_orderstatus"),
        F.lit(1.5).alias("o_totalprice"), F.current_timestamp().alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"),
    )
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(queries, "work_path", lambda s, stem: f"{tmp_path}/{stem}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = queries.stored_page_of_parts(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.o_orderkey, r.added) for r in got) == [(i, 2 * i if i % 3 else None) for i in range(3000)]
    assert len(files_in(spark, f"{tmp_path}/parts", nested=True)) > 3
