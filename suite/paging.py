"""Counts, row numbers and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import paging as G
from suite.base import Query, table, work_path


def _day(name):
    """A time as text, so that both sides print it alike."""
    return F.date_format(name, "yyyy-MM-dd")


def row_count(spark, folder):
    return G.row_count(table(spark, folder, "lineitem"))


def rows_per_file(spark, folder):
    return G.rows_per_file(table(spark, folder, "lineitem"))


SHIPMENT_KEYS = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def numbered_rows(spark, folder):
    """All shipments numbered by a key many rows share, then by the unique ones."""
    keys = ["l_returnflag", *SHIPMENT_KEYS]
    rows = table(spark, folder, "lineitem")
    return G.number_rows(rows, keys, work_path(spark, "numbered")).withColumn("l_shipdate", _day("l_shipdate"))


def stored_row_ids(spark, folder):
    rows = G.with_row_ids(spark, f"{folder}/events.parquet")
    return rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def page_rows(spark, folder):
    keys = [G.SortKey("o_totalprice", descending=True), "o_orderkey"]
    page = G.sorted_page(table(spark, folder, "orders"), keys, 3, 100)
    return page.withColumn("o_orderdate", _day("o_orderdate"))


def page_deep(spark, folder):
    """The last page but one of all shipments, which are neither sorted nor stored for it."""
    rows = table(spark, folder, "lineitem")
    total = rows.count()
    page = G.sorted_page(rows, SHIPMENT_KEYS, max(1, G.pages_in(total, 500) - 1), 500, total)
    return page.withColumn("l_shipdate", _day("l_shipdate"))


def stored_page(spark, folder):
    page = G.stored_page(spark, f"{folder}/events.parquet", 2, 300)
    return page.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def stored_page_of_parts(spark, folder):
    """Orders in folders by status, of which one got a column later; a page across the border."""
    path = work_path(spark, "parts")
    orders = table(spark, folder, "orders").withColumn("o_orderdate", _day("o_orderdate"))
    keys = ["o_orderstatus", "o_orderkey"]
    early, late = F.col("o_orderstatus") == "F", F.col("o_orderstatus") != "F"
    G.in_order(orders.where(early), keys).write.partitionBy("o_orderstatus").parquet(path)
    added = G.in_order(orders.where(late), keys).withColumn("added", F.col("o_custkey") * 2)
    added.write.mode("append").partitionBy("o_orderstatus").parquet(path)
    rows = G.file_offsets(spark, path)
    border = rows.where("first_row > 0").agg(F.min("first_row")).first()[0] or 0
    page = G.stored_page(spark, path, border // 200 + 1, 200)
    # Which part comes first is a matter of file names: rows are known by what they hold.
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "added"]
    whole = G.with_row_ids(spark, path).select("row_id", *names).join(page.select("row_id", F.lit(True).alias("on_page")), "row_id", "left")
    paged = page.select("row_id", *names).withColumn("on_page", F.lit(True))
    return whole.where("on_page IS NULL").unionByName(paged).drop("row_id", "on_page")


def page_counters(spark, folder):
    return G.page_counters(table(spark, folder, "orders"), 2, 250)


def page_columnar(spark, folder):
    page = G.stored_page(spark, f"{folder}/orders.parquet", 2, 50)
    columns = ["o_orderkey", "o_orderpriority"]
    arrays = G.page_columns(page.select("row_id", *columns))
    return arrays.select(*(F.to_json(c).alias(c) for c in columns))


QUERIES = {
    "row_count": Query(row_count, "SELECT count(*) AS row_count FROM lineitem"),
    "rows_per_file": Query(
        rows_per_file, "SELECT 'lineitem.parquet' AS file_name, count(*) AS rows FROM lineitem"
    ),
    "numbered_rows": Query(
        numbered_rows,
        f"SELECT row_number() OVER (ORDER BY l_returnflag, {', '.join(SHIPMENT_KEYS)}) - 1 AS row_id,"
        " * REPLACE (strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate) FROM lineitem",
    ),
    "stored_row_ids": Query(
        stored_row_ids,
        "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id,"
        " * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts) FROM events",
    ),
    "page_rows": Query(
        page_rows,
        "SELECT * FROM (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS row_id,"
        " * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders) WHERE row_id BETWEEN 200 AND 299",
    ),
    "page_deep": Query(
        page_deep,
        "SELECT * EXCLUDE (n) REPLACE (strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate) FROM"
        f" (SELECT row_number() OVER (ORDER BY {', '.join(SHIPMENT_KEYS)}) - 1 AS row_id, *, count(*) OVER () AS n FROM lineitem)"
        " WHERE row_id // 500 = greatest(0, (n + 499) // 500 - 2)",
    ),
    "stored_page": Query(
        stored_page,
        "SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts) FROM"
        " (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id, * FROM events) WHERE row_id BETWEEN 300 AND 599",
    ),
    "stored_page_of_parts": Query(
        stored_page_of_parts,
        "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate),"
        " CASE WHEN o_orderstatus <> 'F' THEN o_custkey * 2 END AS added FROM orders",
    ),
    "page_counters": Query(
        page_counters,
        "SELECT count(*) AS total_rows, 2 AS page, 250 AS page_size,"
        " greatest(1, ceil(count(*) / 250.0))::BIGINT AS total_pages FROM orders",
    ),
    "page_columnar": Query(
        page_columnar,
        "SELECT to_json(list(o_orderkey ORDER BY o_orderkey))::VARCHAR AS o_orderkey,"
        " to_json(list(o_orderpriority ORDER BY o_orderkey))::VARCHAR AS o_orderpriority"
        " FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 50)",
    ),
}
