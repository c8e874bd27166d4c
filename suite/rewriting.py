"""Redaction, phones, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.redaction import redact
from maskwright.operators.rewrite import rewrite_column, rows_matching
from suite.base import Query, lit, table

EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
US_PHONE = r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
DOTTED_IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


def redact_email(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return rewrite_column(docs, "text", EMAIL, "[REDACTED]")


def redact_all_kinds(spark, folder):
    """Three rules after one another, still one scan and one projection."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    for regex, mark in ((EMAIL, "<mail>"), (US_PHONE, "<phone>"), (DOTTED_IP, "<ip>")):
        docs = rewrite_column(docs, "text", regex, mark)
    return docs


def redact_groups(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    return rewrite_column(customers, "c_name", "([A-Za-z]+)#0*([0-9]+)", "$2 ($1)")


def redact_delete(spark, folder):
    return rewrite_column(table(spark, folder, "pages"), "html", "<[^>]*>")


def redact_numeric(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return rewrite_column(orders, "o_custkey", "[05]+", "*")


def redact_literal(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return rewrite_column(orders, "o_orderpriority", "([0-9])-", "$1 ", literal=True)


def redact_turns(spark, folder):
    return rewrite_column(table(spark, folder, "conversations"), "text", "[0-9]+", "#")


def rows_with_phone(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return rows_matching(docs, "text", US_PHONE).select("doc_id", "lang")


# --- phones ----------------------------------------------------------------


def orders_with_phone(spark, folder):
    """A phone per order, its layout by the priority; some are too short or no phone."""
    ten = (F.col("o_orderkey") * 7 + F.lit(2_000_000_000)).cast("string")

    def part(start: int, length: int) -> Column:
        return F.substring(ten, start, length)

    phone = (
        F.when(
            F.startswith("o_orderpriority", F.lit("1")),
            F.concat(F.lit("("), part(1, 3), F.lit(") "), part(4, 3), F.lit("-"), part(7, 4)),
        )
        .when(F.startswith("o_orderpriority", F.lit("2")), F.concat_ws(".", part(1, 3), part(4, 3), part(7, 4)))
        .when(F.startswith("o_orderpriority", F.lit("3")), F.concat(F.lit("call 1"), ten, F.lit(" now")))
        .when(F.startswith("o_orderpriority", F.lit("4")), F.concat(F.lit("ext "), part(7, 4)))
        .otherwise(F.concat(F.lit("+44 "), ten, F.lit("x"), F.col("o_custkey").cast("string")))
    )
    return table(spark, folder, "orders").select("o_orderkey", phone.alias("phone"))


_PHONES_SQL = """
SELECT o_orderkey, CASE left(o_orderpriority, 1)
  WHEN '1' THEN '(' || substr(t, 1, 3) || ') ' || substr(t, 4, 3) || '-' || substr(t, 7, 4)
  WHEN '2' THEN substr(t, 1, 3) || '.' || substr(t, 4, 3) || '.' || substr(t, 7, 4)
  WHEN '3' THEN 'call 1' || t || ' now'
  WHEN '4' THEN 'ext ' || substr(t, 7, 4)
  ELSE '+44 ' || t || 'x' || o_custkey::VARCHAR END AS phone
FROM (SELECT *, (o_orderkey * 7 + 2000000000)::VARCHAR AS t FROM orders)
"""

_E164_SQL = """
SELECT o_orderkey, CASE
  WHEN NOT regexp_matches(phone, {gate}) THEN phone
  WHEN length(digits) = 10 THEN '+1' || digits
  WHEN length(digits) BETWEEN 7 AND 15 THEN '+' || digits
  ELSE phone END AS phone
FROM (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS digits FROM ({phones}))
"""


def phone_e164(spark, folder):
    return rewrite_column(orders_with_phone(spark, folder), "phone", "[0-9]", mode="e164")


def phone_gated(spark, folder):
    """Only the cells that hold a bracketed area code are touched."""
    return rewrite_column(orders_with_phone(spark, folder), "phone", r"\([0-9]{3}\)", mode="e164")


# --- dates -----------------------------------------------------------------

# Spark layout, DuckDB layout, how the rule must read it.
LAYOUTS = (
    ("MM/dd/yyyy", "%m/%d/%Y", "date"),
    ("M-d-yyyy", "%-m-%-d-%Y", "date"),
    ("dd/MM/yyyy", "%d/%m/%Y", "day first"),
    ("d-M-yyyy", "%-d-%-m-%Y", "day first"),
    ("yyyy/MM/dd", "%Y/%m/%d", "date"),
    ("yyyy-M-d", "%Y-%-m-%-d", "date"),
    ("MMMM d, yyyy", "%B %-d, %Y", "date"),
    ("MMM dd, yyyy", "%b %d, %Y", "date"),
    ("MMMM dd yyyy", "%B %d %Y", "date"),
    ("MMM  d yyyy", "%b  %-d %Y", "date"),
    ("M/d/yy", "%-m/%-d/%y", "date"),
    ("dd/MM/yy", "%d/%m/%y", "day first"),
    ("yyyyMMdd", "%Y%m%d", "date"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "text"),
    ("d MMMM yyyy", "%-d %B %Y", "text"),
)
# Ship dates end in 2001; the shift makes some older than the two-digit pivot.
_SHIFT_YEARS = 28


def shipments_with_date(spark, folder):
    """The ship date as text, in a layout picked by the row's numbers."""
    shipped = F.col("l_shipdate") - F.make_ym_interval(
        F.when(F.col("l_returnflag") == "R", _SHIFT_YEARS).otherwise(0), F.lit(0)
    )
    pick = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    text = F.lit(None).cast("string")
    for i, (layout, _, _) in reversed(list(enumerate(LAYOUTS))):
        text = F.when(pick % len(LAYOUTS) == i, F.date_format("d", layout)).otherwise(text)
    return (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_linenumber", shipped.alias("d"))
        .select("l_orderkey", "l_linenumber", text.alias("shipped"))
    )


def date_iso8601(spark, folder):
    return rewrite_column(shipments_with_date(spark, folder), "shipped", "[0-9]", mode="iso8601")


def _date_sql() -> str:
    cases = []
    for i, (_, layout, reading) in enumerate(LAYOUTS):
        # Two-digit years before 69 are read as 20xx.
        meant = "CASE WHEN year(d) < 1969 THEN d + INTERVAL 100 YEAR ELSE d END" if "%y" in layout else "d"
        correct = f"strftime({meant}, '%Y-%m-%d')"
        if reading == "date":
            value = correct
        elif reading == "text":
            value = f"strftime(d, {lit(layout)})"
        else:
            value = f"CASE WHEN day(d) <= 12 THEN strftime({meant}, '%Y-%d-%m') ELSE {correct} END"
        cases.append(f"WHEN {i} THEN {value}")
    return f"""
SELECT l_orderkey, l_linenumber, CASE pick {" ".join(cases)} END AS shipped
FROM (SELECT l_orderkey, l_linenumber,
        (l_orderkey * 7 + l_linenumber) % {len(LAYOUTS)} AS pick,
        CASE WHEN l_returnflag = 'R' THEN l_shipdate - INTERVAL {_SHIFT_YEARS} YEAR ELSE l_shipdate END AS d
      FROM lineitem)
"""


def replaced_sql(columns: str, column: str, regex: str, mark: str, source: str) -> str:
    return (
        f"SELECT {columns}, regexp_replace({column}::VARCHAR, {lit(regex)}, {lit(mark)}, 'g')"
        f" AS {column} FROM {source}"
    )


def plain_redaction(spark, folder):
    """The single expression, several columns at once."""
    return table(spark, folder, "supplier").select(
        "s_suppkey",
        redact(F.col("s_name"), "[0-9]", "#").alias("s_name"),
        redact(F.col("s_nationkey"), "^1", "one ").alias("s_nationkey"),
    )


QUERIES = {
    "redact_email": Query(
        redact_email, replaced_sql("doc_id", "text", EMAIL, "[REDACTED]", "documents")
    ),
    "redact_all_kinds": Query(
        redact_all_kinds,
        "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,"
        f" {lit(EMAIL)}, '<mail>', 'g'), {lit(US_PHONE)}, '<phone>', 'g'), {lit(DOTTED_IP)}, '<ip>', 'g')"
        " AS text FROM documents",
    ),
    "redact_groups": Query(
        redact_groups,
        replaced_sql("c_custkey", "c_name", "([A-Za-z]+)#0*([0-9]+)", r"\2 (\1)", "customer"),
    ),
    "redact_delete": Query(redact_delete, replaced_sql("page_id, url", "html", "<[^>]*>", "", "pages")),
    "redact_numeric": Query(
        redact_numeric, replaced_sql("o_orderkey, o_orderstatus", "o_custkey", "[05]+", "*", "orders")
    ),
    "redact_literal": Query(
        redact_literal, replaced_sql("o_orderkey", "o_orderpriority", "([0-9])-", "$1 ", "orders")
    ),
    "redact_turns": Query(
        redact_turns, replaced_sql("conv_id, turn, role", "text", "[0-9]+", "#", "conversations")
    ),
    "redact_columns": Query(
        plain_redaction,
        "SELECT s_suppkey, regexp_replace(s_name, '[0-9]', '#', 'g') AS s_name,"
        " regexp_replace(s_nationkey::VARCHAR, '^1', 'one ', 'g') AS s_nationkey FROM supplier",
    ),
    "rows_matching": Query(
        rows_with_phone,
        f"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, {lit(US_PHONE)})",
    ),
    "phone_e164": Query(phone_e164, _E164_SQL.format(gate="'[0-9]'", phones=_PHONES_SQL)),
    "phone_gated": Query(phone_gated, _E164_SQL.format(gate=lit(r"\([0-9]{3}\)"), phones=_PHONES_SQL)),
    "date_iso8601": Query(date_iso8601, _date_sql()),
}
