"""Samples, classification, suggestions; and contacts rendered from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions.patterns import sample_key
from maskwright.functions.pii import LIBRARY
from maskwright.functions.text import WHITESPACE
from maskwright.operators import profiling as R
from suite.base import Query, lit, table

# --- contacts --------------------------------------------------------------


def contacts(spark, folder):
    """Each order and its customer as a contact, rendered from their columns."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    key = F.col("o_orderkey")
    phone = F.format_string(
        "(%03d) %03d-%04d", F.col("o_custkey") % 800 + 200, key % 800 + 200, F.floor("o_totalprice") % 10000
    )
    email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.com"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("id"),
        F.concat(F.initcap("c_mktsegment"), F.lit(" Customer")).alias("full_name"),
        email.alias("email"),
        phone.alias("phone"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("since"),
        F.col("o_totalprice").alias("balance"),
    )
    notes = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Call "), "phone")).when(F.col("id") % 3 == 1, F.concat(F.lit("Write to "), "email"))
    return rows.withColumn("notes", notes.otherwise(F.concat(F.lit("Since "), "since")))


CONTACTS_SQL = """
SELECT *, CASE id % 3 WHEN 0 THEN 'Call ' || phone WHEN 1 THEN 'Write to ' || email ELSE 'Since ' || since END AS notes
FROM (SELECT o_orderkey AS id, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' Customer' AS full_name,
    lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example.com' AS email,
    '(' || (o_custkey % 800 + 200)::VARCHAR || ') ' || (o_orderkey % 800 + 200)::VARCHAR || '-'
      || lpad((floor(o_totalprice)::BIGINT % 10000)::VARCHAR, 4, '0') AS phone,
    strftime(o_orderdate, '%-m/%-d/%Y') AS since, o_totalprice AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""
CONTACT_COLUMNS = ["id", "full_name", "email", "phone", "since", "balance", "notes"]


# --- classification --------------------------------------------------------


def pii_shares(spark, folder):
    return R.match_shares(table(spark, folder, "pages"))


def pii_columns(spark, folder):
    return R.classify_columns(contacts(spark, folder))


def pii_tables(spark, folder):
    """All columns of four raw tables, whatever little of them matches."""
    found = None
    for name in ("customer", "pages", "documents", "conversations"):
        one = R.classify_columns(table(spark, folder, name), min_confidence=0.01)
        one = one.select(F.lit(name).alias("table_name"), "*")
        found = one if found is None else found.unionByName(one)
    return found


def pii_plan(spark, folder):
    return R.plan_suggestions(pii_columns(spark, folder))


def _cells_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT {lit(c)} AS \"column\", {c}::VARCHAR AS cell FROM ({source})" for c in columns
    )


def _shares_sql(source: str, columns) -> str:
    counts = ", ".join(f"count(*) FILTER (regexp_matches(cell, {lit(t.regex)})) AS {t.name}" for t in LIBRARY)
    return (
        f'SELECT "column", count(cell) AS cells, {counts} FROM ({_cells_sql(source, columns)})'
        ' WHERE cell IS NOT NULL GROUP BY "column"'
    )


def _classified_sql(source: str, columns, least: float = 0.6) -> str:
    rows = " UNION ALL ".join(
        f'SELECT "column", {t.name} / cells AS share, {rank} AS rank, {lit(t.name)} AS pii_type,'
        f" {lit(t.prompt)} AS suggested_prompt FROM shares"
        for rank, t in enumerate(LIBRARY)
    )
    return f"""
SELECT "column", pii_type, round(share, 2) AS confidence, suggested_prompt
FROM (WITH shares AS ({_shares_sql(source, columns)})
      SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY share DESC, rank) AS place FROM ({rows}))
WHERE place = 1 AND share >= {least}
"""


def _plan_sql() -> str:
    labels = " ".join(f"WHEN {lit(t.name)} THEN {lit(t.label)}" for t in LIBRARY)
    return f"""
SELECT "column" AS target_column, suggested_prompt AS prompt, pii_type,
  CASE pii_type {labels} ELSE pii_type END AS label,
  CASE pii_type WHEN 'phone' THEN 'e164' WHEN 'date' THEN 'iso8601' ELSE 'none' END AS normalize_mode,
  CASE WHEN pii_type IN ('phone', 'date') THEN '' ELSE '[REDACTED]' END AS replacement_value
FROM ({_classified_sql(CONTACTS_SQL, CONTACT_COLUMNS)})
"""


RAW_TABLES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "pages": ["page_id", "url", "html"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


# --- samples ---------------------------------------------------------------

_BLANKS = lit(WHITESPACE)


def column_samples(spark, folder):
    samples = R.column_samples(table(spark, folder, "customer"), ["c_custkey"])
    return samples.select("column", F.to_json("samples").alias("samples"))


def clean_samples(spark, folder):
    """Lines of each document, taken for the samples of one column."""
    docs = table(spark, folder, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("column"),
        F.split("text", "\n").alias("samples"),
    )
    return R.clean_samples(docs).select("column", F.to_json("samples").alias("samples"))


def trim_samples(spark, folder):
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("column"),
        F.split("text", " ").alias("samples"),
    )
    return R.trim_samples(turns).select("column", F.to_json("samples").alias("samples"))


def sample_keys(spark, folder):
    """One sample set per document: its lines and its language."""
    entries = F.array(
        F.struct(F.lit("text").alias("column"), F.split("text", "\n").alias("samples")),
        F.struct(F.lit("lang").alias("column"), F.array("lang").alias("samples")),
    )
    return table(spark, folder, "documents").select("doc_id", sample_key(entries).alias("key"))


# --- suggestions -----------------------------------------------------------

KINDS = {"view": "EMAIL", "click": "phone", "signup": "zip", "purchase": "date", "error": "url"}


def suggestion_responses(spark, folder):
    """A raw response per event; each fifth kind is not pure JSON."""
    share = F.concat(F.lit("0."), F.lpad((F.col("event_id") * 37 % 1000).cast("string"), 3, "0"))
    kind = F.element_at(F.create_map(*(F.lit(x) for p in KINDS.items() for x in p)), F.col("event_type"))
    item = F.concat(
        F.lit('{"column": "c'), F.col("user_id").cast("string"), F.lit('", "pii_type": "'), kind,
        F.lit('", "confidence": '), share, F.lit(', "suggested_prompt": "find '), kind, F.lit('"}'),
    )
    body = F.concat(F.lit("["), item, F.lit(', "note", {"column": "k", "confidence": "0.75"}]'))
    return table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.concat(F.lit("Sure: "), body))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("```"), body, F.lit("```\n")))
        .otherwise(body)
        .alias("response"),
    )


def parse_suggestions(spark, folder):
    return R.parse_suggestions(suggestion_responses(spark, folder))


# The share has three places: rounded by hand from the exact binary value, as a
# tie in print is none in the stored number.
_PARSED_SQL = """
WITH given AS (
  SELECT event_id, event_type, user_id, event_id * 37 % 1000 AS mille,
    ('0.' || lpad((event_id * 37 % 1000)::VARCHAR, 3, '0'))::DOUBLE AS share
  FROM events WHERE event_type <> 'error')
SELECT event_id, 'c' || user_id::VARCHAR AS "column",
  CASE event_type WHEN 'view' THEN 'email' WHEN 'click' THEN 'phone' WHEN 'purchase' THEN 'date'
    ELSE 'none' END AS pii_type,
  CASE WHEN mille % 10 < 5 THEN (mille // 10)::DOUBLE / 100
       WHEN mille % 10 > 5 THEN (mille // 10 + 1)::DOUBLE / 100
       WHEN exact * 2 > 9007199254740992 THEN (mille // 10 + 1)::DOUBLE / 100
       WHEN exact * 2 < 9007199254740992 THEN (mille // 10)::DOUBLE / 100
       ELSE (mille // 10 + (mille // 10) % 2)::DOUBLE / 100 END AS confidence,
  'find ' || CASE event_type WHEN 'view' THEN 'EMAIL' WHEN 'click' THEN 'phone'
    WHEN 'purchase' THEN 'date' ELSE 'zip' END AS suggested_prompt
FROM (SELECT *, (share * 9007199254740992)::HUGEINT * 100 % 9007199254740992 AS exact FROM given)
WHERE mille >= 600
UNION ALL
SELECT event_id, 'k', 'none', 0.75, '' FROM given
"""


def _samples_sql() -> str:
    columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    cells = " UNION ALL ".join(
        f"SELECT {lit(c)} AS \"column\", trim({c}::VARCHAR, {_BLANKS}) AS cell, row_number() OVER (ORDER BY c_custkey) AS n"
        f" FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 30) WHERE {c} IS NOT NULL"
        for c in columns
    )
    return (
        f'SELECT "column", to_json(list(cell ORDER BY n))::VARCHAR AS samples FROM ({cells})'
        " WHERE n <= 8 AND cell <> '' GROUP BY \"column\""
    )


QUERIES = {
    # The name is that of the first round; the rows are rendered from orders and customers.
    "synthetic_contacts": Query(contacts, CONTACTS_SQL),
    "pii_shares": Query(pii_shares, _shares_sql("SELECT * FROM pages", RAW_TABLES["pages"])),
    "pii_columns": Query(pii_columns, _classified_sql(CONTACTS_SQL, CONTACT_COLUMNS)),
    "pii_tables": Query(
        pii_tables,
        " UNION ALL ".join(
            f"SELECT {lit(name)} AS table_name, * FROM"
            f" ({_classified_sql(f'SELECT * FROM {name}', columns, 0.01)})"
            for name, columns in RAW_TABLES.items()
        ),
    ),
    "pii_plan": Query(pii_plan, _plan_sql()),
    "column_samples": Query(column_samples, _samples_sql()),
    "clean_samples": Query(
        clean_samples,
        "SELECT source || '/' || doc_id::VARCHAR AS \"column\", to_json(kept[1:10])::VARCHAR AS samples"
        " FROM (SELECT *, list_filter(string_split(text, chr(10)),"
        f" lambda line: trim(line, {_BLANKS}) <> '') AS kept FROM documents) WHERE len(kept) > 0",
    ),
    "trim_samples": Query(
        trim_samples,
        "SELECT conv_id::VARCHAR || '/' || turn::VARCHAR AS \"column\","
        " to_json(string_split(text, ' ')[1:8])::VARCHAR AS samples FROM conversations",
    ),
    "sample_key": Query(
        sample_keys,
        "SELECT doc_id, 'pii_suggest:' || sha256(to_json([{'column': 'lang', 'samples': [lang]},"
        " {'column': 'text', 'samples': list_sort(string_split(text, chr(10))[1:5])}])::VARCHAR) AS key"
        " FROM documents",
    ),
    "parse_suggestions": Query(parse_suggestions, _PARSED_SQL),
}
