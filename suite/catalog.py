"""Prompts, patterns and the catalogue."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions.text import WHITESPACE
from maskwright.operators import catalog as C
from maskwright.operators import profiling as R
from maskwright.sources.tables import spread
from suite.base import Query, lit, table

_BLANKS = lit(WHITESPACE)


def as_second(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


# --- keys and responses ----------------------------------------------------


def prompt_keys(spark, folder):
    """Every document as a prompt."""
    return table(spark, folder, "documents").select(
        "doc_id", P.prompt_key(F.col("text")).alias("regex_key"), P.prompt_key(F.col("text"), "spec").alias("spec_key")
    )


def parse_patterns(spark, folder):
    response = F.concat(
        F.repeat(F.lit(" "), F.col("p_size") % 3),
        F.repeat(F.lit("`"), F.col("p_size") % 4),
        F.lit(" "),
        F.col("p_name"),
        F.lit("`[0-9]+"),
        F.repeat(F.lit("`"), F.col("p_size") % 4),
        F.lit("\t\n"),
    )
    return table(spark, folder, "part").select("p_partkey", P.parse_pattern(response).alias("pattern"))


SPEC_LAYOUTS = (
    "PATTERN: `{}+` \nNORMALIZE: e164",
    "Here it is\n  pattern:{}+\r\nnormalize: ISO8601  ",
    "PATTERN: wrong\nPATTERN: {}+\nNORMALIZE: unheard",
    "PATTERN: {}+",
    "NORMALIZE: e164\nPATTERNS: {}+",
)


def parse_specs(spark, folder):
    layouts = F.array(*(F.lit(x) for x in SPEC_LAYOUTS))
    response = F.replace(
        F.element_at(layouts, F.col("p_size") % len(SPEC_LAYOUTS) + 1), F.lit("{}"), F.col("p_name")
    )
    parsed = table(spark, folder, "part").select("p_partkey", P.parse_spec(response).alias("spec"))
    return parsed.select("p_partkey", "spec.*")


# --- audit and repair ------------------------------------------------------

# Patterns around a part's name, and what the audit must say about each.
AUDITED = (
    ("({}+)+", "nested quantifier"),
    ("({})+", None),
    ("(?:{})?", "nested quantifier"),
    ("[{}+]+", None),
    ("({}", "does not compile"),
    ("{}**", "does not compile"),
    (r"\(?{}\)?", None),
    ("(?P<n>{})", "does not compile"),
    ("({}|b)+", "recursing group"),
    ("({}|b)++", None),
    ("((?:{}|b)c){2}", "recursing group"),
    ("{}a*a*a*b", "ambiguous"),
    (r"{}\d+,?\d+[0-5]?\d+$", "ambiguous"),
    (r"\d++\d++\d++{}", None),
    (r"\S+@\S+{}", None),
    (r"[a-z0-9.-]+@[a-z0-9.-]+\.[a-z]{2,}{}", None),
)


def patterns_to_audit(spark, folder):
    layouts = F.array(*(F.lit(pattern) for pattern, _ in AUDITED))
    name = F.regexp_replace("p_name", "[^a-z]", "")
    pattern = F.replace(F.element_at(layouts, F.col("p_size") % len(AUDITED) + 1), F.lit("{}"), name)
    # Large parts get a pattern around the limit of 512 characters.
    long = F.repeat(F.lit("a"), F.col("p_size") + F.lit(470))
    return table(spark, folder, "part").select(
        "p_partkey", F.when(F.col("p_type") == "ECONOMY", long).otherwise(pattern).alias("pattern")
    )


# Patterns are looked at one by one, in Python: rows of a table that is small to read are work for many
# tasks. Bytes of the table, as it is stored, for each.
PATTERN_BYTES = 64 * 1024


def audit_patterns(spark, folder):
    return C.audit_patterns(spread(patterns_to_audit(spark, folder), f"{folder}/part.parquet", PATTERN_BYTES))


def _audited_sql() -> str:
    patterns = " ".join(f"WHEN {i} THEN replace({lit(p)}, '{{}}', name)" for i, (p, _) in enumerate(AUDITED))
    reasons = " ".join(
        f"WHEN {i} THEN {lit(reason) if reason else 'NULL'}" for i, (_, reason) in enumerate(AUDITED)
    )
    return f"""
SELECT p_partkey, pattern, reason IS NULL AS is_safe, reason
FROM (SELECT p_partkey,
    CASE WHEN p_type = 'ECONOMY' THEN repeat('a', p_size + 470) ELSE CASE p_size % {len(AUDITED)} {patterns} END END AS pattern,
    CASE WHEN p_type = 'ECONOMY' THEN CASE WHEN p_size > 42 THEN 'too long' END
      ELSE CASE p_size % {len(AUDITED)} {reasons} END END AS reason
  FROM (SELECT *, regexp_replace(p_name, '[^a-z]', '', 'g') AS name FROM part))
"""


def repair_digits(spark, folder):
    """Digit runs of all lengths, with and without the stray digit and an anchor."""
    a = (F.col("p_size") % 4 + 1).cast("string")
    b = (F.col("p_partkey") % 4 + 1).cast("string")
    c = (F.length("p_name") % 4 + 1).cast("string")
    end = F.element_at(F.array(*map(F.lit, ("7", "", r"7\b", "77", "7$"))), (F.col("p_size") % 5 + 1))
    pattern = F.concat(
        F.lit(r"\d{"), a, F.lit(r"}[-.\s]?\d{"), b, F.lit(r"}[-.\s]?\d{"), c, F.lit("}"), end
    )
    parts = table(spark, folder, "part").select("p_partkey", pattern.alias("pattern"))
    return C.repair_trailing_digits(parts)


_REPAIRED_DIGITS_SQL = r"""
SELECT p_partkey, '\d{' || a::VARCHAR || '}[-.\s]?\d{' || b::VARCHAR || '}[-.\s]?\d{'
  || (CASE WHEN a + b + c = 10 AND c >= 2 AND fin IN ('7', '7\b', '7$') THEN c - 1 ELSE c END)::VARCHAR
  || '}' || fin AS pattern
FROM (SELECT p_partkey, p_size % 4 + 1 AS a, p_partkey % 4 + 1 AS b, length(p_name) % 4 + 1 AS c,
    ['7', '', '7\b', '77', '7$'][p_size % 5 + 1] AS fin FROM part)
"""


def prompt_domains(spark, folder):
    """The domain each document speaks of, if read as a prompt, and one prompt per customer."""
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("prompt")
    )
    leads = F.array(*map(F.lit, ("Domain is ", "emails ending with @", "all EMAILS at ", "to x@", "nothing about ")))
    customers = table(spark, folder, "customer").select(
        F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("id"),
        F.concat(
            F.element_at(leads, F.col("c_nationkey") % 5 + 1), F.col("c_mktsegment"), F.lit(".Example.org, please")
        ).alias("prompt"),
    )
    return docs.unionByName(customers).select("id", P.domain_of(F.col("prompt")).alias("domain"))


_LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?"
_DOMAINS_SQL = f"""
SELECT id, lower(coalesce(
    nullif(regexp_extract(prompt, '(?i)(?:domain\\s+is\\s+|ending\\s+(?:with|in)\\s+@?|emails?\\s+at\\s+)({_LABEL}(?:\\.{_LABEL})+)', 1), ''),
    nullif(regexp_extract(prompt, '@({_LABEL}(?:\\.{_LABEL})+)', 1), ''))) AS domain
FROM (SELECT 'doc ' || doc_id::VARCHAR AS id, text AS prompt FROM documents
  UNION ALL
  SELECT 'customer ' || c_custkey::VARCHAR,
    ['Domain is ', 'emails ending with @', 'all EMAILS at ', 'to x@', 'nothing about '][c_nationkey % 5 + 1]
    || c_mktsegment || '.Example.org, please' FROM customer)
"""

# Patterns for the domain {} (escaped: {e}), and what the repair must make of each.
MAIL_PATTERNS = (
    ("[a-z]+@{e}", "[a-z]+@{e}"),
    (r"[a-z]+@[a-z.-]+\.{e}", r"[a-zA-Z0-9._%+-]+@{e}\b"),
    (r"[a-z]+@[a-z.-]+\.{}$", "[a-z]+@{}$"),
    ("[a-z]+@[x.-]+{}$", "[a-z]+@{}$"),
    (r"[a-z]+@[a-z.-]+\.{}", r"[a-z]+@[a-z.-]+\.{}"),
    ("([a-z]+@{e}", r"[a-zA-Z0-9._%+-]+@{e}\b"),
    (r"\d{3}\d{3}\d{4}5", r"\d{3}\d{3}\d{3}5"),
    ("(r+)+@{e}", "(r+)+@{e}"),
    ("(u+)+@{e}", "(u+)+@{e}"),
)


def repair_patterns(spark, folder):
    """A prompt that names a customer's own domain, and a pattern that more or less fits."""
    domain = F.concat(F.lit("shop"), F.col("c_custkey").cast("string"), F.lit(".example.com"))
    layouts = F.array(*(F.lit(pattern) for pattern, _ in MAIL_PATTERNS))
    layout = F.element_at(layouts, (F.col("c_custkey") % len(MAIL_PATTERNS) + 1).cast("int"))
    escaped = F.replace(domain, F.lit("."), F.lit(r"\."))
    given = table(spark, folder, "customer").select(
        "c_custkey",
        F.concat(F.lit("Domain is "), domain).alias("prompt"),
        F.replace(F.replace(layout, F.lit("{e}"), escaped), F.lit("{}"), domain).alias("pattern"),
    )
    return C.repair_patterns(spread(given, f"{folder}/customer.parquet", PATTERN_BYTES))


def _repaired_sql() -> str:
    repaired = " ".join(
        f"WHEN {i} THEN replace(replace({lit(p)}, '{{e}}', replace(domain, '.', '\\.')), '{{}}', domain)"
        for i, (_, p) in enumerate(MAIL_PATTERNS)
    )
    nested = ", ".join(str(i) for i, (_, p) in enumerate(MAIL_PATTERNS) if "+)+" in p)
    return f"""
SELECT c_custkey, 'Domain is ' || domain AS prompt, CASE pick {repaired} END AS pattern,
  pick NOT IN ({nested}) AS is_safe, CASE WHEN pick IN ({nested}) THEN 'nested quantifier' END AS reason
FROM (SELECT c_custkey, c_custkey % {len(MAIL_PATTERNS)} AS pick,
    'shop' || c_custkey::VARCHAR || '.example.com' AS domain FROM customer)
"""


# --- lookups ---------------------------------------------------------------

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
TTL = 20 * 24 * 3600
_LIVE = "TIMESTAMP '2024-01-11 00:00:00'"


def event_catalog(spark, folder):
    """Events as catalogue entries, each user many times over."""
    return table(spark, folder, "events").select(
        P.prompt_key(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("key"),
        F.lit("regex").alias("kind"),
        F.when(F.col("event_id") % 7 > 0, F.col("props")).otherwise("").alias("value"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def event_prompts(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        "props",
        P.prompt_key(F.concat(F.lit("  USER "), (F.col("user_id") * 2).cast("string"), F.lit("\n"))).alias("key"),
    )


_KEY = "'regex_cache:' || sha256('user ' || ({})::VARCHAR)"
_CATALOG_SQL = f"""
SELECT {_KEY.format("user_id")} AS key, 'regex' AS kind, CASE WHEN event_id % 7 > 0 THEN props ELSE '' END AS value,
  ts AS created_at FROM events
"""
_LIVE_SQL = f"""
SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, value DESC) AS place
  FROM ({_CATALOG_SQL}) WHERE created_at > {_LIVE}) WHERE place = 1 AND value <> ''
"""
_PROMPTS_SQL = f"SELECT event_id, props, {_KEY.format('user_id * 2')} AS key FROM events"


def catalog_hits(spark, folder):
    found = C.look_up(event_prompts(spark, folder), event_catalog(spark, folder), NOW, TTL)
    return found.select("event_id", "key", "cached")


def catalog_misses(spark, folder):
    found = C.misses(event_prompts(spark, folder), event_catalog(spark, folder), NOW, TTL)
    return found.select("event_id", "key")


def catalog_changes(spark, folder):
    """Patterns of events beside what the catalogue holds; those of one type must not run."""
    pattern = F.when(F.col("event_type") == "error", "(error+)+").otherwise(F.concat("event_type", F.lit("[0-9]+")))
    prompts = event_prompts(spark, folder).join(table(spark, folder, "events").select("event_id", pattern.alias("pattern")), "event_id")
    found = C.look_up(prompts, event_catalog(spark, folder), NOW, TTL)
    return C.changed_entries(C.audit_patterns(found)).select("event_id", "pattern", "cached")


def _refreshed(found, value, kind):
    """Every prompt's outcome, and what is written back under its key."""
    kept = C.as_entries(C.changed_entries(found, value), kind, NOW, value).select("key", F.col("value").alias("written"))
    return found.join(kept, "key", "left")


def _customer_entries(spark, folder, kind, value):
    """Entries of a third of the customers; those of even nations are too old."""
    entry = table(spark, folder, "customer").where("c_custkey % 3 = 0")
    fresh = F.when(F.col("c_nationkey") % 2 == 1, F.lit(datetime(2024, 1, 30, tzinfo=timezone.utc)))
    old = F.lit(datetime(2023, 12, 1, tzinfo=timezone.utc))
    return entry.select(
        P.prompt_key(F.concat(F.lit("user "), F.col("c_custkey").cast("string")), kind).alias("key"),
        F.lit(kind).alias("kind"), value.alias("value"), F.coalesce(fresh, old).alias("created_at"),
    )


def _customer_prompts(spark, folder, response):
    return table(spark, folder, "customer").select(
        "c_custkey", F.concat(F.lit(" User "), F.col("c_custkey").cast("string")).alias("prompt"), response.alias("response")
    )


def catalog_refresh(spark, folder):
    """Cached patterns, some in need of repair; raw responses, some unsafe."""
    cached = F.when(F.col("c_custkey") % 2 == 0, r"\d{3}\d{3}\d{4}5").otherwise("[0-9]+")
    response = F.when(F.col("c_custkey") % 5 == 0, "`(a|b)+`").otherwise(" `[a-z]+` ")
    prompts = _customer_prompts(spark, folder, response)
    found = C.refresh_patterns(prompts, _customer_entries(spark, folder, "regex", cached), NOW, TTL)
    return _refreshed(found, "pattern", "regex").select("c_custkey", "cached", "pattern", "reason", "written")


_REFRESH_SQL = r"""
SELECT c_custkey, cached, pattern, reason, CASE WHEN reason IS NULL AND pattern IS DISTINCT FROM cached THEN pattern END AS written
FROM (SELECT *, CASE WHEN cached IS NULL AND c_custkey % 5 = 0 THEN 'recursing group' END AS reason,
    CASE WHEN cached IS NULL THEN CASE WHEN c_custkey % 5 = 0 THEN '(a|b)+' ELSE '[a-z]+' END
      ELSE replace(cached, '{4}5', '{3}5') END AS pattern
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_nationkey % 2 = 1 THEN
      CASE WHEN c_custkey % 2 = 0 THEN '\d{3}\d{3}\d{4}5' ELSE '[0-9]+' END END AS cached FROM customer))
"""


def catalog_specs(spark, folder):
    """Cached specs as JSON, some unreadable; raw responses, some without a pattern."""
    cached = F.when(F.col("c_custkey") % 2 == 0, '{"pattern":"[0-9]{3}","normalize":"e164"}').otherwise("[0-9]{3}")
    response = F.when(F.col("c_custkey") % 5 == 0, "no such lines").otherwise("PATTERN: x+\nNORMALIZE: ISO8601")
    prompts = _customer_prompts(spark, folder, response)
    found = C.refresh_specs(prompts, _customer_entries(spark, folder, "spec", cached), NOW, TTL)
    return _refreshed(found, "value", "spec").select("c_custkey", "pattern", "normalize", "reason", "written")


_SPECS_SQL = """
SELECT c_custkey, pattern, CASE WHEN hit THEN 'e164' WHEN pattern IS NULL THEN 'none' ELSE 'iso8601' END AS normalize,
  CASE WHEN pattern IS NULL THEN 'missing' END AS reason,
  CASE WHEN NOT hit AND pattern IS NOT NULL THEN '{"pattern":"x+","normalize":"iso8601"}' END AS written
FROM (SELECT c_custkey, hit, CASE WHEN hit THEN '[0-9]{3}' WHEN c_custkey % 5 <> 0 THEN 'x+' END AS pattern
  FROM (SELECT c_custkey, c_custkey % 6 = 0 AND c_nationkey % 2 = 1 AS hit FROM customer))
"""


def suggestion_cache(spark, folder):
    """Sample sets of documents, of which every other one is filed with its suggestions."""
    samples = F.array(
        F.struct(F.lit("text").alias("column"), F.split("text", "\n").alias("samples")),
        F.struct(F.lit("lang").alias("column"), F.array("lang").alias("samples")),
    )
    sets = table(spark, folder, "documents").select(
        "doc_id", samples.alias("samples"),
        F.concat(F.lit('[{"column": "'), "lang", F.lit('", "pii_type": "EMAIL", "confidence": 0.75, "suggested_prompt": "p"},'
                 ' {"column": "x", "confidence": 0.5}]')).alias("response"),
    )
    value = '[{"column":"text","pii_type":"name","confidence":0.875,"suggested_prompt":"names"}]'
    catalog = sets.where("doc_id % 2 = 0").select(
        P.sample_key(F.col("samples")).alias("key"), F.lit("samples").alias("kind"), F.lit(value).alias("value"),
        F.lit(datetime(2024, 1, 30, tzinfo=timezone.utc)).alias("created_at"),
    )
    found = R.refresh_suggestions(sets, catalog, NOW, TTL)
    return found.select("doc_id", F.col("cached").isNotNull().alias("hit"), "value")


_SUGGESTIONS_SQL = """
WITH given AS (SELECT doc_id, lang, list_sort(string_split(text, chr(10))[1:5]) AS lines FROM documents),
filed AS (SELECT DISTINCT lang, lines FROM given WHERE doc_id % 2 = 0)
SELECT doc_id, f.lang IS NOT NULL AS hit,
  CASE WHEN f.lang IS NOT NULL THEN '[{"column":"text","pii_type":"name","confidence":0.875,"suggested_prompt":"names"}]'
    ELSE '[{"column":"' || g.lang || '","pii_type":"email","confidence":0.75,"suggested_prompt":"p"}]' END AS value
FROM given g LEFT JOIN filed f ON g.lang = f.lang AND g.lines = f.lines
"""


def catalog_upsert(spark, folder):
    added = table(spark, folder, "customer").select(
        P.prompt_key(F.concat(F.lit("user "), F.col("c_custkey").cast("string"))).alias("key"),
        F.lit("spec").alias("kind"),
        F.col("c_mktsegment").alias("value"),
        F.lit(datetime(2024, 1, 29, 12, tzinfo=timezone.utc)).alias("created_at"),
    )
    snapshot = C.upsert(event_catalog(spark, folder), added)
    return snapshot.withColumn("created_at", as_second(F.col("created_at")))


_UPSERT_SQL = f"""
SELECT key, kind, value, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, added DESC, value DESC) AS place
  FROM (SELECT *, 0 AS added FROM ({_CATALOG_SQL})
    UNION ALL
    SELECT {_KEY.format("c_custkey")}, 'spec', c_mktsegment, TIMESTAMP '2024-01-29 12:00:00', 1 FROM customer))
WHERE place = 1
"""


QUERIES = {
    "prompt_key": Query(
        prompt_keys,
        f"SELECT doc_id, 'regex_cache:' || sha256(lower(trim(text, {_BLANKS}))) AS regex_key,"
        f" 'spec_cache:' || sha256(lower(trim(text, {_BLANKS}))) AS spec_key FROM documents",
    ),
    "parse_patterns": Query(
        parse_patterns,
        "SELECT p_partkey, p_name || '`[0-9]+' AS pattern FROM part",
    ),
    "parse_specs": Query(
        parse_specs,
        "SELECT p_partkey, CASE WHEN p_size % 5 < 4 THEN p_name || '+' END AS pattern,"
        " CASE p_size % 5 WHEN 0 THEN 'e164' WHEN 1 THEN 'iso8601' WHEN 4 THEN 'e164' ELSE 'none' END AS normalize,"
        " CASE WHEN p_size % 5 = 4 THEN 'missing pattern' END AS error FROM part",
    ),
    "audit_patterns": Query(audit_patterns, _audited_sql()),
    "repair_digits": Query(repair_digits, _REPAIRED_DIGITS_SQL),
    "prompt_domain": Query(prompt_domains, _DOMAINS_SQL),
    "repair_patterns": Query(repair_patterns, _repaired_sql()),
    "catalog_hits": Query(
        catalog_hits,
        f"SELECT event_id, p.key, value AS cached FROM ({_PROMPTS_SQL}) p LEFT JOIN ({_LIVE_SQL}) c ON p.key = c.key",
    ),
    "catalog_misses": Query(
        catalog_misses,
        f"SELECT event_id, key FROM ({_PROMPTS_SQL}) p WHERE NOT EXISTS (SELECT 1 FROM ({_LIVE_SQL}) c WHERE c.key = p.key)",
    ),
    "catalog_changes": Query(
        catalog_changes,
        f"SELECT event_id, event_type || '[0-9]+' AS pattern, value AS cached FROM ({_PROMPTS_SQL}) p"
        f" JOIN (SELECT event_id, event_type FROM events) USING (event_id) LEFT JOIN ({_LIVE_SQL}) c ON p.key = c.key"
        " WHERE event_type <> 'error' AND event_type || '[0-9]+' IS DISTINCT FROM value",
    ),
    "catalog_refresh": Query(catalog_refresh, _REFRESH_SQL),
    "catalog_specs": Query(catalog_specs, _SPECS_SQL),
    "suggestion_cache": Query(suggestion_cache, _SUGGESTIONS_SQL),
    "catalog_upsert": Query(catalog_upsert, _UPSERT_SQL),
}
