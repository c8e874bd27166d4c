"""Operators on tables of prompts and patterns.

The catalogue is a table ``(key, kind, value, created_at)``. Lookups are equi-joins
without hints: Catalyst broadcasts a catalogue below its own size threshold, and
above it the adaptive skew join splits a prompt key that holds a large share of
the rows. Keeping the newest entry per key is an aggregate with map-side combine,
so a hot key never gathers its rows in one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions.text import quoted
from maskwright.operators import versions

CATALOG_SCHEMA = "key string, kind string, value string, created_at timestamp"

# Fixed value: seconds an entry stays valid.
TTL_SECONDS = 3600


# --- audit and repair ------------------------------------------------------


def audit_patterns(df: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Add ``is_safe`` and, where it is false, the ``reason``."""
    reason = P.unsafe_reason(quoted(pattern))
    return df.withColumn("reason", reason).withColumn("is_safe", F.col("reason").isNull())


def repair_trailing_digits(df: DataFrame, pattern: str = "pattern") -> DataFrame:
    return df.withColumn(pattern, P.repair_trailing_digit(quoted(pattern)))


def repair_mail_domains(
    df: DataFrame, pattern: str = "pattern", prompt: str = "prompt"
) -> DataFrame:
    """Let each pattern match ``user@domain`` for the domain its prompt names.

    Tried in turn: the pattern as it is, without a bracketed sub-domain before the
    domain, without a bracketed run there; the first that finds the address is
    taken, else a plain address pattern if the pattern spells the domain escaped.
    Matching is Python's, where a pattern that does not compile just does not
    match; in the JVM it would end the job. A pattern that the audit refuses by its
    text, one that might hold a task for good, is neither matched nor changed. Each
    step is its own projection, so the domain, the candidates and the Python call
    are computed once per row.
    """
    own = quoted(pattern)
    domain, shorter, shortest, choice = (
        F.col(f"__{name}") for name in ("domain", "shorter", "shortest", "choice")
    )
    return (
        df.withColumn("__domain", F.when(P.refused_unseen(own).isNull(), P.domain_of(quoted(prompt))))
        .withColumns(
            {
                "__shorter": P.without_sub_domain(own, domain),
                "__shortest": P.without_run(own, domain),
                "__address": F.concat(F.lit("user@"), domain),
                "__asked": F.when(domain.isNotNull(), own),
            }
        )
        .withColumn("__choice", P.first_found(F.col("__address"), F.col("__asked"), shorter, shortest))
        .withColumn(
            pattern,
            F.when(domain.isNull() | (choice == 1), own)
            .when(choice == 2, shorter)
            .when(choice == 3, shortest)
            .when(
                F.contains(own, F.lit("@")) & F.contains(own, P.escaped_domain(domain)),
                P.plain_address(domain),
            )
            .otherwise(own),
        )
        .drop("__domain", "__shorter", "__shortest", "__address", "__asked", "__choice")
    )


def repair_patterns(
    df: DataFrame, pattern: str = "pattern", prompt: str = "prompt"
) -> DataFrame:
    """Digit repair, then domain repair, then the audit of the outcome."""
    return audit_patterns(repair_mail_domains(repair_trailing_digits(df, pattern), pattern, prompt), pattern)


# --- lookups ---------------------------------------------------------------


def newest_per_key(entries: DataFrame, *tie_break: str) -> DataFrame:
    """One entry per key: the newest, then by ``tie_break``, then by value."""
    order = ["created_at", *tie_break, "value", "kind"]
    best = F.max(F.struct(*order)).alias("best")
    return entries.groupBy("key").agg(best).select("key", *(f"best.{name}" for name in order))


def live_entries(catalog: DataFrame, now: datetime | Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Entries younger than the time to live; an empty value counts as none.

    The age condition is on ``created_at`` alone, so it reaches the Parquet scan.
    """
    oldest = F.lit(now) - F.make_dt_interval(secs=F.lit(ttl))
    live = newest_per_key(catalog.where(F.col("created_at") > oldest))
    return live.where(F.col("value") != "").select("key", "value", "created_at")


def _joined(prompts: DataFrame, known: DataFrame, key: str, how: str) -> DataFrame:
    """Join on the key, in a way the adaptive skew join can split.

    It splits only sides that come straight from a shuffle made for the join. The
    known entries are already spread by key for their aggregate, and Spark would
    join on that; a second condition, implied by the first, makes it shuffle the
    aggregated rows once more, which are few beside the prompts.
    """
    same = quoted(key) == F.col("__key")
    return prompts.join(known, same & (F.xxhash64(quoted(key)) == F.xxhash64("__key")), how)


def look_up(
    prompts: DataFrame,
    catalog: DataFrame,
    now: datetime | Column,
    ttl: int = TTL_SECONDS,
    key: str = "key",
) -> DataFrame:
    """Add ``cached`` (NULL on a miss) to every prompt."""
    known = live_entries(catalog, now, ttl).select(
        F.col("key").alias("__key"), F.col("value").alias("cached")
    )
    return _joined(prompts, known, key, "left").drop("__key")


def misses(
    prompts: DataFrame,
    catalog: DataFrame,
    now: datetime | Column,
    ttl: int = TTL_SECONDS,
    key: str = "key",
) -> DataFrame:
    """The prompts without a live entry."""
    known = live_entries(catalog, now, ttl).select(F.col("key").alias("__key"))
    return _joined(prompts, known, key, "left_anti")


def changed_entries(audited: DataFrame, value: str = "pattern", cached: str = "cached") -> DataFrame:
    """The rows worth writing back: new values, and those a repair has changed; safe ones only.

    The rows have been audited: what must not run is not kept for later runs.
    """
    if "is_safe" not in audited.columns:
        raise ValueError("Audit the patterns first: there is no column 'is_safe'.")
    changed = ~quoted(value).eqNullSafe(quoted(cached)) & quoted(value).isNotNull()
    return audited.where(F.col("is_safe") & changed)


def upsert(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """Next snapshot: the newest entry per key; at equal age the added one wins."""
    columns = ["key", "kind", "value", "created_at"]
    both = (
        catalog.select(*columns, F.lit(0).alias("added"))
        .unionByName(entries.select(*columns, F.lit(1).alias("added")))
    )
    return newest_per_key(both, "added").select(*columns)


# --- a run's way through the catalogue ------------------------------------------


def refresh_patterns(
    prompts: DataFrame,
    catalog: DataFrame,
    now: datetime | Column,
    ttl: int = TTL_SECONDS,
    prompt: str = "prompt",
    response: str = "response",
) -> DataFrame:
    """Add ``key, cached, pattern, reason, is_safe`` to every prompt.

    The pattern is the catalogue's, else that of the raw response; repaired and
    audited either way, as an entry may be older than a repair.
    """
    found = look_up(prompts.withColumn("key", P.prompt_key(quoted(prompt))), catalog, now, ttl)
    given = F.coalesce("cached", P.parse_pattern(quoted(response)))
    return repair_patterns(found.withColumn("pattern", given), "pattern", prompt)


def refresh_specs(
    prompts: DataFrame,
    catalog: DataFrame,
    now: datetime | Column,
    ttl: int = TTL_SECONDS,
    prompt: str = "prompt",
    response: str = "response",
) -> DataFrame:
    """Add ``key, cached, pattern, normalize, value, reason, is_safe``; ``value`` is what to keep.

    The spec is the catalogue's, if it can be read, else that of the raw response.
    """
    found = look_up(prompts.withColumn("key", P.prompt_key(quoted(prompt), "spec")), catalog, now, ttl)
    parsed = P.parse_spec(quoted(response))
    fresh = F.struct(parsed["pattern"].alias("pattern"), parsed["normalize"].alias("normalize"))
    found = found.withColumn("__spec", F.coalesce(P.read_spec(F.col("cached")), fresh))
    found = found.withColumns({"pattern": F.col("__spec.pattern"), "normalize": F.col("__spec.normalize")}).drop("__spec")
    value = F.when(F.col("pattern").isNotNull(), P.spec_value(F.col("pattern"), F.col("normalize")))
    return audit_patterns(found.withColumn("value", value))


def as_entries(rows: DataFrame, kind: str, now: datetime | Column, value: str = "pattern") -> DataFrame:
    """Catalogue entries of rows with a ``key``, one per key."""
    entries = rows.select("key", F.lit(kind).alias("kind"), quoted(value).alias("value"), F.lit(now).alias("created_at"))
    return newest_per_key(entries).select("key", "kind", "value", "created_at")


# --- the stored catalogue ---------------------------------------------------------


def append_entries(entries: DataFrame, path: str) -> None:
    """The catalogue is read by its newest entry per key, so that adding to it is enough."""
    versions.append(entries.select("key", "kind", "value", "created_at"), path)


def read_catalog(spark: SparkSession, path: str | None) -> DataFrame:
    """The newest snapshot's entries and those appended since; none where there is no catalogue yet."""
    return versions.read(spark, path, CATALOG_SCHEMA) if path else spark.createDataFrame([], CATALOG_SCHEMA)


def merge_catalog(
    spark: SparkSession, path: str, buckets: int = versions.BUCKETS, oldest: datetime | Column | None = None
) -> versions.Version:
    """Fold the appended entries into the next snapshot: the newest per key, as ``upsert`` keeps it.

    Only the buckets that appended keys fall into are read and written. Entries created before
    ``oldest`` are dropped from these: what is past its time to live is found by nobody, and a
    catalogue that keeps it only ever grows. Entries appended meanwhile stay to be read.
    """

    def merged(rows: DataFrame) -> DataFrame:
        if oldest is not None:
            rows = rows.where(F.col("created_at") >= F.lit(oldest))
        return newest_per_key(rows)

    return versions.merge_table(spark, path, CATALOG_SCHEMA, "key", merged, buckets)
