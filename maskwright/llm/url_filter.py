"""URL filters by a temporal list join.

A list is a log of dated entries: a key was added or dropped. Entries become intervals in which the
key is listed, and each capture is joined with the intervals of its URL's keys that were open at its
fetch time: an as-of join, so that later changes of a list don't change how old captures are judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import quoted, saved, without

#: Intervals, some 100 bytes each, are broadcast up to this many; beyond it both sides are shuffled.
BROADCAST_INTERVALS = 200_000
#: Host and path of a URL.
_URL = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and last dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _URL, 1)), r"\.+$", "")


def lookup_keys(url: Column) -> Column:
    """What a list may name: ``host:``, ``domain:`` of the host and each parent, ``path:`` of the host
    with each prefix of the path that ends before a slash, or whole. None for NULL or without host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.concat_ws(".", F.slice(labels, i, F.size(labels)))))
    steps = F.array_remove(F.split(F.regexp_extract(F.trim(url), _URL, 2), "/"), "")
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("path:"), host, F.lit("/"), F.concat_ws("/", F.slice(steps, 1, i)))))
    none = F.array().cast("array<string>")
    all_keys = F.concat(F.array(F.concat(F.lit("host:"), host)), domains, F.coalesce(paths, none))
    return F.when(F.coalesce(host, F.lit("")) != "", all_keys).otherwise(none)


def intervals(entries: DataFrame) -> DataFrame:
    """``list, key, since, until`` (NULL while open) from dated entries ``list, key, action, at``.

    ``action`` is ``add`` or ``drop``; others, and entries with a NULL in a column, are left out. Of
    entries at one time the drop is last. What is added twice is listed once, from the first time.
    Repeated entries count once. Entries are few per key and list: their dates.
    """
    logged = entries.where(F.col("action").isin("add", "drop"))
    logged = logged.select("list", "key", (F.col("action") == "add").alias("added"), "at")
    logged = logged.where("list IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL")
    by_time = logged.groupBy("list", "key", "at").agg(F.min("added").alias("added"))
    order = Window.partitionBy("list", "key").orderBy("at")
    turns = by_time.withColumn("was", F.coalesce(F.lag("added").over(order), F.lit(False))).where("added <> was")
    turns = turns.withColumn("until", F.lead("at").over(order))
    return turns.where("added").select("list", "key", F.col("at").alias("since"), "until")


def active_entries(captures: DataFrame, spans: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """The captures' columns with ``list`` and ``key``, a row for each entry that lists the URL at the
    time of the fetch: from ``since`` on and before ``until``. A capture without a time meets none."""
    captures = without(captures, ["list", "key"])
    few = spans.count() <= BROADCAST_INTERVALS
    right = spans.select("list", "key", "since", "until").toDF("__list", "__key", "__since", "__until")
    asked = captures.withColumn("__asked", F.explode(F.array_distinct(lookup_keys(quoted(url)))))
    open_then = (quoted(at) >= F.col("__since")) & (F.col("__until").isNull() | (quoted(at) < F.col("__until")))
    met = asked.join(F.broadcast(right) if few else right, (F.col("__asked") == F.col("__key")) & open_then)
    return met.select(*(quoted(c) for c in captures.columns), F.col("__list").alias("list"), F.col("__key").alias("key"))


def judge(captures: DataFrame, entries: DataFrame, blocking: str = "block", allowing: str = "allow", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """All captures with ``n_active``, ``reasons`` (``list=key``, sorted, comma-joined) and ``blocked``.

    A capture is blocked if an entry of the blocking list is active and no longer key of the allowing
    list is, nor one as long. Repeated captures are rows of their own; columns of these names are
    replaced. A NULL URL or time meets no entry and is not blocked.
    """
    captures = without(captures, ["n_active", "reasons", "blocked"])
    spans = intervals(entries).transform(saved)
    # A capture is its URL and time: each pair is judged once, however often it was fetched.
    asked = captures.select(quoted(url).alias("__url"), quoted(at).alias("__at")).distinct()
    met = active_entries(asked, spans, "__url", "__at")
    length = F.length("key") - F.instr("key", ":")

    def longest(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("list") == name, length)), F.lit(-1))

    marks = met.groupBy("__url", "__at").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.concat_ws("=", "list", "key")))).alias("reasons"),
        (longest(blocking) > longest(allowing)).alias("blocked"),
    )
    # A plain table, so that the join can split a URL that a large part of the captures has.
    marks = marks.withColumnsRenamed({"__url": "__u", "__at": "__t"}).transform(saved)
    both = captures.join(marks, (quoted(url) == F.col("__u")) & (quoted(at) == F.col("__t")), "left")
    return both.select(
        *(quoted(c) for c in captures.columns),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("reasons", F.lit("")).alias("reasons"),
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
    )
