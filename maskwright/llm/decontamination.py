"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window of an item is a set of shingles, its pairs of words, whose containment has to be whole: so one
of them is the necessary prefix, the one that the corpus has least often. A document meets a window
only where it has that pair; the pair's place in the window fixes where the window would begin, the
lengths tell whether it fits, and last the words themselves are compared, over the window's size.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import quoted, saved

#: What parts words, as the contract states it.
BETWEEN_WORDS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: The same before A-Z are lowered, which then are letters of words.
BETWEEN_WRITTEN_WORDS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A benchmark of up to so many windows is broadcast (some 200 bytes each); a larger one is joined by
#: a shuffle of the documents' words.
BROADCAST_WINDOWS = 200_000
#: Places to look at, some 40 bytes each, are broadcast up to this many; beyond it the texts are shuffled.
BROADCAST_MEETINGS = 200_000


def words_of(text: Column) -> Column:
    """The words as they are written; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BETWEEN_WRITTEN_WORDS}]+"), "")


def exact_words(text: Column) -> Column:
    """The words with A-Z as a-z. That takes a step per character, so it is for few texts; the many are
    looked through in lower case, word by word, which finds all that is equal here and a little more."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(plain, f"[{BETWEEN_WORDS}]+"), "")


class Hits(NamedTuple):
    """``hits``: key, text_hash, begin (word number from 0), length, window_id; each once. ``items``:
    window_id and the items that have the window."""

    hits: DataFrame
    items: DataFrame


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = 10) -> DataFrame:
    """``item, window`` (an array of words): all runs of ``size`` words, or the whole of a shorter
    item; none of an item without words."""
    words = items.select(quoted(key).alias("item"), exact_words(quoted(text)).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - size + 1, F.lit(1))
    starts = F.explode(F.sequence(F.lit(1), last))
    words = words.withColumn("at", starts)
    return words.select("item", F.slice("words", F.col("at"), size).alias("window")).distinct()


def _pairs(words: Column) -> Column:
    """Each word with the next; the last one has none."""
    return F.arrays_zip(words.alias("word"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("next"))


def window_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", size: int = 10) -> Hits:
    """Where windows of the items occur in the documents.

    Rows are told apart by key and text; repeated rows have the same hits once. A NULL key is a key.
    """
    owned = item_windows(items, size=size).withColumn("window_id", F.xxhash64("window")).transform(saved)
    windows = owned.select("window_id", "window").dropDuplicates(["window_id"]).transform(saved)
    hint = F.broadcast if windows.count() <= BROADCAST_WINDOWS else (lambda df: df)
    rows = docs.select(quoted(key).alias("key"), F.xxhash64(quoted(text)).alias("text_hash"), words_of(quoted(text)).alias("words"))
    rows = rows.select("key", "text_hash", F.size("words").alias("n"), F.posexplode(_pairs(F.col("words"))).alias("at", "pair"))
    low = (F.lower("pair.word").alias("word"), F.lower("pair.next").alias("next"))
    said = rows.select("key", "text_hash", "n", "at", *low)

    # Shingles of a window are its pairs of words; a window of one word is its own only shingle.
    length = F.size("window")
    parts = windows.select("window_id", length.alias("length"), F.posexplode(_pairs(F.col("window"))).alias("offset", "pair"))
    parts = parts.select("window_id", "length", "offset", *low)
    single = parts.where("length = 1").drop("next")
    parts = parts.where("next IS NOT NULL").transform(saved)
    vocabulary = hint(parts.select("word", "next").distinct())
    counts = said.join(vocabulary, ["word", "next"], "left_semi").groupBy("word", "next").agg(F.count(F.lit(1)).alias("count"))
    # A pair that no document has makes its window impossible.
    ranked = parts.join(counts, ["word", "next"], "left")
    rarest = Window.partitionBy("window_id").orderBy(F.coalesce("count", F.lit(0)), "word", "next", "offset")
    prefix = ranked.withColumn("place", F.row_number().over(rarest)).where("place = 1 AND count IS NOT NULL")
    prefix = prefix.select("word", "next", "window_id", "offset", "length").transform(saved)

    begin = F.col("at") - F.col("offset")
    fits = (begin >= 0) & (begin + F.col("length") <= F.col("n"))
    met = said.join(hint(prefix), ["word", "next"]).where(fits).select("key", "text_hash", begin.alias("begin"), "length", "window_id")
    if not single.isEmpty():
        alone = said.join(hint(single), "word").select("key", "text_hash", F.col("at").alias("begin"), "length", "window_id")
        met = met.unionByName(alone)
    return Hits(_verified(met.transform(saved), docs, key, text), owned.select("window_id", "item"))


def _verified(met: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Of the meetings those whose words, all of them and in order, have the hash that the window is
    known by, of 64 bits. Only texts with meetings are read for it, and each is cut into words once."""
    doc = met.groupBy(F.col("key").alias("k"), F.col("text_hash").alias("h")).agg(F.collect_set(F.struct("begin", "length", "window_id")).alias("met"))
    doc = doc.transform(saved)  # a list grows with its document only
    few = met.count() <= BROADCAST_MEETINGS
    same = quoted(key).eqNullSafe(F.col("k")) & (F.xxhash64(quoted(text)) == F.col("h"))
    texts = docs.select(quoted(key), quoted(text)).join(F.broadcast(doc) if few else doc, same)
    texts = texts.select("k", "h", "met", exact_words(quoted(text)).alias("words"))
    cut = F.transform("met", lambda m: F.struct(m.alias("m"), F.xxhash64(F.slice("words", m["begin"] + 1, m["length"])).alias("found")))
    cut = texts.select("k", "h", F.explode(cut).alias("c")).where("c.found = c.m.window_id")
    return cut.select(F.col("k").alias("key"), F.col("h").alias("text_hash"), "c.m.begin", "c.m.length", "c.m.window_id").distinct()


def _covered(spans: Column) -> Column:
    """How many words lie in any of the spans, which come by begin."""

    def further(so_far: Column, span: Column) -> Column:
        end = span["begin"] + span["length"]
        fresh = F.greatest(end - F.greatest(span["begin"], so_far["end"]), F.lit(0))
        return F.struct(F.greatest(end, so_far["end"]).alias("end"), (so_far["words"] + fresh).alias("words"))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))
    return F.aggregate(spans, start, further, lambda so_far: so_far["words"])


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", size: int = 10) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated.

    ``n_hit`` counts the words inside any occurrence of a window, ``n_items`` the items with
    occurring windows. NULL and wordless texts have no words; wordless items have no windows; equal
    items count each; an item without an id hits but has no name to count. Without items nothing is
    hit. Item ids are sorted as strings.
    """
    found = window_hits(docs, items, key, text, size)
    hits = found.hits.transform(saved)  # several sums are taken from it
    doc = ["key", "text_hash"]
    spans = hits.groupBy(*doc).agg(F.collect_set(F.struct("begin", "length")).alias("spans"))
    spans = spans.select(*doc, _covered(F.sort_array("spans")).alias("n_hit"))
    owners = hits.select(*doc, "window_id").distinct().join(found.items, "window_id")
    owners = owners.select(*doc, F.col("item").cast("string").alias("item")).distinct()
    owners = owners.groupBy(*doc).agg(F.sort_array(F.collect_list("item")).alias("items"))
    marks = spans.join(owners, (spans["key"].eqNullSafe(owners["key"])) & (spans["text_hash"] == owners["text_hash"]))
    marks = marks.select(spans["key"].alias("k"), spans["text_hash"].alias("h"), "n_hit", "items")
    rows = docs.select(
        quoted(key).alias("key"),
        F.xxhash64(quoted(text)).alias("text_hash"),
        F.size(words_of(quoted(text))).cast("long").alias("n_words"),
    )
    rows = rows.join(marks, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left")
    none = F.array().cast("array<string>")
    names = F.coalesce("items", none)
    return rows.select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", size: int = 10) -> DataFrame:
    """The documents in which no window occurs, with their columns as they are. A document with a
    NULL key is judged by its text as any other."""
    hits = window_hits(docs, items, key, text, size).hits
    marks = hits.select(F.col("key").alias("__k"), F.col("text_hash").alias("__h")).distinct()
    same = quoted(key).eqNullSafe(F.col("__k")) & (F.xxhash64(quoted(text)) == F.col("__h"))
    return docs.join(marks, same, "left_anti")
