"""Mixing sources to target weights, in DataFrame functions only.

The words of a source stand one after another and are cut into blocks of a fixed length. The mix is
a list of slots, each of which holds one block. The multinomial draw of an output shard's source
counts is taken given the totals, so that the targets hold to a word: the slots of all sources are
thrown into all places by one pseudorandom permutation, and a shard is a run of places. A source's
slots go through a permutation of its own to its blocks, and are joined with them by index.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import BLANKS, quoted, row_hash, saved, with_starts, without, word_count

#: Sources, one row each, are broadcast up to this many; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Slots made by one row before its expansion, so that a large source is dealt out.
SLOTS_AT_ONCE = 4_096


class Mix(NamedTuple):
    """``sources``: one row each, with targets. ``rows``: the documents' places in their source.
    ``slots``: shard, slot, sid, block, epoch, words (the first so many of the block count)."""

    sources: DataFrame
    rows: DataFrame
    slots: DataFrame
    block_words: int


def permuted(index: Column, size: Column, seed: Column, rounds: int = 24) -> Column:
    """``index`` under a pseudorandom permutation of 0 to ``size`` - 1: swap-or-not, which needs no
    walk to stay in range. Each round pairs up all indexes and swaps a pair or leaves it, by a bit."""

    def step(x: Column, r: Column) -> Column:
        turn = F.pmod(F.xxhash64(seed, r), size)
        other = F.pmod(turn - x, size)
        bit = F.xxhash64(seed, r, F.greatest(x, other)).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), step)


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row per source, by code point and NULL last, with weight and target.

    ``share`` times all words is dealt by weight; no target is above ``cap`` times its source, and
    what is over goes to the others by weight. With sources in the order of ``cap * size / weight``,
    those that stop are the first few: the level of the rest follows from sums over them.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    place = F.row_number().over(order) - 1
    chosen = F.array(*(F.lit(float(w)) for w in weights))[place % len(weights)]
    sums = sums.select("source", "source_size", place.alias("sid"), chosen.alias("weight"))
    most = F.col("source_size") * float(cap)
    by_level = Window.orderBy(most / F.col("weight"), "sid")
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    level = left / F.sum("weight").over(rest)
    sums = sums.withColumns({"__most": most, "__level": level})
    stops = F.col("__most") <= F.col("__level") * F.col("weight")
    # The level at the first source that doesn't stop holds for it and all after it.
    shared = F.min(F.when(~stops, F.struct(F.col("__most") / F.col("weight"), F.col("sid"), F.col("__level").alias("level")))).over(everything)
    target = F.when(stops, F.col("__most")).otherwise(F.least(shared["level"] * F.col("weight"), F.col("__most")))
    return sums.withColumn("target", target.cast("double")).drop("__most", "__level")


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 256,
    shard_slots: int = 1024,
    seed: int = 20,
) -> Mix:
    """Decide what the mix takes. Needs ``doc_id``, ``text`` and ``source``; other columns only tell
    rows apart.

    NULL is a source of its own. A text without words has size 0 and is never taken. Repeated rows
    are documents of their own. An empty table gives an empty mix. The sizes are written once to the
    folder of ``spark.checkpoint.dir``, so that texts are read once.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(docs).alias("row_hash")).transform(saved)
    sources = source_targets(sized, weights, share, cap).transform(saved)
    blocks = F.ceil(F.col("source_size") / block_words)
    words = F.round("target").cast("long")
    size = F.col("source_size")
    rounds = F.when(size > 0, F.floor(words / size)).otherwise(0).cast("long")
    last = words - rounds * size
    sources = sources.withColumns({"n_blocks": blocks.cast("long"), "words": words})
    sources = sources.withColumn("n_slots", (rounds * F.col("n_blocks") + F.ceil(last / block_words)).cast("long"))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("first_slot", F.coalesce(F.sum("n_slots").over(before), F.lit(0)).cast("long"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumn("all_slots", F.sum("n_slots").over(everything).cast("long")).transform(saved)
    small = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    named = small.select("sid", F.col("source").alias("__source"))
    rows = sized.join(named, sized.source.eqNullSafe(F.col("__source"))).drop("__source")
    rows = with_starts(rows, ["sid"], F.col("size"), "start")
    return Mix(sources, rows, _slots(sources, block_words, shard_slots, seed), block_words)


def _slots(sources: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    zero = F.lit(0).cast("long")
    step = F.lit(SLOTS_AT_ONCE).cast("long")
    taking = sources.where("n_slots > 0")
    runs = taking.withColumn("__from", F.explode(F.sequence(zero, F.col("n_slots") - 1, step)))
    # Dealt by a hash of the run, as the runs of a large source would else stay in one task; by a
    # number, as the rows are small before they are expanded and would be put together again.
    total = sources.agg(F.coalesce(F.max("all_slots"), F.lit(0))).first()[0]
    tasks = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (16 * SLOTS_AT_ONCE))
    runs = runs.repartition(tasks, "sid", "__from")
    stop = F.least(F.col("__from") + step, F.col("n_slots")) - 1
    slots = runs.withColumn("index", F.explode(F.sequence(F.col("__from"), stop)))
    index, blocks, size = F.col("index"), F.col("n_blocks"), F.col("source_size")
    inside, epoch = index % blocks, F.floor(index / blocks)
    # A source's last block may be short; it stays last, so that words add up without a look at it.
    full = F.floor(size / block_words)
    key = F.xxhash64(F.lit(seed), F.col("sid"), epoch)
    block = F.when(inside < full, permuted(inside, F.greatest(full, F.lit(1).cast("long")), key)).otherwise(inside)
    length = F.least(F.lit(block_words).cast("long"), size - inside * block_words)
    wanted = F.least(length, F.col("words") - epoch * size - inside * block_words)
    place = permuted(F.col("first_slot") + index, F.col("all_slots"), F.xxhash64(F.lit(seed), F.lit("places")))
    slots = slots.select("sid", epoch.cast("int").alias("epoch"), block.alias("block"), wanted.alias("words"), place.alias("place"))
    return slots.select(
        F.floor(F.col("place") / shard_slots).cast("long").alias("shard"),
        (F.col("place") % shard_slots).cast("int").alias("slot"),
        "sid", "block", "epoch", "words",
    )


def shard_counts(mix: Mix) -> DataFrame:
    """The drawn source counts: blocks of each source in each output shard."""
    named = mix.sources.select("sid", "source")
    return mix.slots.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("blocks")).join(named, "sid")


def taken_pieces(mix: Mix) -> DataFrame:
    """Every run of a document's words in a slot: the row's columns, shard, slot, and the words from
    ``from`` (0 for the document's first) to before ``until``."""
    width = F.lit(mix.block_words).cast("long")
    start, end = F.col("start"), F.col("start") + F.col("size")
    rows = mix.rows.where("size > 0")
    held = rows.withColumn("block", F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width))))
    # Spark takes the slots for as few as the sources they are expanded from, and would broadcast them.
    pieces = held.join(mix.slots.hint("merge"), ["sid", "block"])
    at = F.col("block") * width
    begin, stop = F.greatest(start, at), F.least(end, at + F.col("words"))
    return pieces.where(begin < stop).withColumns({"from": begin - start, "until": stop - start})


def taken_words(mix: Mix) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    key = ["doc_id", "row_hash", "sid", "start"]
    none = F.lit(0).cast("long")
    # A document with words is known by its place; one without has none, and is never taken.
    unread = mix.rows.where("size > 0").select(*key, "size", none.alias("taken"))
    read = taken_pieces(mix).select(*key, "size", (F.col("until") - F.col("from")).alias("taken"))
    sums = unread.unionByName(read).groupBy(*key, "size").agg(F.sum("taken").alias("taken"))
    sums = sums.unionByName(mix.rows.where("size = 0").select(*key, "size", none.alias("taken")))
    targets = mix.sources.select("sid", "source_size", "target")
    targets = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    return sums.join(targets, "sid").select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, mix: Mix, text: str = "text") -> DataFrame:
    """The mix itself: one row per piece, with the document's other columns, ``text`` cut to the
    piece's words with the blanks after them, ``shard`` and ``slot``. Columns with these names are
    replaced, and ``n_chars``, where there is one, is that of the piece."""
    docs = docs.withColumn("__row_hash", row_hash(docs))
    docs = without(docs, ["shard", "slot"])
    cuts = taken_pieces(mix).groupBy(F.col("row_hash").alias("__row"), F.col("start").alias("__start"))
    cuts = cuts.agg(F.collect_list(F.struct("shard", "slot", "from", "until")).alias("__cuts"))
    # A list holds the pieces of one copy of a row, as many as its own blocks. The second condition,
    # implied by the first, has the rows shuffled for the join, which then can split a row of many copies.
    same = (F.col("__row_hash") == F.col("__row")) & (F.xxhash64("__row_hash") == F.xxhash64("__row"))
    whole = docs.dropDuplicates(["__row_hash"]).join(cuts, same)
    parts = F.split(F.regexp_replace(quoted(text), f"^[{BLANKS}]+", ""), f"(?<=[{BLANKS}])(?=[^{BLANKS}])")
    whole = whole.withColumn("__parts", parts)
    whole = whole.withColumn(
        "__cut",
        F.explode(F.transform("__cuts", lambda c: F.struct(
            c["shard"].alias("shard"), c["slot"].alias("slot"),
            F.concat_ws("", F.slice("__parts", (c["from"] + 1).cast("int"), (c["until"] - c["from"]).cast("int"))).alias("text"),
        ))),
    )
    whole = whole.withColumn(text, F.col("__cut.text"))
    for name in docs.columns:
        if name.lower() == "n_chars":
            whole = whole.withColumn(name, F.char_length(quoted(text)).cast(docs.schema[name].dataType))
    kept = [quoted(c) for c in docs.columns if c != "__row_hash"]
    return whole.select(*kept, F.col("__cut.shard").alias("shard"), F.col("__cut.slot").alias("slot"))
