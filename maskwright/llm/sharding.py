"""Sharding by rendezvous hashing of record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import quoted, with_starts, without


def rendezvous(key: Sequence[Column], weights: Mapping[int, float]) -> Column:
    """The shard with the least ``-ln(u) / weight``, ``u`` drawn from the hash of key and shard.

    Each shard bids for each key by itself: a shard that joins takes rows only into itself, one that
    leaves gives up only its own, and shares follow the weights. A NULL key is a key of its own.
    """
    if not weights or any(not w > 0 for w in weights.values()):
        raise ValueError("Shards need weights above 0.")
    parts = [c for k in key for c in (k.isNull(), k)]
    base = F.xxhash64(*parts)

    def bid(shard: int, weight: float) -> Column:
        drawn = F.xxhash64(base, F.lit(int(shard)))
        u = (F.shiftrightunsigned(drawn, 11).cast("double") + 0.5) / float(2**53)
        return F.struct((-F.log(u) / float(weight)).alias("bid"), F.lit(int(shard)).alias("shard"))

    return F.array_min(F.array(*(bid(s, w) for s, w in sorted(weights.items()))))["shard"]


def shard_rows(
    df: DataFrame,
    key: Sequence[str],
    weights: Mapping[int, float],
    grown: Mapping[int, float] | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """All rows with ``shard`` and ``slot``, and ``grown_shard``, the shard under other weights.

    ``slot`` numbers the rows of a shard from 0 without gaps, in the order of a hash of the row. Rows
    equal in all columns get slots in a row. Columns of ``df`` with these names are replaced. An
    empty table gives an empty table. Rows whose keys are equal, NULL included, share a shard.
    """
    df = without(df, ["shard", "slot", "grown_shard"])
    keys = [quoted(k) for k in key]
    df = df.withColumn("shard", rendezvous(keys, weights))
    numbered = with_starts(df, ["shard"], F.lit(1), "slot", buckets)
    after = rendezvous(keys, grown) if grown else F.lit(None).cast("int")
    return numbered.withColumn("grown_shard", after)


def law_by_key(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The result of query ``op4_rendezvous_shards``; a NULL text has no bytes and the CRC of none."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    even = {s: 1.0 for s in range(shards)}
    return shard_rows(rows, ["doc_id"], even, even | {shards: 1.0})
