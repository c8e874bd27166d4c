"""A filter that tells which hashes a table holds, of one size whatever the table's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One bit for each hash: 16 MB. Beyond its capacity it lets more through, and loses nothing.
FILTER_BITS = 1 << 27
_PART = 4096  # bytes of one of Spark's bitmaps


def filter_of(hashes: DataFrame) -> np.ndarray:
    """The filter of a table's first column; at most 4,096 rows of 4 KB come to the driver."""
    at = F.pmod(F.col(hashes.columns[0]), F.lit(FILTER_BITS)) + 1  # Spark's bitmaps count from 1
    parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("part"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect():
        bits[(r["part"] - 1) * _PART : r["part"] * _PART] = np.frombuffer(r["bits"], np.uint8)
    return bits


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash whether the filter holds it, or one that falls on the same bit."""
    at = (hashes.view(np.int64) % FILTER_BITS).astype(np.int64)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
