"""Small string and number expressions shared by the other modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Python's ``str.strip()`` removes.
# Spark's one-argument ``trim`` removes blanks only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The line ends that Python's ``str.splitlines()`` knows.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def quoted(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(text: Column) -> Column:
    """Drop white space at both ends; linear in the text, no regex."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def strip_fence(text: Column) -> Column:
    """White space, then back-ticks, then white space again."""
    return strip(F.btrim(strip(text), F.lit("`")))


def round_2(value: Column) -> Column:
    """Round to 2 places from the exact binary value, ties to even.

    ``round`` and ``bround`` work on the shortest decimal print of a double, so
    they move 0.615 (stored just below) up. What comes after the point is scaled by
    2**60, which is exact from 2**-8 on, and less than that never makes a hundredth;
    whole hundredths and the rest are then told apart in decimals.
    """
    size = F.abs(value)
    whole = F.floor(size)
    unit = F.lit(2**60).cast("decimal(20,0)")
    scaled = ((size - whole) * F.lit(float(2**60))).cast("bigint").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    rest = scaled % unit
    hundredths = ((scaled - rest) / unit).cast("bigint")
    half = F.lit(2**59).cast("decimal(20,0)")
    up = (rest > half) | ((rest == half) & (hundredths % 2 == 1))
    exact = (whole * 100 + hundredths + up.cast("bigint")) / F.lit(100.0)
    # From 2**45 on there is less than a hundredth of room between two values.
    rounded = F.when(size < float(2**45), exact).otherwise(size)
    return F.when(value < 0, -rounded).otherwise(rounded)
