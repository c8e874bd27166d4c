"""Small helpers the operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What parts words, as the contracts state it.
BLANKS = r"\x20\x09-\x0D"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, as in tests, a folder of this
    machine is set, but only if this machine is all there is."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach.")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read from there: lost executors cost no upstream work,
    and what follows sees the same rows however often it runs."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Without the columns that the caller is about to add; names are compared as Spark does."""
    taken = {n.lower() for n in names}
    return df.select(*(quoted(c) for c in df.columns if c.lower() not in taken))


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """64 bits of all columns. A null counts as a value of its own, in whichever column it stands."""
    parts = []
    for field in df.schema:
        value = quoted(field.name)
        plain = F.to_json(F.struct(value)) if "map<" in field.dataType.simpleString() else value
        parts += [value.isNull(), plain]
    return F.xxhash64(F.lit(seed), *parts)


def word_count(text: Column) -> Column:
    """Number of runs of other characters than blanks; 0 for NULL."""
    pieces = F.size(F.split(text, f"[{BLANKS}]+"))
    first = text.rlike(f"^[{BLANKS}]").cast("int")
    last = F.substring(text, -1, 1).rlike(f"[{BLANKS}]").cast("int")
    return F.when(text.rlike(f"[^{BLANKS}]"), pieces - first - last).otherwise(0).cast("long")


def with_starts(df: DataFrame, group: Sequence[str], weight: Column, start: str, buckets: int = 1024) -> DataFrame:
    """Add ``start``: the sum of ``weight`` over the rows of the same group that come before. Group
    columns are not NULL.

    Rows stand in the order of their content's hash, so that a rerun agrees. No task orders a whole
    group: it is dealt into ``buckets`` by that hash, whose sums are added up apart (a table of
    ``groups x buckets`` rows). Rows that are equal in all columns are counted before the shuffle and
    spread out again after it, so that many copies of one row are no hot key.
    """
    names = df.columns
    rows = df.groupBy(*(quoted(c) for c in names)).agg(F.count(F.lit(1)).alias("__copies"))
    rows = rows.withColumns({"__hash": row_hash(df), "__weight": weight.cast("long")})
    bucket = lambda hashed: F.pmod(hashed, F.lit(buckets)).cast("int")
    rows = rows.withColumn("__bucket", bucket(F.col("__hash")))
    keys = [quoted(g) for g in group]
    # Of each row only group, bucket and weight are added up; the rows themselves are shuffled once.
    sums = df.groupBy(*(k.alias(f"__g{i}") for i, k in enumerate(keys)), bucket(row_hash(df)).alias("__b"))
    sums = sums.agg(F.sum(weight.cast("long")).alias("__sum"))
    groups = [F.col(f"__g{i}") for i in range(len(keys))]
    before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    same = F.col("__bucket") == F.col("__b")
    for k, g in zip(keys, groups, strict=True):
        same &= k == g
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__hash")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.col("__copies") * F.col("__weight")).over(inside), F.lit(0))
    rows = rows.withColumn("__inside", first).join(sums, same)
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    place = F.col("__base") + F.col("__inside") + F.col("__copy") * F.col("__weight")
    return rows.select(*(quoted(c) for c in names), place.cast("long").alias(start))
