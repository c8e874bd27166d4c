"""Tables that are appended to and merged beside their writers and readers.

A table is a folder. What is appended is Parquet files in it, as Spark's own append writes them. A
merge folds them into a snapshot in a hidden folder and then names, in a manifest of the next number,
the snapshot's files and the appended files it holds; the manifest appears by one rename. Readers
take the newest manifest's files and all appended files that it doesn't name, so that rows appended
while a merge runs are neither lost nor read twice, and a merge that fails leaves nothing to read.

A snapshot is dealt into buckets by a hash of the key. A merge rewrites those that appended rows fall
into and takes the others' files as they are. A bucket has as many files as its size asks for, each
sorted by the key. A large merge goes bucket by bucket, so that what is shuffled at a time is a bucket's
rows, not the table's. Files are compressed by zstd, as names by content halve under it and not under
Spark's default.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwright.functions.text import quoted
from maskwright.operators.folders import bytes_of, delete, exists, files_in, full_path, no_glob, read_text, rename_new, write_text
from maskwright.operators.shared import release

_VERSIONS, _SNAPSHOTS = "_versions", "_snapshots"
#: Buckets of a snapshot unless the caller says otherwise; a table keeps those it began with.
BUCKETS = 16
#: Stored bytes that are merged, or folded, at once.
SLICE_BYTES = 512 * 1024 * 1024
#: Steps of a large merge at most. Each reads the appended files, so that there are not more the larger they are.
MOST_STEPS = 16
COMPRESSION = "zstd"


class Version(NamedTuple):
    """``files`` of the snapshot and appended files it has ``covered``, by their names in the folder;
    ``buckets`` of the snapshot, 0 before the first."""

    number: int = 0
    files: tuple[str, ...] = ()
    covered: tuple[str, ...] = ()
    buckets: int = 0


class Conflict(RuntimeError):
    """Another merge was published first; draft anew."""


class Draft(NamedTuple):
    """A written snapshot that readers don't see yet."""

    path: str
    version: Version


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", COMPRESSION).parquet(path)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    names = files_in(spark, f"{path.rstrip('/')}/{_VERSIONS}")
    return sorted(int(n.rsplit("/", 1)[-1].split(".")[0]) for n in names if n.endswith(".json"))


def _manifest(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/{_VERSIONS}/{number:012d}.json"


def _version(spark: SparkSession, path: str, number: int) -> Version:
    found = json.loads(read_text(spark, _manifest(path, number)))
    return Version(number, tuple(found["files"]), tuple(found["covered"]), found["buckets"])


def current(spark: SparkSession, path: str) -> Version:
    """The newest version; number 0, without files, before the first merge."""
    numbers = _numbers(spark, path)
    return _version(spark, path, numbers[-1]) if numbers else Version()


def _names(spark: SparkSession, path: str, files: Sequence[str]) -> list[str]:
    root = full_path(spark, path).rstrip("/")
    return [f[len(root) + 1 :] for f in files]


def appended_since(spark: SparkSession, path: str, version: Version) -> list[str]:
    """Names of the appended files that a version's snapshot doesn't hold."""
    held = set(version.covered)
    return [n for n in _names(spark, path, files_in(spark, path)) if n not in held]


def _rows(spark: SparkSession, path: str, names: Sequence[str], schema: StructType) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(no_glob(f"{path.rstrip('/')}/{n}") for n in names))


def _files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files that a reader takes now."""
    while True:
        version = current(spark, path)
        names = [*version.files, *appended_since(spark, path, version)]
        # Appended files may have been cleared away after a merge in between.
        if current(spark, path).number == version.number:
            return names


def _bytes(spark: SparkSession, path: str, names: Sequence[str]) -> int:
    return bytes_of(spark, [f"{path.rstrip('/')}/{n}" for n in names])


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All rows: the snapshot's, and those appended since. A folder that doesn't exist has none."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return _rows(spark, path, _files(spark, path), kind)


def slices_for(spark: SparkSession, path: str, most: int) -> int:
    """In how many slices to go through a table for ``SLICE_BYTES`` at a time, ``most`` of them."""
    return max(1, min(most, -(-_bytes(spark, path, _files(spark, path)) // SLICE_BYTES)))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def draft_merge(
    spark: SparkSession, path: str, schema: StructType | str, key: str, merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS
) -> Draft | None:
    """Write the next snapshot; None if nothing was appended since the last.

    ``merge`` gets the rows of some keys, all of each, and returns what is kept of them in the same
    columns. It sees snapshot rows and appended ones alike, so it must give the same whether rows come
    merged before or not. Rows with a NULL key are one key.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    version = current(spark, path)
    fresh = appended_since(spark, path, version)
    if not fresh:
        return None
    number = version.buckets or buckets
    bucket = bucket_of(quoted(key), number)
    added = _rows(spark, path, fresh, kind)
    touched = sorted(r[0] for r in added.select(bucket).distinct().collect())  # at most one row per bucket
    inside = lambda name: int(name.split("/__bucket=")[1].split("/")[0])
    folder = f"{_SNAPSHOTS}/{uuid.uuid4().hex}"
    target = f"{path.rstrip('/')}/{folder}"
    large = _bytes(spark, path, [*fresh, *(n for n in version.files if inside(n) in touched)]) > SLICE_BYTES
    steps = min(len(touched), MOST_STEPS) if large else 1
    for some in (touched[i::steps] for i in range(steps)):
        old = [n for n in version.files if inside(n) in some]
        new = added.where(bucket.isin(some)) if steps > 1 else added
        rows = merge(_rows(spark, path, old, kind).unionByName(new)).select(*(quoted(c) for c in kind.names))
        out = rows.withColumn("__bucket", bucket)
        if not large or len(some) > 1:
            # A large bucket is cut into files of a size that one task can sort, small ones share a task. The
            # rows of one large bucket alone stay in the parts that the merge left them in.
            out = out.hint("rebalance", F.col("__bucket"))
        out = out.sortWithinPartitions("__bucket", quoted(key))
        out.write.mode("append").option("compression", COMPRESSION).partitionBy("__bucket").parquet(target)
        if large:
            release(spark)
    written = [n for n in _names(spark, path, files_in(spark, target, nested=True)) if "/__bucket=" in n]
    kept = [n for n in version.files if inside(n) not in touched]
    there = set(_names(spark, path, files_in(spark, path)))
    covered = [n for n in version.covered if n in there]  # the others have been cleared away
    return Draft(path, Version(version.number + 1, tuple(kept + written), tuple(covered + fresh), number))


def publish(spark: SparkSession, draft: Draft) -> Version:
    """Show a draft to readers, by one rename. ``Conflict`` if another was published meanwhile: the
    draft was made of an older snapshot, and is dropped."""
    path, version = draft
    text = json.dumps({"files": version.files, "covered": version.covered, "buckets": version.buckets})
    aside = f"{path.rstrip('/')}/{_VERSIONS}/.{uuid.uuid4().hex}"
    write_text(spark, aside, text)
    if not rename_new(spark, aside, _manifest(path, version.number)):
        delete(spark, aside)
        raise Conflict(f"Version {version.number} of {path} is there already.")
    return version


def merge_table(
    spark: SparkSession, path: str, schema: StructType | str, key: str, merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS, tries: int = 3
) -> Version:
    """Draft and publish, anew if another merge came first; returns the version readers now see."""
    for last in range(tries):
        draft = draft_merge(spark, path, schema, key, merge, buckets)
        if draft is None:
            return current(spark, path)
        try:
            return publish(spark, draft)
        except Conflict:
            if last == tries - 1:
                raise
    raise ValueError("At least one try is needed.")


def clear_away(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete what no version needs but those before the last ``keep`` others: appended files that their
    snapshots hold, snapshots, manifests. Returns the names. A reader that began with a version that old
    would fail, so leave as many as live at once. A draft that isn't published counts as needed by
    nobody: don't clear while a merge runs."""
    numbers = _numbers(spark, path)
    if len(numbers) <= keep:
        return []
    recent = [_version(spark, path, n) for n in numbers[-1 - keep :]]
    needed = {f for v in recent for f in v.files}
    folders = _names(spark, path, files_in(spark, f"{path.rstrip('/')}/{_SNAPSHOTS}", nested=True))
    there = set(_names(spark, path, files_in(spark, path)))
    gone = [n for n in folders if n not in needed]
    gone += [n for n in recent[0].covered if n in there]
    for name in gone:
        delete(spark, f"{path.rstrip('/')}/{name}")
    for number in numbers[: -1 - keep]:
        delete(spark, _manifest(path, number))
    return gone


def has_table(spark: SparkSession, path: str) -> bool:
    return exists(spark, path) and bool(current(spark, path).files or files_in(spark, path))
