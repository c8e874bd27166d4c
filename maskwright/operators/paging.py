"""Row numbers and pages in a stable order.

A stored Parquet dataset has an order of its own: part number, then row within the
file. Files do not change, so a page read twice is the same twice. Numbering needs
the row count of every file (from the footers) and nothing else; no window over
the rows, no sort of stored data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.text import quoted
from maskwright.operators import versions
from maskwright.operators.folders import no_glob as _no_glob

# Rows of a page.
DEFAULT_PAGE_SIZE = 100
MAX_PAGE_SIZE = 1000

# Files whose offsets are broadcast at once: a path and a number each, some 25 MB.
FILES_AT_ONCE = 100_000

# A range of rows that holds a page is sorted once it has no more rows than these.
ROWS_TO_SORT = 250_000
# Rows that cut a range into parts, whose rows are counted.
CUTS = 64


# --- counts ----------------------------------------------------------------


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def rows_per_file(df: DataFrame) -> DataFrame:
    """``(file_name, rows)`` of a file-based DataFrame. Reads no column."""
    return df.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, rows, first_row)`` of a stored dataset in its own order.

    The window runs over one row per file, a list the driver holds anyway to plan
    a scan. Part and chunk numbers are compared as numbers: from 100,000 files on
    their names no longer sort that way.
    """
    return _offsets(spark.read.parquet(_no_glob(path)))


def _offsets(df: DataFrame) -> DataFrame:
    files = df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("rows"))
    name = F.element_at(F.split("file_path", "/"), -1)
    order = Window.orderBy(
        F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("bigint").asc_nulls_last(),
        F.regexp_replace(name, r"-c\d+\..*$", ""),
        F.regexp_extract(name, r"-c(\d+)\.", 1).try_cast("bigint"),
        "file_path",
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first_row = F.coalesce(F.sum("rows").over(before), F.lit(0))
    return files.select("file_path", "rows", first_row.alias("first_row"))


# --- numbering -------------------------------------------------------------


ROW_ID = "row_id"


def _require_free(df: DataFrame, row_id: str) -> None:
    if row_id.lower() in (name.lower() for name in df.columns):
        raise ValueError(f"The table has a column '{row_id}' already; name the numbers otherwise.")


# One row per file of a stored dataset: a table kept beside it, and extended as files are added.
INDEX_SCHEMA = "file_path string, rows bigint, first_row bigint"


def _new_offsets(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """The offsets of the files that an index doesn't know, after those it does."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_no_glob(path))
    there = there.select(F.col("_metadata.file_path").alias("file_path"))
    gone = known.join(there, "file_path", "left_anti").limit(1).collect()
    if gone:
        raise ValueError(f"The index has a file that is no longer in {path}: {gone[0].file_path}")
    names = [r.file_path for r in there.join(known, "file_path", "left_anti").collect()]
    if not names:
        return known.limit(0)
    before = known.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    # Of a new index all files are asked, of an older one those it lacks.
    source = [_no_glob(path)] if not before[1] else [_no_glob(unquote(n)) for n in names]
    fresh = _offsets(spark.read.parquet(*source))
    return fresh.withColumn("first_row", F.col("first_row") + F.lit(before[0]))


def extend_offsets(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """The stored index of a dataset's files, ``file_path, rows, first_row``, brought up to date.

    Footers are read of those files only that the index doesn't know; their rows are numbered after all
    that it does, in the files' own order, so that a row keeps its number for good. Files are compared by
    two lists of names. A file that is gone is an error: numbers after it would be wrong. One writer at a
    time extends an index; ``merge_offsets`` folds its many small files into few.
    """
    known = versions.read(spark, index_path, INDEX_SCHEMA)
    fresh = _new_offsets(spark, path, known)
    if not fresh.isEmpty():
        versions.append(fresh, index_path)
    return versions.read(spark, index_path, INDEX_SCHEMA)


def merge_offsets(spark: SparkSession, index_path: str) -> None:
    versions.merge_table(spark, index_path, INDEX_SCHEMA, "file_path", DataFrame.distinct)


def with_row_ids(spark: SparkSession, path: str, row_id: str = ROW_ID, offsets: DataFrame | None = None) -> DataFrame:
    """A stored dataset with a row number, from 0 without gaps, in its own order.

    The number is the file's first row plus the reader's row index: a map-side join
    to one row per file. Of very many files, so many at once that their offsets stay
    small: each such run of files is scanned by itself, and no row is ever shuffled.
    Without a stored index of the ``offsets``, the footers are read once, here. Of a
    dataset that grows, rows of files that the index doesn't know are left out.
    """
    if offsets is None:
        offsets = file_offsets(spark, path).persist()
    offsets = offsets.select(F.col("file_path").alias("__file"), "first_row")
    rows = dataset(spark, path)
    _require_free(rows, row_id)
    columns = [quoted(name) for name in rows.columns]
    rows = rows.select(
        "*", F.col("_metadata.file_path").alias("__file_path"), F.col("_metadata.row_index").alias("__index")
    )
    place = F.row_number().over(Window.orderBy("__file"))
    ends = offsets.withColumn("__place", place).where(F.col("__place") % FILES_AT_ONCE == 0)
    ends = [None, *sorted(r[0] for r in ends.select("__file").collect()), None]
    parts = []
    for after, last in zip(ends, ends[1:], strict=False):

        def within(name: str, after: str | None = after, last: str | None = last) -> Column:
            path_of = F.col(name)
            lower = F.lit(True) if after is None else path_of > after
            return lower if last is None else lower & (path_of <= last)

        some = F.broadcast(offsets.where(within("__file")))
        numbered = rows.where(within("__file_path")).join(some, F.col("__file_path") == F.col("__file"))
        parts.append(numbered.select((F.col("first_row") + F.col("__index")).alias(row_id), *columns))
    return reduce(DataFrame.unionByName, parts)


class SortKey(NamedTuple):
    """A column to sort by: NULLs come first, or last if it descends."""

    name: str
    descending: bool = False

    @property
    def order(self) -> Column:
        return F.desc(quoted(self.name)) if self.descending else F.asc(quoted(self.name))


def sort_keys(order_by: Sequence[str | SortKey]) -> list[SortKey]:
    return [SortKey(*key) if isinstance(key, tuple) else SortKey(key) for key in order_by]


def in_order(df: DataFrame, order_by: Sequence[str | SortKey], unique: bool = False) -> DataFrame:
    """Sorted by the keys over all partitions, without a hot range.

    A range sort sends all rows with the same keys to one task. Unless the keys are
    said to be unique, the rows' content and the partition they come from break
    ties, so that neither a frequent key nor a row with many copies ends up whole in
    one range. Both are the same when a lost task is run again.
    """
    keys = [key.order for key in sort_keys(order_by)]
    if unique:
        return df.orderBy(*keys)
    return (
        df.withColumns({"__content": _content(df), "__from": F.spark_partition_id()})
        .orderBy(*keys, "__content", "__from")
        .drop("__content", "__from")
    )


def _content(df: DataFrame) -> Column:
    """A hash of all columns; those that cannot be hashed count by their JSON."""

    def hashable(field: T.StructField) -> Column:
        kind = field.dataType.simpleString()
        cell = quoted(field.name)
        return F.to_json(F.struct(cell)) if "map<" in kind or "variant" in kind else cell

    return F.xxhash64(*(c for f in df.schema for c in (quoted(f.name).isNull(), hashable(f))))


def number_rows(
    df: DataFrame,
    order_by: Sequence[str | SortKey],
    path: str,
    row_id: str = ROW_ID,
    unique: bool = False,
) -> DataFrame:
    """Any DataFrame with a row number in the order of its keys.

    Sorts once, into a table at ``path``, which is the caller's to keep and to drop.
    The written table also keeps the numbers stable when an executor is lost later.
    """
    _require_free(df, row_id)
    in_order(df, order_by, unique).write.parquet(path)
    return with_row_ids(df.sparkSession, path, row_id)


# --- pages -----------------------------------------------------------------


def page_size_of(page_size: int) -> int:
    if page_size < 1:
        raise ValueError(f"The page size must be at least 1, not {page_size}.")
    return min(page_size, MAX_PAGE_SIZE)


def pages_in(total_rows: int, page_size: int) -> int:
    return max(1, -(-total_rows // page_size))


def page_counters(df: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One row: ``total_rows, page, page_size, total_pages``."""
    size = page_size_of(page_size)
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows",
        F.lit(page).alias("page"),
        F.lit(size).alias("page_size"),
        F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total_rows") / size)).alias("total_pages"),
    )


def _bounds(page: int, page_size: int, total_rows: int) -> tuple[int, int]:
    size = page_size_of(page_size)
    pages = pages_in(total_rows, size)
    if not 1 <= page <= pages:
        raise ValueError(f"There is no page {page}; the table has pages 1 to {pages}.")
    return (page - 1) * size, min(page * size, total_rows)


def page(
    numbered: DataFrame,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    total_rows: int | None = None,
    row_id: str = ROW_ID,
) -> DataFrame:
    """One page of a table that has row numbers.

    A range of numbers: on a table stored with them the scan skips the row groups
    outside. The row count may come from the run record.
    """
    if total_rows is None:
        total_rows = numbered.count()
    first, end = _bounds(page, page_size, total_rows)
    number = quoted(row_id)
    return numbered.where((number >= first) & (number < end)).orderBy(number)


def sorted_page(
    df: DataFrame,
    order_by: Sequence[str | SortKey],
    page_number: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    total_rows: int | None = None,
    row_id: str = ROW_ID,
    unique: bool = False,
) -> DataFrame:
    """One page of a table that is not stored in order, with row numbers.

    The table is neither sorted nor written. A few of its rows, taken at random, cut
    its order into ranges; the rows of each are counted in one scan of the keys; and
    the range that holds the page is cut again until it is small enough to be sorted.
    A row finds its range by a binary search among them. That costs a scan for each
    factor of ``CUTS`` above ``ROWS_TO_SORT`` rows, for any page. Which rows make the cuts doesn't change the outcome. For many pages of a
    table, store its numbers once instead.

    Ties are broken by a hash of the row's content, unless the keys are ``unique``;
    rows that are equal in all columns may stand for each other.
    """
    _require_free(df, row_id)
    if total_rows is None:
        total_rows = df.count()
    first, end = _bounds(page_number, page_size, total_rows)
    columns = [quoted(name) for name in df.columns]
    keys = sort_keys(order_by)
    if not unique:
        df = df.withColumn("__content", _content(df))
        keys.append(SortKey("__content"))
    rows = _rows_between(df, keys, total_rows, first, end)
    # A window over the rows of the page alone.
    number = F.row_number().over(Window.orderBy(*(k.order for k in keys))) + F.lit(first - 1).cast("bigint")
    return rows.select(number.alias(row_id), *columns).orderBy(quoted(row_id))


def _rows_between(df: DataFrame, keys: list[SortKey], total: int, first: int, end: int) -> DataFrame:
    """The rows ``first`` to before ``end``, of ``total``, in the order of the keys."""
    if first >= end:
        return df.limit(0)
    order = [key.order for key in keys]
    if total <= ROWS_TO_SORT:
        return df.orderBy(*order).offset(first).limit(end - first)
    names = [quoted(key.name) for key in keys]
    rows = df.select(*names)
    drawn = rows.sample(min(1.0, 8.0 * CUTS / total)).limit(16 * CUTS).distinct().orderBy(*order).collect()
    if not drawn:  # an unlucky draw, or no rows any more
        drawn = rows.limit(CUTS).distinct().orderBy(*order).collect()
    if not drawn:
        raise ValueError(f"The table is empty, but was said to have {total} rows here.")
    cuts = [tuple(r) for r in drawn][:: -(-len(drawn) // CUTS)]
    place = _place_among(keys, df, cuts).alias("place")
    counts = {r["place"]: r["count"] for r in rows.groupBy(place).count().collect()}
    after, before = [], []
    for i in range(len(cuts)):
        before.append((after[-1] if after else 0) + counts.get(2 * i, 0))
        after.append(before[-1] + counts.get(2 * i + 1, 0))
    parts = []
    # Ranges between the cuts, and the rows equal to a cut, which need no order.
    for i in range(len(cuts) + 1):
        low, high = after[i - 1] if i else 0, before[i] if i < len(cuts) else total
        begin, stop = max(first, low), min(end, high)
        if begin < stop:
            rows = df
            if i < len(cuts):
                rows = rows.where(_before(keys, df, cuts[i]))
            if i:
                rows = rows.where(~_before(keys, df, cuts[i - 1]) & ~_equal(keys, df, cuts[i - 1]))
            parts.append(_rows_between(rows, keys, high - low, begin - low, stop - low))
        if i < len(cuts):
            same = min(end, after[i]) - max(first, before[i])
            if same > 0:
                parts.append(df.where(_equal(keys, df, cuts[i])).limit(same))
    return reduce(DataFrame.unionByName, parts)


def _place_among(keys: list[SortKey], df: DataFrame, cuts: list[tuple]) -> Column:
    """Where a row stands among sorted cuts: 2 i + 1 if it equals cut i, else 2 i if so many come before.

    A binary search in an array that all tasks know: a few comparisons a row, however many cuts.
    """
    kinds = [df.schema[k.name].dataType for k in keys]
    given = F.array(*(F.struct(*(F.lit(v).cast(kind).alias(f"k{i}") for i, (v, kind) in enumerate(zip(cut, kinds, strict=True)))) for cut in cuts))
    own = [quoted(k.name) for k in keys]

    def not_after(cut: Column) -> Column:
        """Whether a cut comes before the row, or equals it."""
        found = F.lit(True)
        for i, key in reversed(list(enumerate(keys))):
            theirs, mine = cut[f"k{i}"], own[i]
            low, high = (mine, theirs) if key.descending else (theirs, mine)
            # NULL is the least value there is.
            less = (low.isNull() & high.isNotNull()) | F.coalesce(low < high, F.lit(False))
            found = less | (theirs.eqNullSafe(mine) & found)
        return found

    def further(at: Column, step: Column) -> Column:
        cut = F.get(given, at + step - 1)
        return F.when((at + step <= len(cuts)) & not_after(cut), at + step).otherwise(at)

    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    at = F.aggregate(steps, F.lit(0), further)
    # The cut found may be the row's equal; a search that found none is not.
    return F.aggregate(F.array(at), F.lit(0), lambda _, n: F.when((n > 0) & _same(own, F.get(given, n - 1)), 2 * n - 1).otherwise(2 * n))


def _same(own: list[Column], cut: Column) -> Column:
    return reduce(Column.__and__, (mine.eqNullSafe(cut[f"k{i}"]) for i, mine in enumerate(own)))


def _equal(keys: list[SortKey], df: DataFrame, row: tuple) -> Column:
    same = (quoted(k.name).eqNullSafe(F.lit(v).cast(df.schema[k.name].dataType)) for k, v in zip(keys, row, strict=True))
    return reduce(Column.__and__, same)


def _before(keys: list[SortKey], df: DataFrame, row: tuple) -> Column:
    """Whether a row comes before the given one."""
    found = F.lit(False)
    for key, value in reversed(list(zip(keys, row, strict=True))):
        cell, given = quoted(key.name), F.lit(value).cast(df.schema[key.name].dataType)
        if value is None:
            less = cell.isNotNull() if key.descending else F.lit(False)
        elif key.descending:
            less = F.coalesce(cell > given, F.lit(False))
        else:
            less = F.coalesce(cell < given, F.lit(True))
        found = less | (cell.eqNullSafe(given) & found)
    return found


# --- stored datasets -----------------------------------------------------------


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """A stored dataset with the columns of all its files, those added later too."""
    return spark.read.option("mergeSchema", True).parquet(_no_glob(path))


def _is_file(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()


def stored_page(
    spark: SparkSession,
    path: str,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    total_rows: int | None = None,
    offsets: DataFrame | None = None,
    row_id: str = ROW_ID,
    schema: T.StructType | None = None,
) -> DataFrame:
    """One page of a stored dataset in its own order, with row numbers.

    Only the files that hold rows of the page are opened: at most as many as the
    page has rows. A page that spans files is full all the same. Every page has the
    columns and types of the whole dataset, partition columns too. For many pages of
    a dataset of very many files, store its ``file_offsets`` once and pass them in with
    its ``schema``: then neither the folder is listed nor the footers are read again.
    """
    if offsets is None:
        offsets = file_offsets(spark, path)
    if total_rows is None:
        total_rows = offsets.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    first, end = _bounds(page, page_size, total_rows)
    if schema is None:
        schema = dataset(spark, path).schema
    holding = offsets.where(
        (F.col("rows") > 0) & (F.col("first_row") < end) & (F.col("first_row") + F.col("rows") > first)
    ).collect()
    if not holding:
        return spark.createDataFrame([], schema).select(F.lit(0).cast("bigint").alias(row_id), "*")
    reader = spark.read.schema(schema)
    if not _is_file(spark, path):
        # The dataset is a folder; its own sub-folders may hold column values.
        reader = reader.option("basePath", path)
    # The metadata column spells paths as URIs.
    rows = reader.parquet(*(_no_glob(unquote(f.file_path)) for f in holding))
    _require_free(rows, row_id)
    starts = F.create_map(*(F.lit(x) for f in holding for x in (f.file_path, f.first_row)))
    number = starts[F.col("_metadata.file_path")] + F.col("_metadata.row_index")
    return (
        rows.select(number.alias(row_id), *(quoted(name) for name in rows.columns))
        .where((quoted(row_id) >= first) & (quoted(row_id) < end))
        .orderBy(quoted(row_id))
    )


def page_columns(rows: DataFrame, order_by: str = ROW_ID) -> DataFrame:
    """A page as one row of arrays, one per column, in row order.

    NULLs keep their place. More rows than the largest page has are an error, found
    before they are gathered.
    """
    columns = [name for name in rows.columns if name != order_by]
    entry = F.struct(
        quoted(order_by).alias("at"), *(quoted(c).alias(f"c{i}") for i, c in enumerate(columns))
    )
    # Ordered by the first field; the others need not be comparable that way.
    gathered = rows.limit(MAX_PAGE_SIZE + 1).agg(F.collect_list(entry).alias("entries"))
    too_many = F.raise_error(F.lit(f"A page has at most {MAX_PAGE_SIZE} rows."))
    ordered = gathered.select(
        F.array_sort(
            F.when(F.size("entries") > MAX_PAGE_SIZE, too_many).otherwise(F.col("entries")),
            lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0),
        ).alias("entries")
    )

    def values(field: str) -> Column:
        return F.transform("entries", lambda e: e[field])

    return ordered.select(*(values(f"c{i}").alias(name) for i, name in enumerate(columns)))
