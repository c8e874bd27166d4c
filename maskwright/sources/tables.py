"""Readers: CSV and Parquet, picked by the path's suffix."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from maskwright.functions.text import quoted

# Fixed value: what one task is meant to read or write.
TARGET_PARTITION_BYTES = 128 * 1024 * 1024
# Fixed value: partitions where the size of the input is not known.
UNKNOWN_SIZE_PARTITIONS = 4
# Bytes of a file whose rows one task may sort to deal them out, and partitions that
# Spark's shuffle fills without holding rows back.
DEALT_AT_ONCE, FIRST_DEAL = 4 * 1024 * 1024, 200


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    *,
    schema: StructType | str | None = None,
    keep_strings: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header row and doubled quotes.

    Types are inferred by default, which reads the data twice and turns ``02134``
    into a number. Give a ``schema``, or ``keep_strings`` for text as it stands:
    both read the data once. A schema's columns are matched by the header's names, in
    whatever order; every file is held to the first one's header. With ``multi_line`` a
    cell may hold line ends, but a file cannot be split; turn it off for large files
    without such cells.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("inferSchema", schema is None and not keep_strings)
    )
    if schema is None:
        return reader.csv(path)
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    header = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path).columns
    if sorted(header) != sorted(wanted.names):
        raise ValueError(f"The schema names the columns {wanted.names}, the files {header}.")
    stored = StructType([wanted[name] for name in header])
    return reader.schema(stored).option("enforceSchema", False).csv(path).select(*(quoted(n) for n in wanted.names))


#: The text of a row that does not fit, and the file it came from.
BAD_ROW, BAD_FILE = "row_text", "file_path"


def quarantine_csv(
    spark: SparkSession, path: str | list[str], schema: StructType | str, *, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """CSV rows that fit the schema, and those that don't, as they stand, with the file they are in.

    A row fits if it has as many cells as the header and every cell that isn't empty is a value of its
    column's type. ``read_csv`` would cut long rows, fill short ones and turn such cells into NULL.
    Columns are matched by the header's names. Each of the two tables is one reading of the files:
    which rows it has doesn't depend on the columns that are used of it.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    header = reader.csv(path).columns
    if sorted(header) != sorted(wanted.names):
        raise ValueError(f"The schema names the columns {wanted.names}, the files {header}.")
    corrupt = next(n for k in range(len(header) + 1) if (n := f"__corrupt{k}") not in header)
    stored = StructType([*(wanted[name] for name in header), StructField(corrupt, StringType())])
    rows = (
        reader.schema(stored)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", corrupt)
        .option("columnPruning", False)
        .option("enforceSchema", False)
        .csv(path)
    )
    rows = rows.select("*", F.col("_metadata.file_path").alias(f"{corrupt}_file"))
    good = rows.where(quoted(corrupt).isNull()).select(*(quoted(n) for n in wanted.names))
    # Spark won't read the odd rows' text alone; this holds for any row, and has the other columns read.
    read = F.xxhash64(*(quoted(n) for n in header)) >= F.lit(-(2**63))
    bad = rows.where(quoted(corrupt).isNotNull() & read)
    return good, bad.select(quoted(corrupt).alias(BAD_ROW), quoted(f"{corrupt}_file").alias(BAD_FILE))


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def suffix_of(path: str) -> str:
    """Lower-cased suffix of the last path element, or an empty string."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name.lstrip(".") else ""


def read_table(
    spark: SparkSession,
    path: str,
    *,
    suffix: str | None = None,
    schema: StructType | str | None = None,
    keep_strings: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Read a file, folder or glob by its suffix, or by the one given for a folder."""
    kind = suffix_of(path) if suffix is None else suffix.lower()
    try:
        if kind == ".csv":
            return read_csv(spark, path, schema=schema, keep_strings=keep_strings, multi_line=multi_line)
        if kind == ".parquet":
            return read_parquet(spark, path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"There is no input at {path}") from problem
        raise ValueError(f"The input cannot be read: {problem}") from problem
    raise ValueError(f"No reader for '{kind or '(no suffix)'}'; there are .csv and .parquet")


# --- partitioning ----------------------------------------------------------


def partitions_for(
    size: int | None, target: int = TARGET_PARTITION_BYTES, most: int | None = None
) -> int:
    """Partitions of about ``target`` bytes; four if the size is unknown.

    ``most`` caps the number. There is no cap by default: with 64 partitions a
    terabyte would make tasks of 16 GB.
    """
    if size is None:
        return UNKNOWN_SIZE_PARTITIONS
    wanted = max(1, size // target)
    return wanted if most is None else min(most, wanted)


def input_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of the files under a path; their content is not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length")
    )


def spread(df: DataFrame, path: str, target: int = TARGET_PARTITION_BYTES, most: int | None = None) -> DataFrame:
    """Spread rows that came from a few large files that cannot be split.

    Such a file is parsed by one task, and what follows here is cheap beside that: the
    shuffle pays only where most of the cluster would have no file at all. That is for
    the caller to say. Partitions follow the size of the files.

    Spark sorts the rows it deals out in turn, and those it deals into very many partitions: all that a
    task reads. Rows of a file above ``DEALT_AT_ONCE`` are first dealt by their number in the task that
    reads them, into so few partitions that they are written as they come.
    """
    total, largest = input_files(df.sparkSession, path).agg(F.sum("length"), F.max("length")).first()
    wanted = partitions_for(total, target, most)
    if (largest or 0) > DEALT_AT_ONCE:
        number = next(n for k in range(len(df.columns) + 1) if (n := f"__number{k}") not in df.columns)
        df = df.withColumn(number, F.monotonically_increasing_id()).repartition(min(wanted, FIRST_DEAL), number).drop(number)
        if wanted <= FIRST_DEAL:
            return df
    return df.repartition(wanted)
