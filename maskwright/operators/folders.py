"""Files of a folder in any store that Spark reaches: lists, small texts, renames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def full_path(spark: SparkSession, path: str) -> str:
    """The path with its store, as file lists spell it."""
    return _system(spark, path).makeQualified(_path(spark, path)).toString()


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def no_glob(path: str) -> str:
    """A path spelled so that readers take it as it stands."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path)


def files_in(spark: SparkSession, path: str, nested: bool = False) -> list[str]:
    """Paths of the files of a folder, sorted; hidden ones (``_``, ``.``) and their folders left out.
    No content is read. A folder that doesn't exist has none."""
    if not exists(spark, path):
        return []
    root = full_path(spark, path).rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = [r.path for r in reader.load(no_glob(path)).select("path").collect()]
    return sorted(p for p in found if nested or "/" not in p[len(root) + 1 :])


def bytes_of(spark: SparkSession, paths: Sequence[str]) -> int:
    """Bytes of files given by their paths; no content is read."""
    if not paths:
        return 0
    return spark.read.format("binaryFile").load([no_glob(p) for p in paths]).agg(F.sum("length")).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, which must be new."""
    out = _system(spark, path).create(_path(spark, path), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    source = _system(spark, path).open(_path(spark, path))
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename in one step; False, and nothing done, if there is a target already."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, target).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    if exists(spark, target):
        return False
    try:
        context.rename(_path(spark, full_path(spark, source)), _path(spark, full_path(spark, target)), options)
    except Exception as problem:  # noqa: BLE001  the gateway's own kind
        if "FileAlreadyExistsException" in str(problem):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)
