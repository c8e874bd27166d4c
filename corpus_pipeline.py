"""The corpus pipeline: toxic texts, near copies and benchmark passages go, the sources are mixed to
their weights, and the mix is dealt into shards.

Each stage takes ``(spark, docs, sf_dir)``; ``run`` writes what a stage returns to the folder of
``spark.checkpoint.dir`` and reads it again for the next. All but the last return the columns of
``documents``; the mixing stage's rows are pieces of documents, as often as the mix takes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontamination, mixing, ngram_join, sharding, toxicity
from maskwright.llm.common import row_hash, shared_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _with_names_free(docs: DataFrame, names: set[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stage`` returns without its columns ``names``; columns of ``docs`` with such names, as Spark
    compares them, have others meanwhile."""
    taken = {c.lower() for c in docs.columns}
    aside = {}
    for c in docs.columns:
        if c.lower() in names:
            aside[c] = next(n for k in range(len(taken) + 1) if (n := f"__own{k}_{c}").lower() not in taken)
    out = stage(docs.withColumnsRenamed(aside)).drop(*names)
    return out.withColumnsRenamed({free: c for c, free in aside.items()})


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is below the threshold of rejection."""
    machine = toxicity.train(toxicity.labelled_texts(docs, _table(spark, sf_dir, "labels")))
    return _with_names_free(docs, {"score"}, lambda d: toxicity.score(d, machine).where(F.col("score") < toxicity.THRESHOLD))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard of 0.75 or more, the one with the least doc_id
    stays. Documents without words are no copies of each other; a repeated row of the one that stays
    goes."""
    return ngram_join.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no ten-word window of a benchmark item occurs."""
    return decontamination.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that a mix with weights 5, 2, 1 takes, as often as it takes them."""
    return _with_names_free(docs, {"shard", "slot"}, lambda d: mixing.mixed_texts(d, mixing.plan_mix(d)))


def shard_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces with their shard of 8 and their slot in it. A piece's key is its content, so that
    the pieces of one document spread."""
    even = {s: 1.0 for s in range(8)}

    def sharded(pieces: DataFrame) -> DataFrame:
        return sharding.shard_rows(pieces.withColumn("piece_key", row_hash(pieces)), ["piece_key"], even)

    return _with_names_free(docs, {"piece_key", "grown_shard"}, sharded)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_mix),
]

#: SQL can't fit the machine of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
