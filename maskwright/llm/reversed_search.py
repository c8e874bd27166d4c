"""Ranked lexical search with the roles reversed: the queries are indexed, the documents stream.

An inverted index over the items' terms goes to all tasks, and each document's term counts run through
it once. A document adds to the scores of the items that share a term with it; a task keeps the best
few documents of each item, and these short lists are merged, first by groups of tasks, then per item.
Texts are never shuffled, and no pair of item and document is kept that is not among the best of its
task. Items beyond what an index may hold are searched in blocks, one pass over the documents each.

The score is BM25 in whole numbers: ``sum of w * ((10^9 * tf) div (1000 * tf + 12 * m))``, with
``w = floor(1000 * ln((2N + 2) / (2 df + 1)))`` and ``m = 75 + (25 n N) div L``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm.common import quoted
from maskwright.llm.slices import TERM_BYTES, Tally, summed, text_slices
from maskwright.llm.store import stored
from maskwright.llm.wordhash import word_pieces

#: Documents that an item gets.
BEST = 20
#: Postings (a term of an item, once) of one index: 24 bytes each in the broadcast.
POSTINGS_AT_ONCE = 1_000_000
#: Scores added up at once, and cells of the table they are added up in.
AT_ONCE = 1 << 22
#: Short lists of so many groups of tasks meet first.
GROUPS = 64


class Index(NamedTuple):
    """``terms``: sorted hashes; those of term ``t`` have ``postings[starts[t]:starts[t + 1]]``, items of
    ``items`` by number, ``times`` the item has the term. ``weights`` by term once they are known."""

    items: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    postings: np.ndarray
    times: np.ndarray
    weights: np.ndarray | None = None
    documents: int = 0
    terms_of_all: int = 0


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all terms of a slice, and the number of the text each stands in."""
    parts = list(word_pieces(data, offsets, TERM_BYTES))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("item").to_numpy()
        for first, data, offsets in text_slices(batch.column("text")):
            hashes, texts = _terms(data, offsets)
            order = np.lexsort((hashes, texts))
            hashes, texts = hashes[order], texts[order]
            new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1]))[: len(hashes)])
            times = np.diff(np.append(new, len(hashes)))
            columns = [pa.array(names[first + texts[new]]), pa.array(hashes[new].view(np.int64)), pa.array(times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "term", "times"])


def _hits(index: Index, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes the index has, and the numbers of their terms."""
    if not len(index.terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    own = np.flatnonzero(index.terms[at] == hashes)
    return own, at[own]


def _survey(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    """In how many documents each term of the index is; as -1 the documents with any term at all, as
    -2 the terms they have, repeats counted."""
    index, tally = index.value, Tally()
    give = lambda keys, values: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], names=["term", "n"])
    for batch in batches:
        for _, data, offsets in text_slices(batch.column("text")):
            hashes, texts = _terms(data, offsets)
            own, terms = _hits(index, hashes)
            pairs = np.unique(texts[own] * len(index.terms) + terms) % max(len(index.terms), 1)
            keys = np.concatenate([pairs, [-1, -2]])
            counts = np.concatenate([np.ones(len(pairs), np.int64), [len(np.unique(texts)), len(hashes)]])
            for keys, counts in tally.add(*summed(keys, counts)):
                yield give(keys, counts)
    for keys, counts in tally.rest():
        yield give(keys, counts)


class Shortlists:
    """The best documents of each item so far: score, then key, NULL keys last."""

    def __init__(self, n_items: int, best: int):
        self.best = best
        self.least = np.ones(n_items, np.int64)  # a score below it can't get in any more
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, whether the key is NULL, key
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, items, scores, missing, keys) -> None:
        self.new.append((items, scores, missing, keys))
        self.waiting += len(items)
        if self.waiting > max(1 << 16, len(self.kept[0])):
            self.prune()

    def prune(self) -> None:
        item, score, missing, key = (np.concatenate([k, *x]) for k, x in zip(self.kept, zip(*self.new, strict=True), strict=True)) if self.new else self.kept
        order = np.lexsort((key, missing, -score, item))
        item, score, missing, key = item[order], score[order], missing[order], key[order]
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1])[: len(item)])
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        last = rank == self.best - 1
        self.least[item[last]] = np.maximum(score[last], 1)
        keep = rank < self.best
        self.kept = [x[keep] for x in (item, score, missing, key)]
        self.new, self.waiting = [], 0


def _doc_scores(index: Index, hashes: np.ndarray, texts: np.ndarray, n_texts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Tables of scores, documents by items, each with the number of its first document."""
    lengths = np.bincount(texts, minlength=n_texts)
    own, terms = _hits(index, hashes)
    pairs, counts = np.unique(texts[own] * max(len(index.terms), 1) + terms, return_counts=True)
    doc, term = pairs // max(len(index.terms), 1), pairs % max(len(index.terms), 1)
    # Exact whatever the sizes: Python's integers, one division a document.
    m = np.array([75 + (25 * int(n) * index.documents) // max(index.terms_of_all, 1) for n in lengths], np.int64)
    value = index.weights[term] * ((1_000_000_000 * counts) // (1000 * counts + 12 * m[doc]))
    reach = index.starts[term + 1] - index.starts[term]
    n_items = len(index.items)
    most_docs = max(1, AT_ONCE // max(n_items, 1))
    ends = np.searchsorted(doc, np.arange(n_texts), "right")  # of each document's hits
    work = np.concatenate([[0], np.cumsum(reach)])
    lo = 0
    while lo < n_texts:
        begin = ends[lo - 1] if lo else 0
        hi = int(np.searchsorted(work[ends], work[begin] + AT_ONCE, "right"))
        hi = min(max(hi, lo + 1), lo + most_docs, n_texts)
        end = ends[hi - 1]
        table = np.zeros((hi - lo) * n_items, np.int64)
        size = reach[begin:end]
        if len(size):
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(index.starts[term[begin:end]], size)
            cells = np.repeat((doc[begin:end] - lo) * n_items, size) + index.postings[at]
            np.add.at(table, cells, np.repeat(value[begin:end], size) * index.times[at])
        yield lo, table.reshape(hi - lo, n_items)
        lo = hi


def _search(batches: Iterator[pa.RecordBatch], index, best: int) -> Iterator[pa.RecordBatch]:
    index = index.value
    lists = Shortlists(len(index.items), best)
    for batch in batches:
        keys = batch.column("key")
        missing = keys.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        keys = keys.fill_null(0).to_numpy()
        for first, data, offsets in text_slices(batch.column("text")):
            for lo, table in _doc_scores(index, *_terms(data, offsets), len(offsets) - 1):
                doc, item = np.nonzero(table >= lists.least)
                at = first + lo + doc
                lists.add(item, table[doc, item], missing[at], keys[at])
    lists.prune()
    item, score, missing, key = lists.kept
    columns = [pa.array(index.items[item]), pa.array(score), pa.array(key, mask=missing.astype(bool))]
    yield pa.RecordBatch.from_arrays(columns, names=["item", "score", "key"])


def _index(postings: list[tuple[np.ndarray, ...]]) -> Index:
    """An index of rows (item, term, times)."""
    names, terms, times = (np.concatenate(x) for x in zip(*postings, strict=True))
    terms = terms.view(np.uint64)
    items, numbers = np.unique(names, return_inverse=True)
    order = np.lexsort((numbers, terms))
    known, starts = np.unique(terms[order], return_index=True)
    return Index(items, known, np.append(starts, len(terms)), numbers[order], times[order])


def _with_weights(index: Index, counts: dict[int, int]) -> Index:
    n = counts.get(-1, 0)
    df = np.array([counts.get(t, 0) for t in range(len(index.terms))], np.float64)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    return index._replace(weights=weights, documents=n, terms_of_all=counts.get(-2, 0))


def _best(rows: DataFrame, best: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    best: int = BEST, postings_at_once: int = POSTINGS_AT_ONCE,
) -> DataFrame:
    """The ``best`` documents of each item with a score above 0: item, rank (from 1), key, score.

    Terms are runs of A-Z, a-z, 0-9 and characters beyond ASCII, A-Z taken as a-z; they are known by 64
    bits of a hash. NULL and empty texts have none: such documents don't count, such items find nothing.
    Equal scores stand by ascending key, NULL keys last; the key is a whole number. Each row of ``docs``
    is a document of its own, repeated ones too. Rows of ``items`` that repeat an item and its text are
    one; an item with several texts is asked with each, and has a list for each. Other columns of either
    table, whatever their names, are not looked at.

    The items' postings come to the driver in blocks of about ``postings_at_once`` (an item with more by
    itself is a block), and each block costs two passes over the documents, one for its terms' document
    counts and one for the scores.
    """
    spark = docs.sparkSession
    asked = items.select(quoted(item).alias("name"), quoted(item_text).alias("text")).distinct()
    asked = asked.withColumn("item", F.xxhash64("name", F.col("name").isNull(), "text")).transform(stored, "asked")
    postings = asked.select("item", "text").mapInArrow(_item_terms, "item long, term long, times long").transform(stored, "postings")
    blocks = -(-postings.count() // postings_at_once)
    rows = docs.select(quoted(key).cast("long").alias("key"), quoted(text).alias("text"))
    found = [_block(spark, rows, postings.where(F.pmod("item", F.lit(blocks)) == b), best) for b in range(blocks)]
    none = spark.createDataFrame([], "item long, score long, key long")
    lists = reduce(DataFrame.unionByName, found, none)
    short = _best(lists.withColumn("group", F.spark_partition_id() % GROUPS), best, "item", "group").drop("rank")
    ranked = _best(short, best, "item").join(asked.select("item", "name"), "item")
    return ranked.select(F.col("name").alias(item), "rank", F.col("key").alias(key), "score")


def _block(spark: SparkSession, rows: DataFrame, postings: DataFrame, best: int) -> DataFrame:
    """The short lists of a block of items, one for each task."""
    table = postings.toArrow()  # bounded by the block
    if not table.num_rows:
        return spark.createDataFrame([], "item long, score long, key long")
    index = _index([tuple(table.column(c).to_numpy() for c in ("item", "term", "times"))])
    bare = spark.sparkContext.broadcast(index)
    counts = rows.select("text").mapInArrow(partial(_survey, index=bare), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    weighed = spark.sparkContext.broadcast(_with_weights(index, {r["term"]: r["n"] for r in counts.collect()}))
    return stored(rows.mapInArrow(partial(_search, index=weighed, best=best), "item long, score long, key long"), "shortlists")
