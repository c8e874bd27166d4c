"""Toxicity: a factorization machine over hashed terms.

Terms are words and the first bytes of longer words. Each has a weight, and a short vector whose
products with others' vectors weigh pairs of terms, which a sum of weights can't: a word that is an
insult only beside certain others. Terms are counted over the whole training sample, in which copies of
a text are one, and all that go with the label are kept. So are terms that go with it only in pairs,
each neutral by itself: they are looked for among what marks the texts of label 1 that the machine
doesn't find by the others. The machine is fitted on which kept terms a text has. All texts are scored
where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from maskwright.llm.common import quoted, saved, without
from maskwright.llm.wordhash import byte_table, utf8_of, word_pieces

#: The training sample: at most so many different labelled texts, those whose keys have the least
#: hashes. The driver gets their kept terms.
SAMPLE_ROWS = 20_000
#: Terms fall into 2 ** BITS places.
BITS = 22
#: A kept term, or pair of terms, stands in at least so many texts, and so few are kept whose share of
#: labelled ones is off the mean by chance only: the more are tested, the surer each has to be.
LEAST_TEXTS, BY_CHANCE = 4, 4.0
#: Terms that are looked at for pairs: those that mark the texts not found the most.
PAIRED = 256
FACTORS, ROUNDS, RATE, DECAY = 4, 120, 0.05, 2e-3
THRESHOLD = 0.3
_STEMS = (4, 5, 6, 7)
#: Letters, digits and all bytes of other scripts make words.
_WORD = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


class Machine(NamedTuple):
    """``places``: for each hashed place the row of its weights; row 0 is for all others, and 0."""

    places: np.ndarray
    base: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, texts: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """``texts[i]`` has the term ``terms[i]``, each pair once."""
        linear = np.bincount(texts, self.weights[terms], n)
        pairs = np.zeros(n)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[terms, f]
            pairs += np.bincount(texts, v, n) ** 2 - np.bincount(texts, v * v, n)
        return 1 / (1 + np.exp(-np.clip(self.base + linear + pairs / 2, -30, 30)))


def _terms(column: pa.Array, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Which text has which term, each pair once: all hashed places, or the rows of the kept ones."""
    data, offsets = utf8_of(column)
    found = []
    for hashes, texts in word_pieces(data, offsets, _WORD, _STEMS):
        terms = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        if places is not None:
            terms = places[terms].astype(np.int64)
            texts, terms = texts[terms > 0], terms[terms > 0]
        found.append(np.unique(texts << BITS | terms))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1), len(column)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, terms, _ = _terms(batch.column("text"))
        label = batch.column("label").to_numpy().astype(np.int64)[texts]
        names, inverse = np.unique(terms, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(np.bincount(inverse, minlength=len(names))), pa.array(np.bincount(inverse, label, len(names)).astype(np.int64))],
            names=["term", "texts", "labelled"],
        )


def _kept(batches: Iterator[pa.RecordBatch], places) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, terms, n = _terms(batch.column("text"), places.value)
        own = np.split(terms.astype(np.int32), np.searchsorted(texts, np.arange(1, n)))
        lists = pa.array([x.tolist() for x in own[:n]], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("label"), lists], names=["hash", "label", "terms"])


def _surprise(c1, c, share):
    """How far a share ``c1 / c`` is off ``share``: its chance is at most the exponential of minus this
    (Chernoff). Of columns, so that Spark works it out."""
    own = c1 / c
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    return c * (part(own, F.lit(share) if isinstance(share, float) else share) + part(1 - own, 1 - (F.lit(share) if isinstance(share, float) else share)))


def _count_beside(batches: Iterator[pa.RecordBatch], places) -> Iterator[pa.RecordBatch]:
    """A row for each term of a batch: how many texts, and labelled ones, have it beside each of the terms.
    These are at most PAIRED, so that rows and their lists are bounded by that, whatever texts share."""
    size = int(places.value.max()) + 1
    for batch in batches:
        texts, terms, n = _terms(batch.column("text"), places.value)
        has = np.zeros((n, size), np.float32)
        has[texts, terms] = 1
        label = batch.column("label").to_numpy().astype(np.float32)
        both, labelled = (pairs.astype(np.int64) for pairs in (has.T @ has, has.T @ (has * label[:, None])))
        there = np.flatnonzero(both.diagonal())
        columns = [pa.array(there), *(pa.array(list(pairs[there]), pa.list_(pa.int64())) for pairs in (both, labelled))]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "texts", "labelled"])


def _best_beside(table: pa.Table, share: float) -> pa.Table:
    """Of a term's rows, one per batch: how many terms after it are tested beside it, and by how much the
    pair most off the mean is off it."""
    term = table.column("term")[0].as_py()
    c, c1 = (np.sum(table.column(n).to_pylist(), axis=0, dtype=np.int64) for n in ("texts", "labelled"))
    others = np.flatnonzero(c >= LEAST_TEXTS)
    others = others[others != term]
    own, c = c1[others] / c[others], c[others]
    with np.errstate(divide="ignore", invalid="ignore"):
        by = c * sum(np.where(x > 0, x * np.log(x / y), 0.0) for x, y in ((own, share), (1 - own, 1 - share)))
    return pa.table({"term": [term], "tested": [int((others > term).sum())], "by": [float(by.max(initial=0.0))]})


_COUNTS = "term long, texts long, labelled long"
_BESIDE = "term long, texts array<long>, labelled array<long>"


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("texts").alias("c"), F.sum("labelled").alias("c1"))


def _off_the_mean(counts: DataFrame, share: float) -> list[int]:
    """The terms whose share of labelled texts is not the mean's."""
    tested = counts.where(F.col("c") >= LEAST_TEXTS).transform(saved)
    bound = float(np.log(max(tested.count(), 1) / BY_CHANCE))
    best = tested.withColumn("by", _surprise(F.col("c1"), F.col("c"), share)).where(F.col("by") >= max(bound, 1.0))
    return [r["term"] for r in best.orderBy(F.desc("by"), "term").collect()]  # bounded by 2 ** BITS


def _in_pairs(sample: DataFrame, counts: DataFrame, missed: list[int], n: int, share: float, kept: set[int]) -> list[int]:
    """Terms that go with the label beside another. ``missed``: hashes of the labelled texts not found."""
    spark = sample.sparkSession
    names = spark.createDataFrame([(h,) for h in missed], "hash long")  # bounded by the sample
    own = _summed(sample.join(F.broadcast(names), "hash").select("text", "label").mapInArrow(_count, _COUNTS))
    own = own.where(F.col("c") >= LEAST_TEXTS).select("term", F.col("c").alias("u")).join(counts, "term")
    marks = _surprise(F.col("u"), F.lit(float(len(missed))), (F.col("c") + 0.5) / (n + 1.0))
    own = own.where(F.col("u") * n > F.col("c") * len(missed)).withColumn("by", marks)
    chosen = [r["term"] for r in own.orderBy(F.desc("by"), "term").limit(PAIRED).collect()]
    if len(chosen) < 2:
        return []
    places = np.zeros(1 << BITS, np.int32)
    places[chosen] = np.arange(1, len(chosen) + 1)
    shared = spark.sparkContext.broadcast(places)
    beside = sample.select("text", "label").mapInArrow(partial(_count_beside, places=shared), _BESIDE)

    def best(table: pa.Table) -> pa.Table:
        return _best_beside(table, share)

    marked = beside.groupBy("term").applyInArrow(best, "term long, tested long, by double").collect()  # at most PAIRED
    bound = float(np.log(max(sum(r["tested"] for r in marked), 1) / BY_CHANCE))
    found = {r["term"] for r in marked if r["by"] >= max(bound, 1.0)}
    return [t for i, t in enumerate(chosen, 1) if i in found and t not in kept]


def _gathered(sample: DataFrame, terms: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Places, and of all texts in a fixed order their hashes, labels and kept terms."""
    places = np.zeros(1 << BITS, np.int32)
    places[terms] = np.arange(1, len(terms) + 1)
    shared = sample.sparkSession.sparkContext.broadcast(places)
    rows = sample.mapInArrow(partial(_kept, places=shared), "hash long, label int, terms array<int>").toPandas()
    rows = rows.sort_values(["label", "hash"], kind="stable")
    return places, rows["hash"].to_numpy(), rows["label"].to_numpy(np.float64), [np.asarray(t, np.int64) for t in rows["terms"]]


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on rows whose ``label`` is 0 or 1; others are left out. NULL texts count as empty ones.
    A text that has a label more than once is one row. Beyond ``sample_rows`` those with the least key
    hashes are taken, ties by the text's hash. Without rows, or with one kind of
    label only, the machine gives every text the share of 1 (a half where there are none)."""
    rows = labelled.where(quoted(label).isin(0, 1))
    rows = rows.select(F.xxhash64(quoted(key)).alias("at"), quoted(text).alias("text"), quoted(label).cast("int").alias("label"))
    # The bound is found on hashes alone; texts are never sorted.
    rows = rows.withColumn("hash", F.xxhash64("text"))
    chosen = rows.groupBy("hash", "label").agg(F.min("at").alias("at")).orderBy("at", "hash", "label").limit(sample_rows).transform(saved)
    sample = rows.join(F.broadcast(chosen), ["hash", "label", "at"]).dropDuplicates(["hash", "label"])
    sample = sample.select("hash", "text", "label").repartition(16).transform(saved)
    n, ones = sample.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = (ones + 0.5) / (n + 1)
    counts = _summed(sample.select("text", "label").mapInArrow(_count, _COUNTS)).transform(saved)
    best = _off_the_mean(counts, share)
    places, hashes, labels, lists = _gathered(sample, best)
    machine = _fit(places, labels, lists, len(best), share)
    found = np.full(len(lists), share)  # what all texts get if no term is kept
    if best:
        found = machine.score(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists), len(lists))
    missed = hashes[(labels == 1) & (found < 0.5)].tolist()
    more = _in_pairs(sample, counts, missed, n, share, set(best)) if len(missed) >= LEAST_TEXTS and ones < n else []
    if not more:
        return machine
    places, _, labels, lists = _gathered(sample, best + more)
    return _fit(places, labels, lists, len(best) + len(more), share)


def _fit(places: np.ndarray, labels: np.ndarray, lists: list[np.ndarray], n_terms: int, share: float) -> Machine:
    """Logistic loss with decay, by Adam over all rows at once; the rows come in a fixed order."""
    base = np.array([np.log(share / (1 - share))])
    weights = np.zeros(n_terms + 1)
    vectors = np.random.default_rng(8).normal(0, 0.05, (n_terms + 1, FACTORS))
    vectors[0] = 0
    if not n_terms or labels.min() == labels.max():
        return Machine(places, float(base[0]), weights, vectors)
    texts = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    terms = np.concatenate(lists)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (base, weights, vectors)]
    for step in range(1, ROUNDS + 1):
        machine = Machine(places, float(base[0]), weights, vectors)
        error = (machine.score(texts, terms, len(lists)) - labels) / len(lists)
        own = error[texts]
        slopes = [np.array([error.sum()]), np.bincount(terms, own, n_terms + 1) + DECAY / len(lists) * weights, np.empty_like(vectors)]
        for f in range(FACTORS):
            v = vectors[terms, f]
            sums = np.bincount(texts, v, len(lists))[texts]
            slopes[2][:, f] = np.bincount(terms, own * (sums - v), n_terms + 1) + DECAY * vectors[:, f]
        for p, slope, (m, s) in zip((base, weights, vectors), slopes, state, strict=True):
            m += 0.1 * (slope - m)
            s += 0.001 * (slope * slope - s)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        weights[0] = vectors[0] = 0
    return Machine(places, float(base[0]), weights, vectors)


def _scores(batches: Iterator[pa.RecordBatch], text: str, machine) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, terms, n = _terms(batch.column(text), machine.value.places)
        yield batch.append_column("score", pa.array(machine.value.score(texts, terms, n)))


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """All rows with ``score`` (0 to 1) added, or put in the place of a column of that name. Empty and
    NULL texts get the score of a text without kept terms."""
    docs = without(docs, ["score"])
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    kind = StructType([*docs.schema, StructField("score", DoubleType())])
    return docs.mapInArrow(partial(_scores, text=text, machine=shared), kind)


def held_out(key: Column) -> Column:
    """The rows whose labels are never learned from; a NULL key's text is empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``sample_rows`` labels outside the held-out rows, with their texts. The labels are few
    by that bound, so they are broadcast and the texts stay where they are."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("label"))
    known = known.distinct().orderBy(F.xxhash64("doc_id"), "label").limit(sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from THRESHOLD on)."""
    machine = train(labelled_texts(docs, labels))
    scored = score(docs.select("doc_id", "text"), machine)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
