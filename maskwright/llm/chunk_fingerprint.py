"""Document fingerprints by content-defined chunking.

A gear hash over the last bytes says where a text may be cut; with normalised cutting few places
count before a chunk has its usual size and many after. Cuts follow the content, so an edit changes
the chunks around it only. A fingerprint is the set of the chunks' digests with their lengths, and
containment is the share of a text's length whose chunks the other text has too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import quoted
from maskwright.llm.store import stored
from maskwright.llm.wordhash import drawn


class Cutting(NamedTuple):
    """Bytes of a chunk: least, usual, most. ``hard`` and ``easy``: bits of the gear hash that have to
    be 0 for a cut before and after the usual size."""

    least: int = 16
    usual: int = 48
    most: int = 192
    hard: int = 6
    easy: int = 5


#: Bytes of texts in a range of documents that follow each other, and rows drawn for each to find them.
RANGE_BYTES, DRAWN = 64 << 20, 32
#: A row with more copies than this may be often enough to be taken out of the order.
OFTEN = 64

_GEAR = drawn(256, 5)
#: Bytes hashed at once; the hash looks back 64 bytes.
_AT_ONCE = 1 << 21


def _gear(data: np.ndarray) -> np.ndarray:
    """For each byte the gear hash of it and the 63 before: in each step the sum looks back twice as
    far as before."""
    h = _GEAR[data]
    for k in range(6):
        width = 1 << k
        if len(h) > width:
            h[width:] = h[width:] + (h[:-width] << np.uint64(width))
    return h


def _places(data: np.ndarray, cutting: Cutting) -> tuple[list[int], list[int]]:
    """Where a chunk may end, before and after its usual size: the easy places, and the hard of them."""
    easy, hard = [], []
    for lo in range(0, len(data), _AT_ONCE):
        back = min(lo, 63)
        h = _gear(data[lo - back : lo + _AT_ONCE])[back:]
        good = np.flatnonzero(h >> np.uint64(64 - cutting.easy) == 0)
        strict = good[h[good] >> np.uint64(64 - cutting.hard) == 0]
        easy.append(good + lo + 1)
        hard.append(strict + lo + 1)
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return flat(easy), flat(hard)


def chunk_ends(raw: bytes, cutting: Cutting = Cutting()) -> list[int]:
    """The ends of the chunks; none for no bytes. The first 63 bytes of a text are hashed with what
    there is, so that equal starts are cut alike."""
    easy, hard = _places(np.frombuffer(raw, np.uint8), cutting)
    return _ends(len(raw), easy.tolist(), hard.tolist(), cutting)


def _ends(n: int, easy: list[int], hard: list[int], cutting: Cutting) -> list[int]:
    ends, start, e, h = [], 0, 0, 0
    while start < n:
        low, mid, top = start + cutting.least, start + cutting.usual, start + cutting.most
        while h < len(hard) and hard[h] < low:
            h += 1
        if h < len(hard) and hard[h] <= mid:
            cut = hard[h]
        else:
            while e < len(easy) and easy[e] <= mid:
                e += 1
            cut = min(easy[e], top) if e < len(easy) else top
        start = min(cut, n)
        ends.append(start)
    return ends


def fingerprint(raw: bytes, cutting: Cutting = Cutting()) -> dict[str, int]:
    """48 bits of each distinct chunk's digest, in order, and the chunk's length."""
    found, start = {}, 0
    for end in chunk_ends(raw, cutting):
        found[hashlib.blake2b(raw[start:end], digest_size=6).hexdigest()] = end - start
        start = end
    return dict(sorted(found.items()))


def written(marks: dict[str, int]) -> str:
    return ",".join(f"{digest}.{length}" for digest, length in marks.items())


def containment(own: dict[str, int], other: dict[str, int]) -> float:
    """The share of ``own``'s length in chunks that ``other`` has. Without chunks: 1 in a text that
    has none either, else 0."""
    if not own:
        return 0.0 if other else 1.0
    return sum(n for digest, n in own.items() if digest in other) / sum(own.values())


def with_fingerprint(docs: DataFrame, text: str = "text", cutting: Cutting = Cutting()) -> DataFrame:
    """Any table with the column ``fingerprint`` added: digests and lengths of the text's chunks. NULL
    and empty texts have the empty fingerprint."""

    @F.udf("string", useArrow=True)
    def of(value):
        return written(fingerprint((value or "").encode(), cutting))

    return docs.withColumn("fingerprint", of(quoted(text)))


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _row(key, text: str, after: str, marks: dict[str, int], next_marks: dict[str, int], cutting: Cutting) -> tuple:
    part = len(text) // 3
    edited = (text[: len(text) - part] + after[:part]).encode()
    edited_marks = fingerprint(edited, cutting)
    return (
        key, len(text), hashlib.sha256(edited).hexdigest(), written(marks), written(edited_marks),
        containment(marks, edited_marks), containment(marks, next_marks),
    )


def _walk(batches: Iterator[pa.RecordBatch], cutting: Cutting) -> Iterator[pa.RecordBatch]:
    """Rows of buckets in order, each bucket's last row being the next one's first, not its own."""
    held = None
    for batch in batches:
        out = []
        buckets, own, keys = (batch.column(c).to_pylist() for c in ("bucket", "own", "key"))
        for i, text in enumerate(batch.column("text")):
            text = text.as_py() or ""
            marks = fingerprint(text.encode(), cutting)
            if held is not None and held[0] == buckets[i]:
                out.append(_row(held[1], held[2], text, held[3], marks, cutting))
            held = (buckets[i], keys[i], text, marks) if own[i] else None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)


def _alone(batches: Iterator[pa.RecordBatch], cutting: Cutting) -> Iterator[pa.RecordBatch]:
    """Rows that are their own next, as many times as ``times`` says."""
    for batch in batches:
        out = []
        for key, text, times in zip(*(batch.column(c) for c in ("key", "text", "times")), strict=True):
            text = text.as_py() or ""
            marks = fingerprint(text.encode(), cutting)
            out.append((*_row(key.as_py(), text, text, marks, marks, cutting), times.as_py()))
        if out:
            kinds = [*_OUT, pa.field("times", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=pa.schema(kinds))


def _cuts(groups: DataFrame, n: int, total: int) -> list[tuple[int, int]]:
    """At most ``n`` - 1 places in the order that part the rows into ranges of about the same bytes, by
    a sample of some tens of rows a range. They only say where ranges end."""
    if n < 2:
        return []
    drawn = groups.sample(min(1.0, DRAWN * n / max(total, 1)), seed=1).select("order.at", "order.tie", "bytes", "copies").toArrow()
    at, tie, size, copies = (drawn.column(c).to_numpy() for c in ("at", "tie", "bytes", "copies"))
    order = np.lexsort((tie, at))
    weight = np.cumsum(((size + 64) * copies)[order])
    if not len(order):
        return []
    places = np.unique(np.searchsorted(weight, weight[-1] * np.arange(1, n) / n))
    return [(int(at[order[i]]), int(tie[order[i]])) for i in places]


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", cutting: Cutting = Cutting()) -> DataFrame:
    """One row per document: how like its fingerprint is to that of its edited text, whose last third
    is the first as many code points of the next document, and to the next document's.

    Documents stand by descending key, NULL keys last; the last one's next is the first. The key is a
    whole number, and comes back as long. Repeated keys stand by a hash of the text. The order is cut
    into ranges of about ``RANGE_BYTES``, so that one shuffle brings neighbours together and no task has
    them all; each range also gets the first row of the next. Cuts fall between texts of one key too. Of a
    row that is repeated so often that it would fill a range, one copy stands in the order, and the others,
    whose next is the very same, are worked out once. A single document is its own next. NULL and empty
    texts are alike; a very long text is one row of its range.
    """
    rows = docs.select(quoted(key).cast("long").alias("key"), quoted(text).alias("text"))
    order = F.struct(F.coalesce(F.bitwise_not(F.col("key")), F.lit(2**63 - 1)).alias("at"), F.xxhash64("text").alias("tie"))
    whole = rows.withColumn("order", order)
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    groups = whole.select("order", size.alias("bytes")).groupBy("order").agg(F.count(F.lit(1)).alias("copies"), F.max("bytes").alias("bytes")).transform(stored, "order")
    count, total_rows, total = groups.agg(F.count(F.lit(1)), F.sum("copies"), F.sum(F.col("copies") * F.col("bytes"))).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n = max(tasks, (total or 0) // RANGE_BYTES)
    hot = groups.where(F.col("copies") > F.lit(max((total_rows or 0) // (4 * n), OFTEN))).select("order", F.col("copies").alias("times"))  # fewer than 4 n

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    again = None
    if not hot.isEmpty():
        marked = whole.join(F.broadcast(hot), "order", "left")
        firsts = marked.where("times IS NOT NULL").dropDuplicates(["order"])
        again = firsts.select("key", "text", (F.col("times") - 1).alias("times")).mapInArrow(partial(_alone, cutting=cutting), kinds + ", times long")
        again = again.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "__copy")
        whole = marked.where("times IS NULL").unionByName(firsts).drop("times")

    cuts = _cuts(groups.withColumn("copies", F.least("copies", F.lit(OFTEN))), n, count)
    splits = F.array(*(F.struct(F.lit(a).cast("long").alias("at"), F.lit(b).cast("long").alias("tie")) for a, b in cuts))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(cuts)) & (F.get(splits, at + step - 1) < F.col("order")), at + step).otherwise(at)

    bucket = F.aggregate(steps, F.lit(0), further) if cuts else F.lit(0)
    heads = groups.select("order", bucket.alias("bucket")).groupBy("bucket").agg(F.min("order").alias("head"))
    ring = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(ring), F.last("bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.withColumn("before", before)  # one row per bucket
    whole = whole.withColumn("bucket", bucket)
    extra = whole.join(F.broadcast(heads.select("head", "before")), F.col("order") == F.col("head")).dropDuplicates(["order"])
    own = F.lit(True).alias("own")
    sent = whole.select("key", "text", "order", "bucket", own)
    sent = sent.unionByName(extra.select("key", "text", "order", F.col("before").alias("bucket"), F.lit(False).alias("own")))
    sent = sent.repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("own"), "order")
    found = sent.mapInArrow(partial(_walk, cutting=cutting), kinds)
    if again is not None:
        found = found.unionByName(again)
    return found.withColumnRenamed("doc_id", key)
