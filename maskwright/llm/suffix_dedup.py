"""Removal of long repeats by a sorted array of suffixes.

A string of ``length`` bytes that starts at two places is found through the suffixes at anchors: of
the positions in every window of that length one is chosen by its content, the least hash of the
bytes that follow, so that equal strings have their anchors at equal places. An anchor stands for all
strings whose choice it is; what it needs of the text is their union. Suffixes whose first bytes occur
once are left out at the start. The others are range-partitioned by sampled splitters on their leading
bytes, sorted locally by multikey quicksort, and compared with their neighbours, also across the
borders of partitions; and so are the prefixes that end at the anchors, read backwards. What both ways
from an anchor agrees with a neighbour's gives the strings that repeat. Where neighbours leave a doubt,
the strings themselves are counted.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import quoted, saved, shared_folder
from maskwright.llm.hashfilter import filter_of, may_hold
from maskwright.llm.wordhash import drawn, utf8_of

#: Leading bytes of a suffix that anchors are chosen by, and that neighbours have to share.
LEAD = 64
#: Windows handled at once.
AT_ONCE = 1 << 18
#: Suffixes of a range that one task sorts, about 800 bytes each.
RANGE = 50_000
#: Neighbours on each side that a suffix is compared with; what they leave open is counted.
NEAR = 12

_BYTE, _BASE = drawn(256, 21), drawn(1, 22)[0] | np.uint64(1)
_PLACE_BITS = np.uint64(20)


class Anchors(NamedTuple):
    """``at``: positions; ``text``: whose; ``key``: hash of the leading bytes; ``low`` and ``high``:
    the strings it stands for begin so many bytes before it."""

    at: np.ndarray
    text: np.ndarray
    key: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _lead_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the LEAD bytes from each position on; each step doubles the reach."""
    h, factor, reach = _BYTE[data], _BASE, 1
    with np.errstate(over="ignore"):
        while reach < LEAD:
            h = h[:-reach] + h[reach:] * factor
            factor, reach = factor * factor, reach * 2
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> Anchors:
    """The anchors of texts that stand one after another; none in texts shorter than ``length``."""
    long = np.diff(offsets) >= length
    begins, ends = offsets[:-1][long], offsets[1:][long] - length + 1  # where strings begin
    which = np.flatnonzero(long)
    parts: list[tuple[np.ndarray, ...]] = []
    for s in range(0, max(len(data) - length + 1, 0), AT_ONCE):
        e = min(s + AT_ONCE, len(data) - length + 1)
        first, last = np.searchsorted(ends, s, "right"), np.searchsorted(begins, e)
        if first >= last:
            continue
        hashes = _lead_hashes(data[s : e - 1 + length])
        places = np.arange(len(hashes), dtype=np.uint64)
        ranked = (hashes >> _PLACE_BITS << _PLACE_BITS) | places
        chosen = (_least(ranked, length - LEAD + 1) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        lo, hi = np.maximum(begins[first:last], s) - s, np.minimum(ends[first:last], e) - s
        turns = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
        starts = np.unique(np.concatenate([turns, lo]))
        stops = np.unique(np.concatenate([turns, hi]))
        owner = np.searchsorted(lo, starts, "right") - 1
        good = (owner >= 0) & (starts < hi[np.maximum(owner, 0)])
        starts, owner = starts[good], owner[good]
        stops = stops[np.searchsorted(stops, starts, "right")]
        at = chosen[starts]
        parts.append((at + s, which[first + owner], hashes[at], starts + s, stops + s))
    if not parts:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none.astype(np.uint64), none, none)
    at, text, key, start, stop = (np.concatenate(p) for p in zip(*parts, strict=True))
    # One anchor on both sides of a border of pieces is one.
    fresh = np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]))
    firsts = np.flatnonzero(fresh)
    lasts = np.append(firsts[1:], len(at)) - 1
    return Anchors(at[firsts], text[firsts], key[firsts], at[firsts] - (stop[lasts] - 1), at[firsts] - start[firsts])


def _keys(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = find_anchors(*utf8_of(batch.column("text")), length)
        names, counts = np.unique(found.key, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "n"])


_SUFFIX = pa.schema([
    ("key", pa.int64()), ("ctx", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int64()),
    ("low", pa.int32()), ("high", pa.int32()), ("back", pa.binary()), ("ahead", pa.binary()),
])
_SUFFIX_KIND = "key long, ctx long, text_hash long, at long, low int, high int, back binary, ahead binary"


def _suffixes(batches: Iterator[pa.RecordBatch], length: int, bits) -> Iterator[pa.RecordBatch]:
    """The anchors whose leading bytes may occur again: their strings' union is ``back``, read
    backwards from the anchor, and ``ahead``. ``ctx`` is its hash; the bytes are sent once per task."""
    seen: set[int] = set()
    for batch in batches:
        data, offsets = utf8_of(batch.column("text"))
        found = find_anchors(data, offsets, length)
        keep = may_hold(bits.value, found.key)
        if not keep.any():
            continue
        at, text, key, low, high = (x[keep] for x in found)
        raw = data.tobytes()
        ctxs, backs, aheads = [], [], []
        for a, lo, hi in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
            whole = raw[a - hi : a - lo + length]
            ctx = int.from_bytes(hashlib.blake2b(whole, digest_size=8, salt=b"%d.%d" % (lo, hi)).digest(), "little", signed=True)
            ctxs.append(ctx)
            new = ctx not in seen
            seen.add(ctx)
            backs.append(whole[:hi][::-1] if new else None)
            aheads.append(whole[hi:] if new else None)
        hashes = batch.column("text_hash").to_numpy()[text]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key.view(np.int64)), pa.array(ctxs, pa.int64()), pa.array(hashes), pa.array(at - offsets[text]),
                pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(backs, pa.binary()), pa.array(aheads, pa.binary()),
            ],
            schema=_SUFFIX,
        )


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of one matrix, filled up with 0, and their lengths."""
    data, offsets = utf8_of(column)
    lengths = np.diff(offsets)
    rows = np.zeros((len(lengths), width), np.uint8)
    rows[np.arange(width)[None, :] < lengths[:, None]] = data
    return rows, lengths


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several columns: sorted by the first, then only what ties in it by the
    next, and so on. With eight bytes to a column this is multikey quicksort on long characters."""
    n = len(columns[0])
    order = np.arange(n)
    group = np.zeros(n, np.int64)
    open_rows = np.arange(n)
    for column in columns:
        if not len(open_rows):
            break
        values = column[order[open_rows]]
        inner = np.lexsort((values, group[open_rows]))
        order[open_rows] = order[open_rows][inner]
        values, groups = values[inner], group[open_rows]
        same = np.zeros(len(open_rows), bool)
        same[1:] = (values[1:] == values[:-1]) & (groups[1:] == groups[:-1])
        starts = np.maximum.accumulate(np.where(same, 0, np.arange(len(open_rows))))
        group[open_rows] = open_rows[starts]
        tied = same.copy()
        tied[:-1] |= same[1:]
        open_rows = open_rows[tied]
    return order


def _words(rows: np.ndarray) -> list[np.ndarray]:
    padded = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))
    return list(np.ascontiguousarray(padded).view(">u8").astype(np.uint64).T)


def _common(rows: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many leading bytes rows i and j share."""
    out = np.zeros(len(i), np.int64)
    for lo in range(0, len(i), 1 << 14):
        a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
        differ = rows[a] != rows[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[lo : lo + (1 << 14)] = np.minimum(first, np.minimum(lengths[a], lengths[b]))
    return out


_MET = pa.schema([
    ("ctx", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("most_back", pa.int32()), ("most_ahead", pa.int32()), ("edge", pa.int32()),
    ("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("back", pa.binary()), ("ahead", pa.binary()),
])
_MET_KIND = "ctx long, lo int, hi int, most_back int, most_ahead int, edge int, key long, low int, high int, back binary, ahead binary"


_CONTEXT = pa.schema([f for f in _SUFFIX if f.name not in ("text_hash", "at")])


def _met(ctx, lo, hi, back, ahead, edges=()) -> pa.RecordBatch:
    n = len(ctx)
    plain = [np.asarray(ctx, np.int64), *(np.asarray(x, np.int32) for x in (lo, hi, back, ahead))]
    columns = [pa.array(c) for c in plain] + [pa.nulls(n, f.type) for f in list(_MET)[5:]]
    batch = pa.RecordBatch.from_arrays(columns, schema=_MET)
    if not edges:
        return batch
    rows = pa.RecordBatch.from_pylist(list(edges), schema=_MET)
    return pa.Table.from_batches([batch, rows]).combine_chunks().to_batches()[0]


def _compare(key, ctx, low, high, back, ahead, i, j, length):
    """What pairs of suffixes agree on; strings that begin ``lo`` to ``hi`` bytes before both repeat."""
    (b, b_len), (a, a_len) = back, ahead
    behind, forth = _common(b, b_len, i, j), _common(a, a_len, i, j)
    lo = np.maximum(length - forth, np.maximum(low[i], low[j]))
    hi = np.minimum(behind, np.minimum(high[i], high[j]))
    return behind, forth, lo, hi


def _neighbours(batches: Iterator[pa.RecordBatch], length: int, ahead_first: bool, near: int) -> Iterator[pa.RecordBatch]:
    """One partition's suffixes in order, compared with the ``near`` next ones of the same leading bytes.
    The first and the last go out with their bytes, to be compared with other partitions' last and
    first."""
    from pyspark import TaskContext

    table = pa.Table.from_batches(batches, _CONTEXT)
    if not table.num_rows:
        return
    key, ctx, low, high = (table.column(c).to_numpy() for c in ("key", "ctx", "low", "high"))
    back, ahead = _matrix(table.column("back"), length - LEAD), _matrix(table.column("ahead"), length)
    one, two = (ahead, back) if ahead_first else (back, ahead)
    order = multikey_order([key, *_words(one[0]), one[1], *_words(two[0]), two[1], ctx])
    for step in range(1, near + 1):
        i, j = order[:-step], order[step:]
        same = key[i] == key[j]
        i, j = i[same], j[same]
        if not len(i):
            break
        behind, forth, lo, hi = _compare(key, ctx, low, high, back, ahead, i, j, length)
        good = lo <= hi
        if step == 1:  # the first neighbours share the most bytes of all
            good[:] = True
        ends = [np.concatenate([x[good], x[good]]) for x in (lo, hi, behind, forth)]
        yield _met(np.concatenate([ctx[i[good]], ctx[j[good]]]), *ends)
    part = TaskContext.get().partitionId()
    edges = []
    for side, row in enumerate((int(order[0]), int(order[-1]))):
        edges.append({"ctx": int(ctx[row]), "edge": 2 * part + side} | {c: table.column(c)[row].as_py() for c in ("key", "low", "high", "back", "ahead")})
    yield _met([], [], [], [], [], edges)


def _borders(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        names = _CONTEXT.names
        both = pa.concat_tables([table.select(names), table.select([f"{c}_2" for c in names]).rename_columns(names)])
        key, ctx, low, high = (both.column(c).to_numpy() for c in ("key", "ctx", "low", "high"))
        i = np.arange(table.num_rows)
        j = i + table.num_rows
        back, ahead = _matrix(both.column("back"), length - LEAD), _matrix(both.column("ahead"), length)
        behind, forth, lo, hi = _compare(key, ctx, low, high, back, ahead, i, j, length)
        yield _met(np.concatenate([ctx[i], ctx[j]]), *(np.concatenate([x, x]) for x in (lo, hi, behind, forth)))


def _sorted_pass(contexts: DataFrame, length: int, ahead_first: bool, near: int) -> DataFrame:
    one, two = ("ahead", "back") if ahead_first else ("back", "ahead")
    least = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-contexts.count() // RANGE))  # contexts are a written table
    ranges = contexts.repartitionByRange(n, "key", one, two, "ctx")
    met = _table(ranges.mapInArrow(partial(_neighbours, length=length, ahead_first=ahead_first, near=near), _MET_KIND))
    edges = met.where("edge IS NOT NULL").select("edge", *_CONTEXT.names)
    following = Window.orderBy("edge")  # two rows per partition
    pairs = edges.select("*", *(F.lead(c).over(following).alias(f"{c}_2") for c in edges.columns))
    pairs = pairs.where("edge % 2 = 1 AND key = key_2").drop("edge", "edge_2")
    # The last of one partition and the first of the next that has any.
    across = pairs.mapInArrow(partial(_borders, length=length), _MET_KIND)
    return met.where("edge IS NULL").unionByName(across).select("ctx", "lo", "hi", "most_back", "most_ahead")


def _table(df: DataFrame) -> DataFrame:
    """Written compressed to the shared folder, and read from there."""
    path = f"{shared_folder(df.sparkSession)}/suffixes-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, ends inclusive, of which none touch."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_DECIDED = "ctx long, key long, spans array<struct<lo: int, hi: int>>, open_lo int, open_hi int"


def _decide(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Which strings of a context repeat for certain, and between which bounds others may."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            found = [(r["low"], r["high"])] if r["n"] > 1 else merged([(s["lo"], s["hi"]) for s in r["spans"] or ()])
            lo, hi = max(r["low"], length - (r["ahead"] or 0)), min(r["high"], r["back"] or 0)
            for s, e in found:  # what lies between the bounds and isn't found
                if s <= lo:
                    lo = max(lo, e + 1)
            for s, e in reversed(found):
                if e >= hi:
                    hi = min(hi, s - 1)
            open_lo, open_hi = (lo, hi) if lo <= hi else (None, None)
            rows.append({"ctx": r["ctx"], "key": r["key"], "spans": [{"lo": s, "hi": e} for s, e in found], "open_lo": open_lo, "open_hi": open_hi})
        kind = pa.schema([
            ("ctx", pa.int64()), ("key", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
            ("open_lo", pa.int32()), ("open_hi", pa.int32()),
        ])
        yield pa.RecordBatch.from_pylist(rows, schema=kind)


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The hash of each string in doubt, and of those it may equal."""
    for batch in batches:
        ctxs, begins, hashes = [], [], []
        for r in batch.to_pylist():
            lo, hi = max(r["low"], r["open_lo"]), min(r["high"], r["open_hi"])
            if lo > hi:
                continue
            whole = r["back"][::-1] + r["ahead"]
            for o in range(lo, hi + 1):
                own = hashlib.blake2b(whole[r["high"] - o : r["high"] - o + length], digest_size=8).digest()
                ctxs.append(r["ctx"])
                begins.append(o)
                hashes.append(int.from_bytes(own, "little", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(ctxs, pa.int64()), pa.array(begins, pa.int32()), pa.array(hashes, pa.int64())], names=["ctx", "o", "h"])


def repeated_spans(docs: DataFrame, text: str = "text", length: int = 400, near: int = NEAR) -> DataFrame:
    """``text_hash, spans``: for each distinct text with any, the byte ranges (from, until) covered by
    strings of ``length`` bytes that start anywhere else too. Ranges may overlap.

    Texts are UTF-8 bytes; NULL, empty and shorter texts have none. Matches lie within a text. Texts
    are known by 64 bits of their hash, strings in doubt and unions of strings likewise.
    """
    if length < 2 * LEAD:
        raise ValueError(f"Repeats are of {2 * LEAD} bytes or more.")
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64(quoted(text)).alias("text_hash"), quoted(text).alias("text"))
    keys = texts.mapInArrow(partial(_keys, length=length), "key long, n long")
    keys = keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    bits = spark.sparkContext.broadcast(filter_of(keys))
    found = _table(texts.mapInArrow(partial(_suffixes, length=length, bits=bits), _SUFFIX_KIND))

    # Copies of a text are one row from here on, with their number.
    places = found.groupBy("ctx", "text_hash", "at").agg(F.count(F.lit(1)).alias("n"))
    counts = places.groupBy("ctx").agg(F.sum("n").alias("n"))
    contexts = found.where("ahead IS NOT NULL").select(*_CONTEXT.names).dropDuplicates(["ctx"])
    contexts = _table(contexts)
    met = _sorted_pass(contexts, length, True, near).unionByName(_sorted_pass(contexts, length, False, near))
    good = F.when(F.col("lo") <= F.col("hi"), F.struct("lo", "hi"))
    met = met.groupBy("ctx").agg(F.collect_set(good).alias("spans"), F.max("most_back").alias("back"), F.max("most_ahead").alias("ahead"))
    known = contexts.select("ctx", "key", "low", "high").join(counts, "ctx").join(met, "ctx", "left")
    decided = _table(known.mapInArrow(partial(_decide, length=length), _DECIDED))

    # Joins with plain tables can split leading bytes, or a string, that very many suffixes have.
    # Strings in doubt: all of the suffixes with the same leading bytes that begin between the bounds.
    doubts = decided.where("open_lo IS NOT NULL").groupBy("key").agg(F.min("open_lo").alias("open_lo"), F.max("open_hi").alias("open_hi"))
    strings = _table(contexts.join(_table(doubts), "key").mapInArrow(partial(_strings, length=length), "ctx long, o int, h long"))
    twice = strings.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    more = strings.join(_table(twice), "h").select("ctx", F.col("o").alias("lo"), F.col("o").alias("hi"))
    spans = decided.select("ctx", F.explode("spans").alias("s")).select("ctx", "s.lo", "s.hi").unionByName(more)
    spans = _table(spans.groupBy("ctx").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))

    covered = places.select("ctx", "text_hash", "at").join(spans, "ctx")
    covered = covered.select("text_hash", "at", F.explode("spans").alias("s"))
    begin, end = F.col("at") - F.col("s.hi"), F.col("at") - F.col("s.lo") + length
    covered = covered.select("text_hash", begin.alias("from"), end.cast("long").alias("until"))
    # Merged once per text, in order and as they come: a text of one repeated character has a span for
    # each byte, and each copy of a text would else merge its list again.
    ordered = covered.repartition("text_hash").sortWithinPartitions("text_hash", "from", "until")
    whole = ordered.mapInArrow(_merged_spans, "text_hash long, from long, until long")
    return whole.groupBy("text_hash").agg(F.collect_list(F.struct("from", "until")).alias("spans"))


def _merged_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans of texts, ends exclusive, of which none touch. The last one of a batch waits for the
    next batch's first."""
    rest = [np.zeros(0, np.int64)] * 3

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["text_hash", "from", "until"])

    for batch in batches:
        own = [batch.column(c).to_numpy() for c in ("text_hash", "from", "until")]
        text, begin, end = (np.concatenate(x) for x in zip(rest, own, strict=True))
        if not len(text):
            continue
        group = np.cumsum(np.append(False, text[1:] != text[:-1]))
        far = np.int64(1) << 40  # beyond any text's bytes: texts' spans lie apart
        reach = np.maximum.accumulate(end + group * far)
        first = np.flatnonzero(np.append(True, begin[1:] + group[1:] * far > reach[:-1]))
        last = np.append(first[1:], len(text)) - 1
        merged_end = reach[last] - group[first] * far
        columns = [text[first], begin[first], merged_end]
        yield out([c[:-1] for c in columns])
        rest = [c[-1:] for c in columns]
    yield out(rest)


def _carry(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    """Texts without repeats end here; the others go on with their bytes."""
    for batch in batches:
        hashes = batch.column("text_hash").to_numpy()
        maybe = may_hold(bits.value, hashes) if len(hashes) else np.zeros(0, bool)
        sizes, digests, raws = [], [], []
        for cell, more in zip(batch.column("text"), maybe.tolist(), strict=True):
            raw = (cell.as_py() or "").encode()
            sizes.append(len(raw))
            digests.append(None if more else hashlib.sha256(raw).hexdigest())
            raws.append(raw if more else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(raws, pa.binary())],
            names=["doc_id", "text_hash", "n_bytes", "digest", "raw"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, size, digest, raw, spans in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "digest", "raw", "spans")), strict=True):
            removed = merged([(s["from"], s["until"] - 1) for s in spans.as_py() or ()])
            digest = digest.as_py()
            if digest is None:
                raw, kept, at = raw.as_py(), hashlib.sha256(), 0
                for lo, hi in removed:
                    kept.update(raw[at:lo])
                    at = hi + 1
                kept.update(raw[at:])
                digest = kept.hexdigest()
            rows.append((key.as_py(), size.as_py(), sum(hi - lo + 1 for lo, hi in removed), len(removed), digest))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, near: int = NEAR) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    A text that stands in several documents is removed whole, if it is long enough. Only texts with
    repeats are shuffled.
    """
    spans = saved(repeated_spans(docs, text, length, near))
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(spans.select("text_hash")))
    rows = docs.select(quoted(key).cast("long").alias("doc_id"), F.xxhash64(quoted(text)).alias("text_hash"), quoted(text).alias("text"))
    rows = rows.mapInArrow(partial(_carry, bits=bits), "doc_id long, text_hash long, n_bytes long, digest string, raw binary")
    whole = rows.join(spans, "text_hash", "left")
    return whole.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
