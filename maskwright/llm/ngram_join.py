"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Texts are sets of hashed word shingles. Equal sets are one class from the start, so that copies cost
nothing later. Each class sends the shingles of its prefix, rarest first, to the tasks that hold
those shingles, and meets there the list of classes that have it too. Pairs come from the lists in two
rounds, as a large group of near copies would else make all its pairs: first each class with its list's
hub; then, with what that linked known, pairs from different components only. A pair is verified once, on whole sets.

That gives components. For all links, ``all_links`` and ``links_per_class`` then compare the sets of each
component, in which all its links lie, blocks of classes by blocks: a task holds two blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import BLANKS, quoted, row_hash
from maskwright.llm.hashfilter import filter_of, may_hold
from maskwright.llm.store import release, stored
from maskwright.llm.wordhash import NOT_BLANK, drawn, hashed_words, mixed, shingles, utf8_of

#: The suffix filter compares counts in cells of the hash space, one byte each: for each set the least
#: power of two that is a quarter of its size or more, and LEAST_CELLS at least.
LEAST_CELLS = 64
#: Texts of an Arrow batch that are hashed at once.
TEXTS_AT_ONCE = 1024
#: Bytes of a shingle's hash that sets are verified by.
WIDTH = 6
#: Shingles that a task has seen in so many sets are counted over the corpus.
OFTEN = 4
#: The order by frequency names so many shingles; all others count as rare and stand by hash. This
#: sets the order only, which may be any: results don't depend on it. 2 MB in each task.
NAMED = 1 << 17


class Likeness(NamedTuple):
    """Jaccard of at least ``num / den`` on sets of ``words``-word shingles."""

    words: int = 5
    num: int = 3
    den: int = 4

    def least_part(self, n: np.ndarray) -> np.ndarray:
        """The least overlap that a set of ``n`` has with any set it is like."""
        return -(-self.num * n // self.den)

    def least_overlap(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return -(-self.num * (n + m) // (self.num + self.den))

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - self.least_part(n) + 1

    def index_prefix(self, n: np.ndarray) -> np.ndarray:
        """Enough for the smaller set of a pair."""
        return n - self.least_overlap(n, n) + 1


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for lo in range(0, len(column), TEXTS_AT_ONCE):
        data, offsets = utf8_of(column.slice(lo, TEXTS_AT_ONCE))
        words, texts = hashed_words(data, offsets, NOT_BLANK)
        grams, begins = shingles(words, texts, len(offsets) - 1, size)
        for i in range(len(begins) - 1):
            yield lo + i, np.unique(grams[begins[i] : begins[i + 1]])


def _digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set; two sums over it, so that the order doesn't matter."""
    n = np.uint64(len(grams))
    sums = np.array([mixed(grams + n).sum(dtype=np.uint64), mixed(grams ^ _OTHER).sum(dtype=np.uint64)])
    a, b = mixed(sums + n).view(np.int64)
    return int(a), int(b)


def _cells(grams: np.ndarray) -> bytes:
    bits = max(LEAST_CELLS, (len(grams) - 1) // 4 + 1).bit_length() - 1
    bits += (1 << bits) < max(LEAST_CELLS, -(-len(grams) // 4))
    counts = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


_OTHER = drawn(1, 9)[0]
_SEEN = pa.schema([("hash", pa.int64()), ("row", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("n", pa.int64()), ("cells", pa.binary())])


def _describe(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row for each text; and one, with ``hash``, for each shingle often seen in this batch."""
    for batch in batches:
        rows, grams = [], []
        keys = batch.column("row").to_pylist()
        for i, own in _sets(batch.column("text"), size):
            rows.append((None, keys[i], *_digest(own), len(own), _cells(own)))
            grams.append(own)
        if not rows:
            continue
        names, counts = np.unique(np.concatenate(grams), return_counts=True)
        for h, c in zip(names[counts >= OFTEN].view(np.int64).tolist(), counts[counts >= OFTEN].tolist(), strict=True):
            rows.append((h, None, None, None, c, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SEEN, strict=True)], schema=_SEEN)


_POSTING = pa.schema([("key", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _postings(batches: Iterator[pa.RecordBatch], like: Likeness, named) -> Iterator[pa.RecordBatch]:
    """The prefix of each set, rarest first. A set seen before in this task isn't sent again."""
    hashes, places = named.value
    seen: set[int] = set()
    for batch in batches:
        out = []
        for _, own in _sets(batch.column("text"), like.words):
            if not len(own) or (cid := _digest(own)[0]) in seen:
                continue
            seen.add(cid)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                rank = np.where(hashes[at] == own, places[at], 0)
                own = own[np.argsort(rank, kind="stable")]  # own is sorted: by hash within a rank
            p = int(like.prefix(len(own)))
            out.append((own[:p], cid, len(own)))
        if out:
            sizes = [len(x[0]) for x in out]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([x[0] for x in out]).view(np.int64)),
                    pa.array(np.repeat(np.array([x[1] for x in out], np.int64), sizes)),
                    pa.array(np.repeat(np.array([x[2] for x in out], np.int32), sizes)),
                    pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])),
                ],
                schema=_POSTING,
            )


#: A list of so many classes goes out as it comes, without a look for lists of the same classes.
LONG = 1 << 16
_MEMBER = pa.schema([("list", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("keys", pa.int64())])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of the lists of two classes or more, from postings sorted by key, n and cid. Near copies
    share many shingles: lists of the same classes are one list, known by a hash of its classes, in
    which a class has its foremost place. At most LONG rows and a batch are kept."""
    rest, open_key = None, None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        fresh = np.ones(len(cols[0]), bool)
        fresh[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        cols = [c[fresh] for c in cols]
        if open_key is not None:
            on = int(np.searchsorted(cols[0], open_key, "right"))
            yield _members([c[:on] for c in cols], cols[0][:on])
            cols = [c[on:] for c in cols]
        if not len(cols[0]):
            rest = None
            continue
        open_key = None
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        yield _named_lists([c[:last] for c in cols])
        rest = [c[last:] for c in cols]
        if len(rest[0]) > LONG:
            yield _members(rest, rest[0])
            rest, open_key = None, rest[0][0]
    if rest is not None:
        yield _named_lists(rest)


def _named_lists(cols: list[np.ndarray]) -> pa.RecordBatch:
    key = cols[0]
    if not len(key):
        return _members(cols, key)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    lengths = np.diff(np.append(starts, len(key)))
    names = np.add.reduceat(mixed(cols[1].view(np.uint64)), starts) + lengths.astype(np.uint64)
    many = np.repeat(lengths > 1, lengths)
    return _members([c[many] for c in cols], np.repeat(mixed(names).view(np.int64), lengths)[many])


def _members(cols: list[np.ndarray], names: np.ndarray) -> pa.RecordBatch:
    _, cid, n, pos = cols
    order = np.lexsort((pos, cid, names))
    names, cid, n, pos = names[order], cid[order], n[order], pos[order]
    fresh = np.ones(len(names), bool)
    fresh[1:] = (names[1:] != names[:-1]) | (cid[1:] != cid[:-1])
    keys = np.diff(np.append(np.flatnonzero(fresh), len(names))).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[fresh]) for x in (names, cid, n, pos)] + [pa.array(keys)], schema=_MEMBER)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _across(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Pairs of a list, sorted by list, n and cid, from different components. Of a list longer than
    LONG only the classes are kept that are large enough to be like the ones to come."""
    rest = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        rest = [c[last:] for c in cols]
        yield from _list_pairs([c[:last] for c in cols], like)
        if len(rest[0]) > LONG:
            yield from _list_pairs(rest, like)
            large = rest[2].astype(np.int64) * like.den >= int(rest[2][-1]) * like.num
            rest = [c[large] for c in rest]
    if rest is not None:
        yield from _list_pairs(rest, like)


def _list_pairs(cols: list[np.ndarray], like: Likeness) -> Iterator[pa.RecordBatch]:
    key, cid, n, pos, component = cols
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    borders = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
    found: list[np.ndarray] = []
    for lo, hi in zip(borders, np.append(borders, len(key))[1:], strict=True):
        own = slice(lo, hi)
        if (component[own] == component[lo]).all():
            continue
        # The index part: the smaller set of a pair shares a shingle within its shorter prefix.
        for i in np.flatnonzero(pos[own] < like.index_prefix(n[own])) + lo:
            top = lo + np.searchsorted(n[own], n[i] * like.den // like.num, "right")
            j = np.arange(lo, top)
            j = j[(component[j] != component[i]) & ((n[j] > n[i]) | (j > i))]
            rest = np.minimum(n[i] - pos[i], n[j] - pos[j])
            j = j[rest >= like.least_overlap(n[i], n[j])]
            if len(j):
                found.append(np.stack([np.full(len(j), cid[i]), cid[j]]))
    if found:
        pairs = np.concatenate(found, axis=1)
        pairs = np.unique(np.sort(pairs, axis=0), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=_PAIR)


def _near_in_cells(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """The suffix filter: two sets differ in at least as many shingles as their cells' counts do."""
    for batch in batches:
        differ = np.zeros(len(batch), np.int64)
        for i, cells in enumerate(zip(batch.column("cells_a").to_pylist(), batch.column("cells_b").to_pylist(), strict=True)):
            a, b = (np.frombuffer(c, np.uint8).astype(np.int64) for c in cells)
            size = min(len(a), len(b))
            differ[i] = np.abs(a.reshape(size, -1).sum(axis=1) - b.reshape(size, -1).sum(axis=1)).sum()
        n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        keep = (n + m - differ) // 2 >= like.least_overlap(n, m)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


_SET = pa.schema([("row", pa.int64()), ("grams", pa.binary())])


def _wanted_sets(batches: Iterator[pa.RecordBatch], size: int, bits) -> Iterator[pa.RecordBatch]:
    """The sets of texts whose hash the filter holds; the rest isn't looked at. A text seen before in
    this task isn't sent again."""
    seen: set[int] = set()
    for batch in batches:
        rows = batch.column("row").to_numpy()
        there = may_hold(bits.value, rows)
        fresh = np.array([t and r not in seen for r, t in zip(rows.tolist(), there.tolist(), strict=True)], bool)
        chosen = batch.filter(pa.array(fresh))
        if not len(chosen):
            continue
        sets = {}
        for (_, own), row in zip(_sets(chosen.column("text"), size), chosen.column("row").to_pylist(), strict=True):
            sets[row] = own.view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :].tobytes()
        seen.update(sets)
        yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.binary())], schema=_SET)


def _alike(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """The pairs whose whole sets overlap enough."""
    for batch in batches:
        keep = []
        for raws in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist(), strict=True):
            a, b = (np.frombuffer(raw, np.uint8).reshape(-1, WIDTH) for raw in raws)
            both = np.zeros((len(a) + len(b), 8), np.uint8)
            both[:, 8 - WIDTH :] = np.concatenate([a, b])
            both = np.sort(both.view(np.uint64).ravel())
            common = int((both[1:] == both[:-1]).sum())
            keep.append(common * like.den >= (len(both) - common) * like.num)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


#: A block of a component has about so many classes, and shingles, at most.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Shingles that a pair of blocks is compared in at once, as columns of 0 and 1.
COLUMNS = 4096
_COUNTED = pa.schema([("cid", pa.int64()), ("links", pa.int64())])


def _banded(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Adds the band of ``n``. Bands start at 1, and each at the least size that no set of the start
    of the one before is like: sets that are like lie in the same band or in neighbours."""
    starts = [1]
    for batch in batches:
        n = batch.column("n").to_numpy()
        while starts[-1] <= n.max(initial=0):
            starts.append(starts[-1] * like.den // like.num + 1)
        yield batch.append_column("band", pa.array(np.searchsorted(starts, n, "right"), pa.int32()))


def _blocks_met(batches: Iterator[pa.RecordBatch], like: Likeness, counted: bool) -> Iterator[pa.RecordBatch]:
    """The links of each unit: of a block's classes with each other, or with those of one other block.
    Rows come sorted by unit."""
    names = ["component", "lo", "i", "hi", "j"]
    rest, unit = [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names], axis=1)
        cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
        for lo, hi in zip(cuts, np.append(cuts, len(keys))[1:], strict=True):
            if unit is not None and tuple(keys[lo]) != unit:
                yield from _unit_links(rest, like, counted)
                rest = []
            unit = tuple(keys[lo])
            rest.append(batch.slice(int(lo), int(hi - lo)))
    if rest:
        yield from _unit_links(rest, like, counted)


def _unit_links(parts: list[pa.RecordBatch], like: Likeness, counted: bool) -> Iterator[pa.RecordBatch]:
    cid, copies, second = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("cid", "copies", "second"))
    raws = [raw for p in parts for raw in p.column("grams").to_pylist()]
    n = np.array([len(raw) // WIDTH for raw in raws], np.int64)
    grams = np.zeros((int(n.sum()), 8), np.uint8)
    grams[:, 8 - WIDTH :] = np.frombuffer(b"".join(raws), np.uint8).reshape(-1, WIDTH)
    _, grams, seen = np.unique(grams.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    column = np.cumsum(seen > 1) - 1  # what one set only has is in no overlap
    shared = seen[grams] > 1
    owner, grams = np.repeat(np.arange(len(n)), n)[shared], column[grams[shared]]
    order = np.argsort(grams, kind="stable")
    owner, grams = owner[order], grams[order]
    one = not second.any()
    left, right = (np.arange(len(n)),) * 2 if one else (np.flatnonzero(~second), np.flatnonzero(second))
    common = np.zeros((len(left), len(right)), np.float64)
    for lo in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(grams, [lo, lo + COLUMNS])
        has = np.zeros((len(n), min(COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        has[owner[a:b], grams[a:b] - lo] = 1
        common += has[left] @ has[right].T
    alike = common * like.den >= (n[left][:, None] + n[right] - common) * like.num
    if one:
        np.fill_diagonal(alike, False)
    if counted:
        sums = np.zeros(len(n), np.int64)
        sums[left] = (alike @ copies[right].astype(np.float64)).astype(np.int64)
        if not one:
            sums[right] = (copies[left].astype(np.float64) @ alike).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(sums)], schema=_COUNTED)
    else:
        x, y = np.nonzero(np.triu(alike) if one else alike)
        pairs = np.sort(np.stack([cid[left][x], cid[right][y]]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=_PAIR)


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "long", "int32": "int", "binary": "binary"}
    return ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node that each node of ``links`` is linked with, over any number of steps: ``cid,
    component``. Labels go along links and through other labels until none changes. They are written
    each time to the folder of ``spark.checkpoint.dir``."""
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = both.union(both.select("y", "x")).transform(stored, "jaccard")
    labels = both.groupBy(F.col("x").alias("cid")).agg(F.least(F.min("y"), F.first("x")).alias("component")).transform(stored, "jaccard")
    while True:
        near = both.join(labels, F.col("y") == F.col("cid")).groupBy("x").agg(F.min("component").alias("near"))
        new = labels.join(near, F.col("cid") == F.col("x")).select("cid", F.least("component", "near").alias("next"), "component")
        far = new.select(F.col("cid").alias("x"), F.col("next").alias("beyond"))
        new = new.join(far, F.col("next") == F.col("x")).select("cid", "component", F.col("beyond").alias("next")).transform(stored, "jaccard")
        changed = new.where("next <> component").limit(1).count()
        labels = new.select("cid", F.col("next").alias("component"))
        if not changed:
            return labels


class Classes(NamedTuple):
    """``rows``: row (hash of the text), cid, n of every text. ``links``: verified pairs a, b of
    classes, enough to connect every component."""

    rows: DataFrame
    links: DataFrame


def link_classes(docs: DataFrame, text: str = "text", like: Likeness = Likeness()) -> Classes:
    """Classes of equal shingle sets, and links between classes of a Jaccard of at least the bound.

    NULL, empty and blank texts have the empty set, and no links. A text of fewer words than a
    shingle has one shingle. Words are parted by blanks; A-Z count as a-z. Every pair at or above the
    bound ends in one component; of the links themselves, those that would only join classes already
    joined are left out. A class is known by 64 bits of its set, a shingle by 64 bits.
    """
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64(quoted(text)).alias("row"), quoted(text).alias("text"))
    seen = texts.mapInArrow(partial(_describe, size=like.words), _ddl(_SEEN)).transform(stored, "jaccard")
    often = seen.where("hash IS NOT NULL").groupBy("hash").agg(F.sum("n").alias("count"))
    often = often.orderBy(F.desc("count"), "hash").limit(NAMED).collect()  # bounded by NAMED
    hashes = np.array([r["hash"] for r in often], np.int64).view(np.uint64)
    by_hash = np.argsort(hashes)
    places = np.arange(len(often), 0, -1)  # the most frequent stands last
    named = spark.sparkContext.broadcast((hashes[by_hash], places[by_hash]))

    rows = seen.where("hash IS NULL").select("row", F.col("set_a").alias("cid"), "n", "cells")
    classes = rows.where("n > 0").groupBy("cid").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("cells").alias("cells"))
    classes = classes.transform(stored, "jaccard")
    sent = texts.mapInArrow(partial(_postings, like=like, named=named), _ddl(_POSTING))
    sent = sent.repartition("key").sortWithinPartitions("key", "n", "cid").mapInArrow(_lists, _ddl(_MEMBER))
    lists = sent.groupBy("list", "cid").agg(F.max("n").alias("n"), F.min("pos").alias("pos"), F.sum("keys").alias("keys"))
    lists = lists.transform(stored, "jaccard")
    release(spark)

    # A list's hub is the class that shares the most shingles: of near copies the one they come from.
    weights = lists.groupBy("cid").agg(F.sum("keys").alias("weight"))
    hubs = lists.join(weights, "cid").groupBy("list").agg(F.max(F.struct("weight", "cid", "n", "pos")).alias("hub"))
    stars = lists.join(hubs.select("list", "hub.*").toDF("list", "weight", "hub", "hub_n", "hub_pos").transform(stored, "jaccard"), "list")
    stars = stars.where(F.col("cid") != F.col("hub"))
    in_size = (F.least("n", "hub_n") * like.den) >= (F.greatest("n", "hub_n") * like.num)
    rest = F.least(F.col("hub_n") - F.col("hub_pos"), F.col("n") - F.col("pos"))
    in_place = rest * (like.num + like.den) >= (F.col("hub_n") + F.col("n")) * like.num
    stars = stars.where(in_size & in_place)
    stars = stars.select(F.least("hub", "cid").alias("a"), F.greatest("hub", "cid").alias("b")).distinct().transform(stored, "jaccard")
    links = _verified(stars, classes, texts, like).transform(stored, "jaccard")
    release(spark)
    known = components(spark, links)
    release(spark)

    parted = lists.join(known, "cid", "left").select("list", "cid", "n", "pos", F.coalesce("component", "cid").alias("component"))
    parted = parted.transform(stored, "jaccard")
    open_lists = parted.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    pairs = parted.join(open_lists.where("lo <> hi").select("list"), "list")
    pairs = pairs.repartition("list").sortWithinPartitions("list", "n", "cid")
    pairs = pairs.mapInArrow(partial(_across, like=like), _ddl(_PAIR)).distinct().join(stars, ["a", "b"], "left_anti")
    pairs = pairs.transform(stored, "jaccard")
    release(spark)
    more = _verified(pairs, classes, texts, like)
    return Classes(rows.select("row", "cid", "n"), links.union(more))


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    sides = [classes.select(F.col("cid").alias(s), F.col("n").alias(f"n_{s}"), F.col("cells").alias(f"cells_{s}")) for s in "ab"]
    sized = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "cells_a", "cells_b")
    sized = sized.mapInArrow(partial(_near_in_cells, like=like), _ddl(_PAIR)).transform(stored, "jaccard")
    rows = [classes.select(F.col("cid").alias(s), F.col("row").alias(f"row_{s}")) for s in "ab"]
    wanted = sized.join(rows[0], "a").join(rows[1], "b").transform(stored, "jaccard")
    bits = filter_of(wanted.select(F.explode(F.array("row_a", "row_b")).alias("row")))
    bits = texts.sparkSession.sparkContext.broadcast(bits)
    # Dealt by the text's hash once, for the removal of copies; both joins find them there.
    sets = texts.mapInArrow(partial(_wanted_sets, size=like.words, bits=bits), _ddl(_SET)).dropDuplicates(["row"])
    sides = [sets.select(F.col("row").alias(f"row_{s}"), F.col("grams").alias(f"grams_{s}")) for s in "ab"]
    whole = wanted.join(sides[0], "row_a").join(sides[1], "row_b").select("a", "b", "grams_a", "grams_b")
    return whole.mapInArrow(partial(_alike, like=like), _ddl(_PAIR))


def _met(docs: DataFrame, text: str, like: Likeness, found: Classes, known: DataFrame, counted: bool) -> DataFrame:
    """All links inside the components ``known``: pairs of classes, or their copies added up per class.

    A class goes to one unit for each block of its own band and of the bands beside it. A component of
    one block is one unit. Each pair of classes that can be alike meets in exactly one unit.
    """
    texts = docs.select(F.xxhash64(quoted(text)).alias("row"), quoted(text).alias("text"))
    classes = found.rows.where("n > 0").groupBy("cid").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    members = classes.join(known, "cid").select("cid", "row", "n", "copies", "component")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema) + ", band int"
    members = members.mapInArrow(partial(_banded, like=like), kind).transform(stored, "jaccard")
    bands = members.groupBy("component", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))

    def blocks(c: str, s: str) -> Column:
        return F.ceil(F.greatest(F.col(c) / BLOCK, F.col(s) / BLOCK_SHINGLES)).cast("int")

    # A component has few bands: they grow with the logarithm of the sizes.
    bands = bands.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("band", blocks("c", "s")))).alias("blocks"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    # A plain table, so that the join can split a large component.
    bands = bands.select("component", "blocks", (blocks("c", "s") <= 1).alias("whole")).transform(stored, "jaccard")
    dealt = members.join(bands, "component")

    def count(step: int) -> Column:
        return F.coalesce(F.element_at("blocks", F.col("band") + step), F.lit(0))

    def units(step: int, make) -> Column:
        every = F.sequence(F.lit(0), F.greatest(count(step), F.lit(1)) - 1)
        return F.transform(F.filter(every, lambda j: j < count(step)), make)

    def unit(lo, i, hi, j, second) -> Column:
        return F.struct(lo.alias("lo"), i.alias("i"), hi.alias("hi"), j.alias("j"), second.alias("second"))

    zero, band, own = F.lit(0), F.col("band"), F.col("own")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cid"), count(0)).cast("int"))
    every = F.concat(
        units(0, lambda j: unit(band, F.least(own, j), band, F.greatest(own, j), own > j)),
        units(1, lambda j: unit(band, own, band + 1, j, F.lit(False))),
        units(-1, lambda j: unit(band - 1, j, band, own, F.lit(True))),
    )
    every = F.when(F.col("whole"), F.array(unit(zero, zero, zero, zero, F.lit(False)))).otherwise(every)
    dealt = dealt.select("row", "cid", "copies", "component", every.alias("units")).transform(stored, "jaccard")
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(dealt.select("row")))
    sets = texts.mapInArrow(partial(_wanted_sets, size=like.words, bits=bits), _ddl(_SET)).dropDuplicates(["row"])
    dealt = dealt.join(sets, "row").select("cid", "copies", "component", "grams", F.explode("units").alias("unit"))
    names = ["component", "lo", "i", "hi", "j"]
    dealt = dealt.select("component", "unit.*", "cid", "copies", "grams").repartition(*names).sortWithinPartitions(*names, "cid")
    return dealt.mapInArrow(partial(_blocks_met, like=like, counted=counted), _ddl(_COUNTED if counted else _PAIR))


def all_links(docs: DataFrame, text: str = "text", like: Likeness = Likeness()) -> Classes:
    """As ``link_classes``, but with every pair of classes at or above the bound, each once. A group of
    near copies has as many rows as pairs; for the numbers alone, see ``jaccard_components``."""
    found = link_classes(docs, text, like)
    found = found._replace(links=found.links.transform(stored, "jaccard"))
    known = components(docs.sparkSession, found.links)
    return Classes(found.rows, _met(docs, text, like, found, known, False))


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness(), count_links: bool = False
) -> DataFrame:
    """One row per document: its key, ``n_shingles`` and ``component_id``, the smallest key that it
    is linked with over any number of links, its own included. Repeated rows stay rows of their own.
    Without shingles, a document's component is its own key. NULL keys never are the smallest.
    ``count_links`` adds ``n_links``: how many other documents (rows) it is linked with directly, copies
    among them; each pair of a component that can be alike is compared for it.
    """
    rows = docs.select(quoted(key).alias("key"), F.xxhash64(quoted(text)).alias("row"))
    named = _named(rows, docs, text, like, count_links).select("key", "n", "component", *["n_links"] * count_links).transform(stored, "jaccard")
    # A plain table, so that the join can split a component that a large part of the rows is in.
    least = named.groupBy("component").agg(F.min("key").alias("least")).transform(stored, "jaccard")
    named = named.join(least, "component")
    return named.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("least", "key")).otherwise(F.col("key")).alias("component_id"),
        *["n_links"] * count_links,
    )


def _named(rows: DataFrame, docs: DataFrame, text: str, like: Likeness, count_links: bool = False) -> DataFrame:
    """``rows``, which have the text's hash as ``row``, with n and component (the least class), and
    n_links if asked for."""
    found = link_classes(docs, text, like)
    if count_links:
        found = found._replace(links=found.links.transform(stored, "jaccard"))
    known = components(docs.sparkSession, found.links)
    # A text that stands in many documents is one row here.
    by_text = found.rows.dropDuplicates(["row"]).join(known, "cid", "left")
    by_text = by_text.select("cid", "row", "n", F.coalesce("component", "cid").alias("component"))
    if count_links:
        linked = _met(docs, text, like, found, known, True).groupBy("cid").agg(F.sum("links").alias("links"))
        copies = found.rows.where("n > 0").groupBy("cid").agg(F.count(F.lit(1)).alias("copies"))
        numbers = copies.join(linked, "cid", "left").select("cid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        by_text = by_text.join(numbers, "cid", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    return rows.join(by_text.drop("cid").transform(stored, "jaccard"), "row")


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """The documents with their columns as they are, one of each component: that with the least key,
    and of rows with that key the one with the least hash; once, if the very row is repeated. All
    rows without words stay. NULL keys come after all others.
    """
    own = next(n for k in range(len(docs.columns) + 1) if (n := f"__row{k}") not in docs.columns)
    marked = docs.withColumn(own, row_hash(docs))
    worded = F.coalesce(quoted(text).rlike(f"[^{BLANKS}]"), F.lit(False))
    rows = marked.where(worded).select(quoted(key).alias("key"), F.xxhash64(quoted(text)).alias("row"), F.col(own).alias("__row"))
    named = _named(rows, docs, text, like)
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "__row"))
    kept = named.groupBy("component").agg(first.alias("first")).select(F.col("first.__row").alias(own))
    whole = marked.where(worded).dropDuplicates([own]).join(kept, own, "left_semi")
    return docs.where(~worded).unionByName(whole.drop(own))
