"""Language-model scores by Brown's class-based bigrams.

Each word of the training texts has one class; a text's probability is that of its classes, each given
the one before, times that of each word within its class. Classes come from exchange clustering, which
maximises the probability of the training texts under this model: the most frequent words are moved
from class to class as long as that gains anything, and every other word then joins the class that
gains the most by the neighbours it has in all the texts. Counts of words, pairs of words, neighbours
and pairs of classes are of all training texts.

How it is dealt out. The words to exchange are few by a parameter, so that pairs among them are a
bounded table; it is grouped by word once, and a round of moves is one pass over these rows with
the classes and their pair counts as broadcasts. The vocabulary grows with the texts and is a table.
Its most frequent words, as many as a parameter says, go to all tasks when texts are read for classes;
what a task can't resolve by them is looked up by a join, as distinct words of distinct texts, so that
no frequent word and no repeated text is a hot key. A text then is a string of class numbers, and
pairs of classes are counted, and texts scored, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import quoted
from maskwright.llm.slices import Tally, summed, text_slices
from maskwright.llm.store import stored
from maskwright.llm.wordhash import NOT_BLANK, drawn, hashed_words


class Shape(NamedTuple):
    """``classes``: one of them is for the ends of texts; at most 100. ``exchanged``: words that move
    between classes. ``sweeps``: rounds of moves, each of half of these words, or
    of fewer once a round has gained nothing. ``at_hand``: words that all tasks know; 17 bytes each in the broadcast."""

    classes: int = 64
    exchanged: int = 8_192
    sweeps: int = 8
    at_hand: int = 1 << 20


class Model(NamedTuple):
    """``vocabulary``: word (hash), n, class of every training word and of the end. ``tokens`` and
    ``words``: sum and number of these rows. ``discount``: what a word's count gives to unknown words.
    ``sizes`` and ``members``: tokens and words of each class. ``steps``: log10 of the probability of a
    class after a class; the last row and column are for unknown words."""

    vocabulary: DataFrame
    tokens: int
    words: int
    discount: float
    sizes: np.ndarray
    members: np.ndarray
    steps: np.ndarray


#: Stands for the end of a text, and for what comes before its first word.
END = drawn(1, 41)[0]
#: Codes in strings of classes: those of words seen once are so much higher; unknown; still to look up.
ONCE, UNKNOWN, OPEN = 128, 254, 255
#: Occurrences whose neighbours, and words or pairs whose counts, are held before they are sent.
HELD = 1 << 20
#: Bytes of text, or of classes, handled at once: each takes some dozens of bytes meanwhile.
PIECE = 1 << 20


def held_out(key: Column) -> Column:
    """The rows that nothing is learned from; a NULL key's text is empty, which makes it one of them."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _token_slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Batch, first row, tokens of a slice of texts one after another, each text's end among them, and
    the number of each text's tokens."""
    for batch in batches:
        for first, data, offsets in text_slices(batch.column(text), PIECE):
            words, texts = hashed_words(data, offsets, NOT_BLANK)
            counts = np.bincount(texts, minlength=len(offsets) - 1)
            yield batch, first, np.insert(words, np.cumsum(counts), END), counts + 1


def _before(tokens: np.ndarray, first) -> np.ndarray:
    """What stands before each token; before a text, the end of another, here ``first``."""
    return np.concatenate([[first], tokens[:-1]]).astype(tokens.dtype)


def _rows(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


# --- counts over the training texts ------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally(HELD)
    for _, _, tokens, _ in _token_slices(batches):
        words, counts = np.unique(tokens[tokens != END], return_counts=True)
        for w, n in tally.add(words, counts):
            yield _rows(["word", "n"], w.view(np.int64), n)
    for w, n in tally.rest():
        yield _rows(["word", "n"], w.view(np.int64), n)


class Lexicon(NamedTuple):
    """Sorted hashes of words and what goes with each."""

    words: np.ndarray
    ids: np.ndarray

    def look_up(self, tokens: np.ndarray, missing: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[at] == tokens, self.ids[at], missing)


def _lexicon(words: np.ndarray, ids: np.ndarray) -> Lexicon:
    order = np.argsort(words)
    return Lexicon(words[order], ids[order])


def _count_pairs(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """Pairs of adjoining words that are both known, by number."""
    lexicon, tally = known.value, Tally(HELD)
    width = len(lexicon.words)
    for _, _, tokens, _ in _token_slices(batches):
        ids = lexicon.look_up(tokens, -1)
        before = _before(ids, 0)
        both = (ids >= 0) & (before >= 0)
        pairs, counts = np.unique(before[both] * width + ids[both], return_counts=True)
        for p, n in tally.add(pairs, counts):
            yield _rows(["pair", "n"], p, n)
    for p, n in tally.rest():
        yield _rows(["pair", "n"], p, n)


# --- exchange clustering -----------------------------------------------------------


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def objective(pairs: np.ndarray) -> float:
    """The part of the log likelihood that depends on the classes, by the counts of their pairs."""
    return float(_f(pairs).sum() - _f(pairs.sum(axis=1)).sum() - _f(pairs.sum(axis=0)).sum())


def best_class(pairs: np.ndarray, right: np.ndarray, left: np.ndarray, itself: float, own: int) -> int:
    """The class a word best stands in. ``right`` and ``left``: how often each class comes after and
    before the word; ``itself``: how often the word itself does, counted in both under ``own``, its
    class so far (-1: none). The first class is never joined."""
    m = pairs
    if own >= 0:
        m = pairs.copy()
        m[own] -= right
        m[:, own] -= left
        m[own, own] += itself
        right, left = right.copy(), left.copy()
        right[own] -= itself
        left[own] -= itself
    # How often each class stands before and after anything, steps to and from the word among it.
    after, before = m.sum(axis=1) + left, m.sum(axis=0) + right
    gain = (_f(m + right) - _f(m)).sum(axis=1) + (_f(m + left[:, None]) - _f(m)).sum(axis=0)
    diagonal = m.diagonal()
    gain += _f(diagonal + right + left + itself) + _f(diagonal) - _f(diagonal + right) - _f(diagonal + left)
    gain -= _f(after + right.sum() + itself) - _f(after) + _f(before + left.sum() + itself) - _f(before)
    gain[0] = -np.inf
    best = int(np.argmax(gain))
    return own if own >= 0 and gain[best] <= gain[own] + 1e-9 else best


def _contexts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Word, the words beside it, how often, and whether after it."""
    lists = batch.column("beside")
    flat = lists.flatten()
    other, n, after = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("other", "n", "after"))
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    for word, lo, hi in zip(batch.column("word").to_pylist(), np.append(0, ends[:-1]), ends, strict=True):
        yield word, other[lo:hi], n[lo:hi], after[lo:hi]


def _count_class_pairs(batches: Iterator[pa.RecordBatch], classes, width: int) -> Iterator[pa.RecordBatch]:
    classes, total = classes.value, np.zeros(width * width, np.int64)
    for batch in batches:
        for word, other, n, after in _contexts(batch):
            if classes[word] >= 0:
                good = after & (classes[other] >= 0)
                np.add.at(total, classes[word] * width + classes[other[good]], n[good])
    cells = np.flatnonzero(total)
    yield _rows(["cell", "n"], cells, total[cells])


def _move(batches: Iterator[pa.RecordBatch], classes, pairs: np.ndarray, turn: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The best classes of the words whose turn it is, one in ``parts``; turn -1 is that of words without
    a class."""
    classes, width = classes.value, len(pairs)
    for batch in batches:
        words, found = [], []
        for word, other, n, after in _contexts(batch):
            own = int(classes[word])
            if word == 0 or (own >= 0 if turn < 0 else word % parts != turn % parts):
                continue
            good = classes[other] >= 0
            right, left = (np.bincount(classes[other[side]], n[side], width) for side in (good & after, good & ~after))
            itself = float(n[after & (other == word)].sum()) if own >= 0 else 0.0
            words.append(word)
            found.append(best_class(pairs, right, left, itself, own))
        yield _rows(["word", "class"], np.array(words, np.int64), np.array(found, np.int64))


def _table_of(cells: DataFrame, width: int) -> np.ndarray:
    """Sums by cell as a square table: at most ``width`` squared rows."""
    out = np.zeros(width * width)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(width, width)


def exchange(pairs: DataFrame, n_words: int, shape: Shape = Shape()) -> np.ndarray:
    """The classes of words 0 to ``n_words`` - 1, by frequency, from the counts ``v, w, n`` of their
    pairs. Word 0 is the end of a text, alone in class 0. The most frequent others begin in classes of
    their own, the rest join them; then words move, half of them at a time. Ties go to the first
    class. Moves of one round don't see each other: a round that gains nothing is undone, and from then on
    half as many words move at a time."""
    spark = pairs.sparkSession
    sides = pairs.select(F.col("v").alias("word"), F.struct(F.col("w").alias("other"), "n", F.lit(True).alias("after")).alias("beside"))
    sides = sides.unionAll(pairs.select(F.col("w").alias("word"), F.struct(F.col("v").alias("other"), "n", F.lit(False).alias("after")).alias("beside")))
    beside = stored(sides.groupBy("word").agg(F.collect_list("beside").alias("beside")), "beside")
    def counted(own: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(own)
        return _table_of(beside.mapInArrow(partial(_count_class_pairs, classes=sent, width=shape.classes), "cell long, n long"), shape.classes)

    def moved(own: np.ndarray, table: np.ndarray, turn: int, parts: int) -> np.ndarray:
        sent, out = spark.sparkContext.broadcast(own), own.copy()
        for r in beside.mapInArrow(partial(_move, classes=sent, pairs=table, turn=turn, parts=parts), "word long, class long").collect():
            out[r["word"]] = r["class"]
        return out

    first = np.where(np.arange(n_words) < shape.classes, np.arange(n_words), -1)
    best = moved(first, counted(first), -1, 1)
    best[best < 0] = min(1, shape.classes - 1)  # words with no neighbour to go by
    table, parts = counted(best), 2
    for turn in range(shape.sweeps):
        classes = moved(best, table, turn, parts)
        if (classes == best).all():
            continue
        after = counted(classes)
        if objective(after) > objective(table):
            best, table = classes, after
        else:
            parts *= 2
    return best


# --- the vocabulary ------------------------------------------------------------------


def _neighbours(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """Of each word that has no class yet, the classes on its left and right, two bytes an occurrence."""
    lexicon = known.value
    held: list[tuple[np.ndarray, ...]] = []

    def sent() -> pa.RecordBatch:
        words, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(words, kind="stable")
        words = words[order]
        first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        data = np.stack([left[order], right[order]], axis=1).tobytes()
        places = (2 * np.append(first, len(words))).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(words[first].view(np.int64)), packed], names=["word", "beside"])

    for _, _, tokens, _ in _token_slices(batches):
        own = lexicon.look_up(tokens, OPEN).astype(np.uint8)
        right = np.append(own[1:], OPEN).astype(np.uint8)
        new = np.flatnonzero(own == OPEN)
        if len(new):
            held.append((tokens[new], _before(own, 0)[new], right[new]))
        if sum(len(h[0]) for h in held) > HELD:
            yield sent()
            held = []
    if held:
        yield sent()


def _join_classes(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Count and class of each word, from sorted rows of its neighbours. ``gains``: what each class gains by
    a class on the left, by none there, by a class on the right, by none there."""
    width = len(gains) // 2
    held = None  # word, its occurrences and its neighbours' counts
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column("word").to_numpy()
        first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
        data = batch.column("beside").cast(pa.large_binary())
        size = pc.binary_length(data).to_numpy() // 2
        codes = np.frombuffer(data.buffers()[2], np.uint8)
        start = np.frombuffer(data.buffers()[1], np.int64)[data.offset]
        codes = codes[start : start + 2 * int(size.sum())].astype(np.int64)
        codes = np.minimum(codes, width - 1)  # neighbours without a class stand last
        owner = np.repeat(group, size)
        cells = [owner * (2 * width) + codes[0::2], owner * (2 * width) + width + codes[1::2]]
        table = sum(np.bincount(c, minlength=len(first) * 2 * width) for c in cells).reshape(len(first), 2 * width)
        counts = np.bincount(owner, minlength=len(first))
        words = words[first]
        if held is not None and held[0] == words[0]:
            counts[0] += held[1]
            table[0] += held[2]
        elif held is not None:
            yield _joined(np.array([held[0]]), np.array([held[1]]), held[2][None, :], gains)
        held = (words[-1], counts[-1], table[-1])
        yield _joined(words[:-1], counts[:-1], table[:-1], gains)
    if held is not None:
        yield _joined(np.array([held[0]]), np.array([held[1]]), held[2][None, :], gains)


def _joined(words: np.ndarray, counts: np.ndarray, table: np.ndarray, gains: np.ndarray) -> pa.RecordBatch:
    best = np.argmax(table @ gains, axis=1) if len(words) else np.zeros(0, np.int64)
    return _rows(["word", "n", "class"], words, counts, best.astype(np.int64))


def _gains(pairs: np.ndarray) -> np.ndarray:
    """What a word gains the likelihood in each class by one neighbour: the slope of the exchange
    criterion, which for a word of few occurrences is the gain. Neighbours without a class say
    nothing; where nothing is said, classes with more tokens come first."""
    width = len(pairs)
    smooth = pairs + 0.5
    ratio = np.log(smooth * smooth.sum() / (smooth.sum(axis=1)[:, None] * smooth.sum(axis=0)))
    none = np.zeros((1, width))
    out = np.concatenate([ratio, none, ratio.T, none])  # on the left: how much likelier a class is after it
    out += 1e-12 * smooth.sum(axis=0) / smooth.sum()
    out[:, 0] = -1e9  # the end's own class
    return out


def learn_vocabulary(texts: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Count and class of every word of a table with a column ``text``: ``word`` (its hash), ``n``,
    ``class``; the end of a text is a row too, if there are texts. Each row is a training text,
    repeated ones too. NULL counts as empty."""
    if not 2 <= shape.classes <= 100:
        raise ValueError("There are 2 to 100 classes.")
    spark = texts.sparkSession
    texts = texts.select("text")
    words = texts.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.desc("n"), "word").limit(shape.exchanged).collect()
    top.sort(key=lambda r: (-r["n"], r["word"]))
    n_texts = texts.count()
    hashes = np.array([END.view(np.int64), *(r["word"] for r in top)], np.int64).view(np.uint64)
    counts = np.array([n_texts, *(r["n"] for r in top)], np.int64)
    width = len(hashes)

    ids = spark.sparkContext.broadcast(_lexicon(hashes, np.arange(width)))
    pairs = texts.mapInArrow(partial(_count_pairs, known=ids), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = stored(pairs.select(F.floor(F.col("pair") / F.lit(width)).alias("v"), (F.col("pair") % width).alias("w"), "n"), "word-pairs")
    classes = exchange(pairs, width, shape)

    sent = spark.sparkContext.broadcast(classes)
    cells = pairs.select("v", "w", "n").mapInArrow(partial(_cells, classes=sent, width=shape.classes), "cell long, n long")
    gains = _gains(_table_of(cells, shape.classes))
    known = spark.sparkContext.broadcast(_lexicon(hashes, classes))
    beside = texts.mapInArrow(partial(_neighbours, known=known), "word long, beside binary")
    others = beside.repartition("word").sortWithinPartitions("word").mapInArrow(partial(_join_classes, gains=gains), "word long, n long, class long")
    first = spark.createDataFrame(list(zip(hashes.view(np.int64).tolist(), counts.tolist(), classes.tolist(), strict=True)), "word long, n long, class long")
    return stored(others.unionAll(first.where("n > 0")), "vocabulary")


def _cells(batches: Iterator[pa.RecordBatch], classes, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v, w, n = (batch.column(c).to_numpy() for c in ("v", "w", "n"))
        cells, sums = summed(classes.value[v] * width + classes.value[w], n)
        yield _rows(["cell", "n"], cells, sums)


# --- texts as strings of classes -------------------------------------------------------


class AtHand(NamedTuple):
    """The words that all tasks know: sorted hashes, counts, classes."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray


class Marks(NamedTuple):
    """What a token adds to the scores but for its step: by counts and classes."""

    tokens: int
    words: int
    discount: float
    sizes: np.ndarray
    members: np.ndarray

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.words + 1)))

    def within(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The log10 probability of a known word in its class."""
        return np.log10((counts - self.discount) / (self.sizes[classes] - self.discount * self.members[classes]))


def _at_hand(vocabulary: DataFrame, most: int) -> AtHand:
    """The most frequent words, at most so many, and all of a count or none. The count to stop at comes
    from the numbers of words by count, counts above 1,000 by their size to two digits."""
    n = F.col("n")
    scale = F.pow(F.lit(10.0), F.floor(F.log10(n.cast("double"))) - 1)
    group = F.when(n <= 1000, n).otherwise((F.floor(n / scale) * scale).cast("long"))
    sizes = vocabulary.groupBy(group.alias("least")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("least")).collect()
    least, total = None, 0
    for r in sizes:
        total += r["words"]
        if total > most:
            break
        least = r["least"]
    rows = vocabulary.where(n >= least if least is not None else F.lit(False)).toArrow()
    words, counts, classes = (rows.column(c).to_numpy() for c in ("word", "n", "class"))
    order = np.argsort(words.view(np.uint64))
    return AtHand(words.view(np.uint64)[order], counts[order], classes[order].astype(np.uint8))


_ENCODED = "n_tokens long, n_known long, base double, within double, codes binary, open array<long>"


def _encode(batches: Iterator[pa.RecordBatch], at_hand, marks: Marks, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The columns ``names`` of each text, its tokens' number, what its known tokens add up to, its
    classes, and the words to look up."""
    hand = at_hand.value
    for batch, first, tokens, counts in _token_slices(batches):
        if len(hand.words):
            at = np.minimum(np.searchsorted(hand.words, tokens), len(hand.words) - 1)
            known = hand.words[at] == tokens
        else:
            at, known = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        text = np.repeat(np.arange(len(counts)), counts)
        codes = np.full(len(tokens), OPEN, np.uint8)
        at = at[known]
        n, kind = hand.counts[at], hand.classes[at]
        codes[known] = kind + ONCE * (n == 1).astype(np.uint8)
        sums = [np.bincount(text[known], x, len(counts)).astype(np.float64) for x in (marks.base(n), marks.within(n, kind))]
        left, owner = tokens[~known].view(np.int64), text[~known]
        ends = np.cumsum(counts)
        raw = codes.tobytes()
        packed = pa.array([raw[e - c : e] for c, e in zip(counts.tolist(), ends.tolist(), strict=True)], pa.binary())
        borders = np.append(0, np.cumsum(np.bincount(owner, minlength=len(counts)))).astype(np.int32)
        opened = pa.ListArray.from_arrays(pa.array(borders), pa.array(left))
        rows = batch.slice(first, len(counts))
        yield pa.RecordBatch.from_arrays(
            [rows.column(c) for c in names] + [pa.array(counts), pa.array(np.bincount(text[known], minlength=len(counts))), *map(pa.array, sums), packed, opened],
            names=[*names, "n_tokens", "n_known", "base", "within", "codes", "open"],
        )


def _resolve(batches: Iterator[pa.RecordBatch], marks: Marks) -> Iterator[pa.RecordBatch]:
    """The classes of all tokens, those looked up put in."""
    for batch in batches:
        codes, opened, found = (batch.column(c) for c in ("codes", "open", "found"))
        base, within, known = (batch.column(c).to_numpy().copy() for c in ("base", "within", "n_known"))
        out = []
        for i in range(batch.num_rows):
            raw = np.frombuffer(codes[i].as_py(), np.uint8).copy()
            own = np.array(opened[i].values if opened[i].is_valid else [], np.int64)
            if len(own):
                counts, kinds = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                if found[i].is_valid:
                    rows = found[i].values
                    words, n, kind = (rows.field(c).to_numpy() for c in ("word", "n", "class"))
                    order = np.argsort(words)
                    at = order[np.minimum(np.searchsorted(words, own, sorter=order), len(words) - 1)]
                    hit = words[at] == own
                    counts[hit], kinds[hit] = n[at][hit], kind[at][hit]
                hit = counts > 0
                raw[raw == OPEN] = np.where(hit, kinds + ONCE * (counts == 1), UNKNOWN)
                base[i] += marks.base(counts).sum()
                within[i] += marks.within(counts[hit], kinds[hit]).sum()
                known[i] += hit.sum()
            out.append(raw.tobytes())
        columns = [batch.column(c) for c in ("one", "two", "copies", "n_tokens")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(known), pa.array(base), pa.array(within), pa.array(out, pa.binary())],
            names=["one", "two", "copies", "n_tokens", "n_known", "base", "within", "codes"],
        )


def encoded(docs: DataFrame, vocabulary: DataFrame, marks: Marks, at_hand: int, text: str, counted: Column) -> tuple[DataFrame, DataFrame]:
    """All rows by two hashes of their text (``one, two``), the other columns as ``kept``; and the
    distinct texts as strings of classes, with ``copies``: the rows that ``counted`` says."""
    spark = docs.sparkSession
    hand = spark.sparkContext.broadcast(_at_hand(vocabulary, at_hand))
    names = ("kept", "one", "two", "counted")
    own = F.coalesce(quoted(text), F.lit(""))
    others = [quoted(c) for c in docs.columns if c != text]
    kept = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    rows = docs.select(kept.alias("kept"), F.xxhash64(own).alias("one"), F.xxhash64(F.lit(1), own).alias("two"), counted.alias("counted"), own.alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    rows = stored(rows.mapInArrow(partial(_encode, at_hand=hand, marks=marks, names=names), f"{kinds}, {_ENCODED}"), "classed-rows")
    same = ["one", "two"]
    inside = F.struct("n_tokens", "n_known", "base", "within", "codes", "open")
    distinct = rows.groupBy(*same).agg(F.first(inside).alias("t"), F.count_if("counted").alias("copies")).select(*same, "copies", "t.*")
    opened = rows.where(F.size("open") > 0).select(*same, F.explode(F.array_distinct("open")).alias("word")).distinct()
    found = opened.join(vocabulary, "word").groupBy(*same).agg(F.collect_list(F.struct("word", "n", "class")).alias("found"))
    kinds = "one long, two long, copies long, n_tokens long, n_known long, base double, within double, codes binary"
    return rows.select(*same, "kept"), stored(distinct.join(found, same, "left").mapInArrow(partial(_resolve, marks=marks), kinds), "classed-texts")


def _both(codes: np.ndarray, unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes, and where a word was seen once."""
    return np.where(codes == UNKNOWN, unknown, codes & (ONCE - 1)).astype(np.int64), (codes >= ONCE) & (codes < UNKNOWN)


def _code_slices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, data, offsets in text_slices(batch.column("codes"), PIECE):
        yield first, data, offsets


def _count_steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Steps from class to class in training texts. A word seen once also counts as an unknown one:
    that is what it would be in the texts without it."""
    total = np.zeros((width + 1) * (width + 1), np.int64)
    for batch in batches:
        copies = batch.column("copies").to_numpy()
        for first, data, offsets in _code_slices(batch):
            n = np.repeat(copies[first : first + len(offsets) - 1], np.diff(offsets))
            kind, once = _both(data, width)
            before, before_once = _before(kind, 0), _before(once, False)
            for rows, columns, where in (
                (before, kind, n > 0), (np.full_like(kind, width), kind, before_once & (n > 0)),
                (before, np.full_like(kind, width), once & (n > 0)), (np.full_like(kind, width), np.full_like(kind, width), once & before_once & (n > 0)),
            ):
                total += np.bincount(rows[where] * (width + 1) + columns[where], n[where], len(total)).astype(np.int64)
    cells = np.flatnonzero(total)
    yield _rows(["cell", "n"], cells, total[cells])


def step_scores(counts: np.ndarray) -> np.ndarray:
    """log10 of the probabilities of steps, from their counts; the last row and column are for unknown
    words. A class's probability after another is smoothed with its own, by as many counts as classes
    have been seen there; that of unknown words with theirs, by ten."""
    known = counts[:, :-1]
    total = known[:-1].sum()
    if not total:
        return np.where(np.arange(len(counts)) == len(counts) - 1, 0.0, -np.inf) * np.ones((len(counts), 1))
    after = known.sum(axis=1)
    unknown = (counts[:, -1] + 10 * (counts[:-1, -1].sum() + 0.5) / (total + 1)) / (after + 10)
    kinds = np.maximum((known > 0).sum(axis=1), 1)
    own = known[:-1].sum(axis=0) / total
    steps = (known + kinds[:, None] * own) / (after + kinds)[:, None] * (1 - unknown)[:, None]
    with np.errstate(divide="ignore"):
        return np.log10(np.concatenate([steps, unknown[:, None]], axis=1))


def _marks(vocabulary: DataFrame, width: int) -> Marks:
    sizes, members = np.zeros(width), np.zeros(width)
    once = twice = tokens = words = 0
    n = F.col("n")
    for r in vocabulary.groupBy("class").agg(F.sum(n).alias("n"), F.count(n).alias("words"), F.count_if(n == 1).alias("once"), F.count_if(n == 2).alias("twice")).collect():
        sizes[r["class"]], members[r["class"]] = r["n"], r["words"]
        once, twice, tokens, words = once + r["once"], twice + r["twice"], tokens + r["n"], words + r["words"]
    discount = min(once / (once + 2 * twice), 0.9) if once else 0.0
    return Marks(tokens, words, discount, sizes, members)


def _steps(known: DataFrame, width: int) -> np.ndarray:
    return step_scores(_table_of(known.mapInArrow(partial(_count_steps, width=width), "cell long, n long"), width + 1))


def _score_steps(batches: Iterator[pa.RecordBatch], steps: np.ndarray) -> Iterator[pa.RecordBatch]:
    width = len(steps) - 1
    for batch in batches:
        score = batch.column("within").to_numpy().copy()
        for first, data, offsets in _code_slices(batch):
            kind, _ = _both(data, width)
            score[first : first + len(offsets) - 1] += np.add.reduceat(steps[_before(kind, 0), kind], offsets[:-1])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("one", "two", "n_tokens", "n_known", "base")), pa.array(score)], names=["one", "two", "n_tokens", "n_known", "base_score", "score"]
        )


_SCORED = "one long, two long, n_tokens long, n_known long, base_score double, score double"


def _with_scores(rows: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    scores = known.mapInArrow(partial(_score_steps, steps=model.steps), _SCORED)
    found = rows.join(scores, ["one", "two"])
    added = ["n_tokens", "n_known", "base_score", "score"]
    kept = [F.col("kept").getField(c).alias(c) for c in rows.schema["kept"].dataType.names if c.lower() not in added]
    return found.select(*kept, *added)


def train(texts: DataFrame, text: str = "text", shape: Shape = Shape()) -> Model:
    """The model of the texts of a table. An empty text has its end as its only token. Without rows,
    every word is unknown, and certain."""
    texts = texts.select(quoted(text).alias("text"))
    vocabulary = learn_vocabulary(texts, shape)
    marks = _marks(vocabulary, shape.classes)
    _, known = encoded(texts, vocabulary, marks, shape.at_hand, "text", F.lit(True))
    return Model(vocabulary, *marks, _steps(known, shape.classes))


def score(docs: DataFrame, model: Model, text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """All rows without their text, with ``n_tokens`` (words, and the end), ``n_known`` (those of the
    training texts), ``base_score`` (of single words, each count raised by 0.1) and ``score``, both log10
    of a probability; they take the place of columns of such names. NULL counts as empty. The
    perplexity of a text is ``pow(10, -score / n_tokens)``.

    All words that were not in the training texts are one event, as likely after a class as words seen
    once. Copies of a text are scored once; texts are known by two hashes of 64 bits, words by one.
    """
    marks = Marks(*model[1:6])
    rows, known = encoded(docs, model.vocabulary, marks, shape.at_hand, text, F.lit(False))
    return _with_scores(rows, known, model)


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score, by a
    model of the documents that are not held out (one in ten is, by its key; a NULL key always).
    Repeated rows and rows with one key are documents of their own. The texts are read for their
    classes once, for counting and for scoring."""
    rows = docs.select(quoted(key).alias("key"), quoted(text).alias("text"))
    vocabulary = learn_vocabulary(rows.where(~held_out(F.col("key"))), shape)
    marks = _marks(vocabulary, shape.classes)
    rows, known = encoded(rows, vocabulary, marks, shape.at_hand, "text", ~held_out(F.col("key")))
    model = Model(vocabulary, *marks, _steps(known.where("copies > 0"), shape.classes))
    found = _with_scores(rows, known, model)
    return found.select(
        F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "n_tokens", "n_known",
        F.lit(marks.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
