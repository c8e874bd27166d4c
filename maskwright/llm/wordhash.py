"""Words of whole Arrow batches as 64-bit hashes, with numpy over the UTF-8 bytes.

A batch is worked through in pieces of a few MB, cut between words: memory follows the number of
words, and a long text is no special case.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes handled at once.
PIECE = 1 << 21
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def drawn(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudorandom numbers."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * _STEP)


def byte_table(outside: bytes) -> np.ndarray:
    """Which bytes belong to words, given those that don't. Bytes of longer characters always do."""
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


#: The blanks that part words.
BLANK_BYTES = bytes([0x20, *range(0x09, 0x0E)])
NOT_BLANK = byte_table(BLANK_BYTES)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = drawn(256, 1)[_LOWER]


def utf8_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array, and where each text starts and the last ends. NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def hashed_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, A-Z taken as a-z, and the number of the text each stands in."""
    pieces = list(word_pieces(data, offsets, is_word))
    if not pieces:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in pieces]), np.concatenate([t for _, t in pieces])


def word_pieces(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, stems: Sequence[int] = ()
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same, piece by piece. ``stems``: after the words of a piece, the first so many bytes of
    each word that has more, as terms of their own."""
    lo = 0
    while lo < len(data):
        hi = _cut(data, offsets, lo, is_word)
        for hashes, at in _piece(data[lo:hi], offsets, lo, is_word, stems):
            yield hashes, np.searchsorted(offsets, at, "right") - 1
        lo = hi


def _cut(data: np.ndarray, offsets: np.ndarray, lo: int, is_word: np.ndarray) -> int:
    """The end of the piece that starts at ``lo``: after a blank, or where a text ends. The piece
    grows until it has one, should a word be that long."""
    size = PIECE
    while lo + size < len(data):
        hi = lo + size
        gaps = np.flatnonzero(~is_word[data[lo:hi]])
        border = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
        cut = max(lo + int(gaps[-1]) + 1 if len(gaps) else lo, border)
        if cut > lo:
            return cut
        size *= 2
    return len(data)


def _piece(
    data: np.ndarray, offsets: np.ndarray, lo: int, is_word: np.ndarray, stems: Sequence[int]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, lo + len(data))] - lo
    first[borders] = inside[borders]
    where = np.flatnonzero(inside)
    starts = np.flatnonzero(first[where])
    if not len(starts):
        return
    lengths = np.diff(np.append(starts, len(where)))
    place = np.arange(len(where)) - np.repeat(starts, lengths)
    weights = drawn(int(lengths.max()), 2) | np.uint64(1)
    values = _BYTE[data[where]] * weights[place]
    sums = np.add.reduceat(values, starts)
    at = where[starts] + lo
    yield mixed(sums + lengths.astype(np.uint64) * _STEP), at
    for size in stems:
        long = lengths > size
        begun = np.add.reduceat(np.where(place < size, values, np.uint64(0)), starts)[long]
        yield mixed(begun ^ drawn(1, 100 + size)[0]), at[long]


def shingles(words: np.ndarray, texts: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, in order, and where each text's begin. A text of fewer
    words has one, of all its words; one without words has none."""
    factor = drawn(size, 3) | np.uint64(1)
    counts = np.bincount(texts, minlength=n_texts).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(counts)])
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    full = np.zeros(len(words), np.uint64)
    for k in range(size):
        full += padded[k : k + len(words)] * factor[k]
    full = mixed(full)
    left = begins[1:][texts] - np.arange(len(words)) if len(words) else np.zeros(0, np.int64)
    keep = left >= size
    short = np.flatnonzero((counts > 0) & (counts < size))
    for t in short:  # few words each
        own = words[begins[t] : begins[t + 1]]
        length = np.array([len(own)], np.uint64) * _STEP
        full[begins[t]] = mixed((own * factor[: len(own)]).sum(dtype=np.uint64, keepdims=True) + length)[0]
        keep[begins[t]] = True
    sizes = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    return full[keep], np.concatenate([[0], np.cumsum(sizes)])
