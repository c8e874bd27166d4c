"""Arrow columns of texts in pieces of bounded size, and sums by key that are kept small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from maskwright.llm.wordhash import byte_table, utf8_of

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Letters A-Z in either case, digits and all bytes of other scripts make terms.
TERM_BYTES = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first row of each slice, the bytes of its texts one after another, and where each text
    starts and the last ends. NULL is empty."""
    data, offsets = utf8_of(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values, first)


class Tally:
    """Sums by key over a task's rows, given out whenever more than ``most`` keys are held."""

    def __init__(self, most: int = 1 << 21):
        self.most, self.parts, self.held = most, [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts.append((keys, values))
        self.held += len(keys)
        if self.held > self.most:
            both = self._merged()
            if len(both[0]) > self.most // 2:
                yield both
                self.parts, self.held = [], 0
            else:
                self.parts, self.held = [both], len(both[0])

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held:
            yield self._merged()

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
