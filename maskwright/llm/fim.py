"""Fill-in-the-middle: documents cut in three and put together so that the middle comes last.

A text's units are runs of letters A-Z in either case, and every other character. Two of the places
between units are drawn by a hash of the document's key. To find them no text is taken apart into
units: a rolling hash cuts it into chunks where its content says so, and what matters of a chunk is
its summary: how many units and characters it has, and whether a letter stands at either end. A run
of letters that goes on beyond a chunk's border is one unit, so that two adjoining letters take one
off the sum. Texts that share passages share their chunks, and a chunk met again is not looked at
again: summaries are kept under the chunk's bytes, so that a hash alone is never trusted. The sums of
the chunks' units say which chunk holds a cut, and only that chunk is read unit by unit.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import accumulate, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from maskwright.llm.common import quoted, without
from maskwright.llm.slices import text_slices
from maskwright.llm.wordhash import drawn

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are cut; of those so many begin with their suffix.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20
#: Columns that the operator adds.
ADDED = ("n_units", "form", "prefix_chars", "middle_chars", "output")
#: Bytes of a chunk: least, most; one place in 2 ** CUT_BITS ends one. The hash looks back REACH bytes.
LEAST, MOST, CUT_BITS, REACH = 32, 4096, 8, 16
#: Bytes of chunks whose summaries a task keeps; beyond it the task starts anew.
KEPT_BYTES = 32 << 20

_BYTE, _BASE = drawn(256, 31), drawn(1, 32)[0] | np.uint64(1)
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes that go on with a character
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_SHAPE = bytes(ord("a") if b in _LETTERS else ord(" ") for b in range(256))
_UNIT = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xbf][\x80-\xbf]*")


class Summary(NamedTuple):
    """``opens`` and ``closes``: the chunk begins or ends with a letter."""

    units: int
    chars: int
    opens: bool
    closes: bool


def summary(chunk: bytes) -> Summary:
    shape = chunk.translate(_SHAPE, _CONTINUED)
    return Summary(len(shape.split()) + shape.count(b" "), len(shape), shape[:1] == b"a", shape[-1:] == b"a")


class Summaries:
    """Summaries by the chunks' bytes, as many as ``KEPT_BYTES`` hold."""

    def __init__(self):
        self.known: dict[bytes, Summary] = {}
        self.bytes = 0

    def of(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is None:
            if self.bytes > KEPT_BYTES:
                self.known.clear()
                self.bytes = 0
            found = self.known[chunk] = summary(chunk)
            self.bytes += len(chunk)
        return found


def cut_places(data: np.ndarray) -> np.ndarray:
    """The places before which a chunk may end by the hash of the REACH bytes before; characters
    are never cut."""
    if len(data) <= REACH:
        return np.zeros(0, np.int64)
    h, factor, reach = _BYTE[data], _BASE, 1
    with np.errstate(over="ignore"):
        while reach < REACH:
            h = h[:-reach] * factor + h[reach:]
            factor, reach = factor * factor, reach * 2
    places = np.flatnonzero(h[:-1] >> np.uint64(64 - CUT_BITS) == 0) + REACH
    return places[(data[places] & 0xC0) != 0x80]


def chunk_ends(raw: bytes, places: list[int]) -> list[int]:
    """Where the chunks of one text end, given where they may; none for no bytes. The first REACH
    bytes hold no place, and a chunk with LEAST bytes reaches as far, so that a chunk's borders follow
    from this text alone."""
    ends, start = [], 0
    for place in [*places, len(raw)]:
        while place - start > MOST:
            start += MOST
            while raw[start] & 0xC0 == 0x80:
                start -= 1
            ends.append(start)
        if place - start >= LEAST or place == len(raw) > start:
            ends.append(place)
            start = place
    return ends


class Text:
    """One text as chunks with summaries; ``units``: how many units it has."""

    def __init__(self, raw: bytes, places: list[int], summaries: Summaries):
        self.raw = raw
        self.ends = chunk_ends(raw, places)
        self.begins = [0, *self.ends[:-1]] if self.ends else []
        parts = [summaries.of(raw[b:e]) for b, e in zip(self.begins, self.ends, strict=True)]
        # Whether a chunk's first letters go on with a unit of the chunk before.
        self.joined = [bool(i and parts[i - 1].closes and p.opens) for i, p in enumerate(parts)]
        self.units_before = [0, *accumulate(p.units - j for p, j in zip(parts, self.joined, strict=True))]
        self.chars_before = [0, *accumulate(p.chars for p in parts)]
        self.units = self.units_before[-1]

    def place(self, unit: int) -> tuple[int, int]:
        """The byte and the character that the unit of this number begins at; the end if there is none."""
        if unit >= self.units:
            return len(self.raw), self.chars_before[-1]
        k = bisect_right(self.units_before, unit) - 1
        chunk = self.raw[self.begins[k] : self.ends[k]]
        nth = unit - self.units_before[k] + self.joined[k]
        at = next(islice(_UNIT.finditer(chunk), nth, None)).start()
        return self.begins[k] + at, self.chars_before[k] + len(chunk[:at].translate(None, _CONTINUED))


def rearranged(text: Text, digest: str) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, characters of prefix and middle, and the text put together by its draws."""
    first, second, cut, order = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    raw, n = text.raw, text.units
    if not raw or cut % 100 >= CUT_SHARE or any(mark.encode() in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    low, high = sorted((first % (n + 1), second % (n + 1)))
    (a, a_chars), (b, b_chars) = text.place(low), text.place(high)
    prefix, middle, suffix = PREFIX.encode() + raw[:a], MIDDLE.encode() + raw[a:b], SUFFIX.encode() + raw[b:]
    if order % 100 < SUFFIX_FIRST_SHARE:
        return n, "spm", a_chars, b_chars - a_chars, suffix + prefix + middle
    return n, "psm", a_chars, b_chars - a_chars, prefix + suffix + middle


def _rearrange(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    summaries = Summaries()
    for batch in batches:
        rows = batch.select([c for c in batch.schema.names if c != "__draws"])
        draws = batch.column("__draws").to_pylist()
        for first, data, offsets in text_slices(batch.column(text)):
            places, raw = cut_places(data), data.tobytes()
            borders = np.searchsorted(places, offsets)
            found = []
            for i in range(len(offsets) - 1):
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                # A place whose hash reaches back into the text before is none.
                own = places[borders[i] : borders[i + 1]] - lo
                found.append(rearranged(Text(raw[lo:hi], own[own >= REACH].tolist(), summaries), draws[first + i]))
            units, forms, prefixes, middles, outputs = zip(*found, strict=True)
            columns = [
                pa.array(units, pa.int64()), pa.array(forms), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()),
                pa.array(outputs, pa.binary()).cast(pa.string()),
            ]
            out = rows.slice(first, len(found))
            for name, column in zip(ADDED, columns, strict=True):
                out = out.append_column(name, column)
            yield out


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """All rows with ``n_units, form, prefix_chars, middle_chars, output`` added, or put in the place
    of columns of such names.

    ``form``: ``plain`` (the text as it stands), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix,
    prefix, middle), each part behind its mark. The draws are those of the sha256 of seed and key, so
    that a rerun agrees, and rows with one key are cut alike. Plain stay NULL and empty texts (whose
    output is empty), texts that hold a mark, and one document in ten; their character counts are
    NULL. A NULL key draws as an empty one. Where both cuts fall together the middle is empty. Texts of
    any length are handled whole, a batch of rows in slices of a few MB; nothing is shuffled.
    """
    draws = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(key).cast("string"), F.lit(""))).cast("binary"), 256)
    if text in ADDED:
        raise ValueError(f"The text's column has the name of one that is added: {text}")
    rows = without(docs, [*ADDED, "__draws"])
    kind = StructType([
        *rows.schema, StructField("n_units", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()), StructField("output", StringType()),
    ])
    return rows.withColumn("__draws", draws).mapInArrow(partial(_rearrange, text=text), kind)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. The marks are found by themselves, as no cut text has any."""
    mark = len(PREFIX)
    p, s, m = (F.instr(output, name) for name in (PREFIX, SUFFIX, MIDDLE))
    middle = F.substr(output, m + mark)
    psm = F.concat(F.substr(output, p + mark, s - p - mark), middle, F.substr(output, s + mark, m - s - mark))
    spm = F.concat(F.substr(output, p + mark, m - p - mark), middle, F.substr(output, s + mark, p - s - mark))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
