"""Token ids packed into matrices of fixed width.

Each task tokenizes its texts, cuts overlong documents into pieces of the width, and packs pool after
pool of pieces best fit decreasing: the longest first, each into the row whose free space is the
least that holds it. A segment tree over free spaces finds that space. Rows go out as matrices of
little-endian ids, with the cumulative lengths of segments and the places where positions restart.
Nothing is shuffled, and a task holds one pool.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import quoted

#: Where the vocabulary lies on every node, one line per token: base64 and rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the vocabulary's merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Shape(NamedTuple):
    """``width`` ids in a row, ``rows`` rows in a matrix; a pool is packed when it has so many ids."""

    width: int = 2048
    rows: int = 64
    pool: int = 4_000_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_ids(encoding, text: str) -> list[int]:
    """The ids of a text. A text that the tokenizer's pattern gives up on, such as one with a million
    blanks in a row, is encoded in runs of characters; the ids still give the text back."""
    try:
        return encoding.encode_ordinary(text)
    except BaseException as problem:  # the tokenizer's own panics are no Exception
        if isinstance(problem, (KeyboardInterrupt, SystemExit, MemoryError)) or len(text) <= 1:
            raise
        half = len(text) // 2
        return token_ids(encoding, text[:half]) + token_ids(encoding, text[half:])


class FreeSpaces:
    """A segment tree over free spaces 0 to ``width``: how many open rows have each, and sums of
    them, so that the least space of at least n is found in one way up and one down."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def _add(self, space: int, by: int) -> None:
        node = self.leaves + space
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, row: int, space: int) -> None:
        if space:
            self.open.setdefault(space, []).append(row)
            self._add(space, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the least space of ``least`` or more, and that space; None if there is none."""
        node = self.leaves + least
        while not self.tree[node]:
            while node & 1:  # a right child has nothing to its right but beyond its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        space = node - self.leaves
        self._add(space, -1)
        return self.open[space].pop(), space


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers, best fit decreasing; pieces of one length in their order."""
    spaces, rows = FreeSpaces(width), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = spaces.take(lengths[i])
        row, space = found if found else (len(rows), width)
        if not found:
            rows.append([])
        rows[row].append(i)
        spaces.put(row, space - lengths[i])
    return rows


_PIECE = pa.struct([("key", pa.int64()), ("offset", pa.int64()), ("start", pa.int32()), ("length", pa.int32())])
_MATRIX = pa.schema([
    ("n_rows", pa.int32()), ("width", pa.int32()), ("id_bytes", pa.int32()), ("ids", pa.binary()),
    ("segment_ends", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("pieces", pa.list_(_PIECE)),
])
_KIND = (
    "n_rows int, width int, id_bytes int, ids binary, segment_ends array<int>, position_resets array<int>, "
    "pieces array<struct<key: long, offset: long, start: int, length: int>>"
)


def _matrices(pool: list[tuple[int, int, np.ndarray]], shape: Shape, pad: int) -> Iterator[pa.RecordBatch]:
    rows = best_fit([len(ids) for _, _, ids in pool], shape.width)
    kind = np.dtype("<u2" if pad < 1 << 16 else "<u4")
    for top in range(0, len(rows), shape.rows):
        some = rows[top : top + shape.rows]
        ids = np.full(len(some) * shape.width, pad, kind)
        ends, resets, pieces = [0], [], []
        for r, row in enumerate(some):
            at = r * shape.width
            for i in row:
                key, offset, own = pool[i]
                ids[at : at + len(own)] = own
                pieces.append({"key": key, "offset": offset, "start": at, "length": len(own)})
                resets.append(at)
                at += len(own)
                ends.append(at)
            if at < (r + 1) * shape.width:  # what pads a row is a segment of its own
                resets.append(at)
                ends.append((r + 1) * shape.width)
        values = [len(some), shape.width, kind.itemsize, ids.tobytes(), ends, resets, pieces]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _MATRIX, strict=True)], schema=_MATRIX)


def _pack(batches: Iterator[pa.RecordBatch], shape: Shape, vocabulary: str) -> Iterator[pa.RecordBatch]:
    encoding = tokenizer(vocabulary)
    pad = encoding.n_vocab
    kind = np.uint16 if pad < 1 << 16 else np.uint32
    pool, held = [], 0
    for batch in batches:
        for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
            ids = np.array(token_ids(encoding, text.as_py() or ""), kind)
            for offset in range(0, len(ids), shape.width):
                piece = ids[offset : offset + shape.width]
                pool.append((key.as_py(), offset, piece))
                held += len(piece)
                if held >= shape.pool:
                    yield from _matrices(pool, shape, pad)
                    pool, held = [], 0
    if pool:
        yield from _matrices(pool, shape, pad)


def pack_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Shape = Shape(), vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per matrix.

    ``ids`` has ``n_rows * width`` ids of ``id_bytes`` bytes, rows filled up with the first id after the
    vocabulary. ``segment_ends`` counts over the whole matrix, from 0, and takes what pads a row as a
    segment; ``position_resets`` are the places where positions go back to 0. ``pieces`` says whose ids
    stand where, and at which of the document's ids they begin. All ids of all texts are there once:
    no text is cut short. NULL and empty texts have no ids. Repeated rows are documents of their own.
    """
    rows = docs.select(quoted(key).cast("long").alias("key"), quoted(text).alias("text"))
    return rows.mapInArrow(partial(_pack, shape=shape, vocabulary=vocabulary), _KIND)


def write_matrices(matrices: DataFrame, path: str) -> DataFrame:
    """The matrices as a table of binary cells, which hardly compress; returns what was written. A
    reader takes ``ids`` as ``numpy.frombuffer(ids, f"<u{id_bytes}").reshape(n_rows, width)``."""
    matrices.write.option("compression", "none").parquet(path)
    return matrices.sparkSession.read.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    encoding = tokenizer(vocabulary)
    for batch in batches:
        raw = [b"".join(encoding.decode_tokens_bytes(ids)) for ids in batch.column("all_ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(raw, pa.binary())], names=["key", "raw"])


def piece_ids(matrices: DataFrame) -> DataFrame:
    """``key, offset, ids`` of each piece, read back from the matrices."""
    pieces = matrices.select("ids", "id_bytes", F.explode("pieces").alias("p"))
    cut = F.substring(F.col("ids"), F.col("p.start") * F.col("id_bytes") + 1, F.col("p.length") * F.col("id_bytes"))
    return pieces.select("p.key", "p.offset", F.col("id_bytes"), cut.alias("ids"))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.frombuffer(raw, f"<u{size}").tolist() for raw, size in zip(batch.column("ids").to_pylist(), batch.column("id_bytes").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("offset"), pa.array(lists, pa.list_(pa.int64()))], names=["key", "offset", "ids"])


def unpack_texts(matrices: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, raw``: the UTF-8 bytes of each document with ids, put together from its pieces. Keys are
    those of single documents."""
    parts = piece_ids(matrices).mapInArrow(_numbers, "key long, offset long, ids array<long>")
    whole = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    whole = whole.select("key", F.flatten("parts.ids").alias("all_ids"))
    return whole.mapInArrow(partial(_decode, vocabulary=vocabulary), "key long, raw binary")
