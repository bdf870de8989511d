"""Token ids of documents packed into rows of fixed length, as binary matrices.

Texts are tokenised by a public byte-level vocabulary, whose file is read on the driver and sent to the tasks. A
document longer than a row is cut into pieces without losing a token. Tasks pack the pieces they read, some
thousands at a time, by best-fit decreasing: the longest piece first, each into the fullest row that still has room.
That row is found by a segment tree over the free space of open rows. Nothing is shuffled, and a task's
memory is bounded by the pieces it holds at a time and its longest text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.common import read_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How words are split before merging; a fixed value that belongs to the vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PAD_ID = 50256
ROW_TOKENS = 2048
HELD_PIECES = 8192
HELD_TOKENS = 4_000_000
SCHEMA = (
    "ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, pieces array<int>, "
    "n_tokens int, n_pad int, id_bytes int"
)


class FreeSpace:
    """Open rows by free space: a segment tree with the number of rows below each node."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, space: int, change: int) -> None:
        at = space + self.size
        while at:
            self.count[at] += change
            at >>= 1

    def put(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        self._add(space, 1)

    def least(self, need: int) -> int | None:
        """Smallest free space of at least ``need``."""
        count, at = self.count, need + self.size
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None

    def take(self, space: int) -> int:
        self._add(space, -1)
        return self.rows[space].pop()


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Rows of piece numbers by best-fit decreasing; no piece is larger than ``room``."""
    rows: list[list[int]] = []
    free = FreeSpace(room)
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        space = free.least(sizes[piece])
        if space is None:
            row, space = len(rows), room
            rows.append([])
        else:
            row = free.take(space)
        rows[row].append(piece)
        free.put(space - sizes[piece], row)
    return rows


def encoder(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("rows", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def id_kind(vocabulary: bytes) -> np.dtype:
    """Little-endian unsigned numbers of 16 bits, or of 32 where an id of the vocabulary needs them."""
    largest = max((int(line.split()[1]) for line in vocabulary.splitlines() if line.strip()), default=0)
    return np.dtype("<u2" if max(largest, PAD_ID) < 1 << 16 else "<u4")


def _rows(pieces: list[tuple[int | None, int, np.ndarray]], room: int, kind: np.dtype) -> pa.RecordBatch:
    out = []
    for row in best_fit([len(p[2]) for p in pieces], room):
        ids = np.full(room, PAD_ID, dtype=kind)
        ends = np.cumsum([0, *(len(pieces[i][2]) for i in row)]).tolist()
        for i, at in zip(row, ends):
            ids[at : at + len(pieces[i][2])] = pieces[i][2]
        doc_ids, numbers = [pieces[i][0] for i in row], [pieces[i][1] for i in row]
        out.append((ids.tobytes(), ends, ends[:-1], doc_ids, numbers, ends[-1], room - ends[-1], kind.itemsize))
    kinds = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.int32()] * 3)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _pack(vocabulary: bytes, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, kind = encoder(vocabulary), id_kind(vocabulary)
        held: list[tuple[int | None, int, np.ndarray]] = []
        tokens = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoding.encode_to_numpy(text.as_py() or "", disallowed_special=()).astype(kind)
                for number, at in enumerate(range(0, max(1, len(ids)), room)):
                    held.append((doc, number, ids[at : at + room]))
                tokens += len(ids)
                if len(held) >= HELD_PIECES or tokens >= HELD_TOKENS:
                    yield _rows(held, room, kind)
                    held, tokens = [], 0
        if held:
            yield _rows(held, room, kind)

    return run


def token_rows(docs: DataFrame, vocabulary: str = VOCABULARY, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """One row for each packed sequence of ``row_tokens`` ids.

    ``ids`` holds them as little-endian unsigned numbers of ``id_bytes`` bytes, two or, where the vocabulary has larger
    ids, four, padded at the end by ``PAD_ID``; ``cu_seqlens`` the
    bounds of its segments, ``position_resets`` where positions start again at zero, ``doc_ids`` and ``pieces`` which
    piece of which document each segment is. Null and empty texts are a segment of no tokens. Ids may repeat or
    be null. Which documents share a row depends on how the input is split; every token is there once. An empty
    table gives no rows.
    """
    with open(vocabulary, "rb") as file:  # on the driver alone
        content = file.read()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return source.mapInArrow(_pack(content, row_tokens), SCHEMA)


def op8_token_rows(spark, sf_dir: str) -> DataFrame:
    """Packed token ids of all documents."""
    return token_rows(read_table(spark, sf_dir, "documents"))
