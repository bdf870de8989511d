"""Near duplicates by 64-bit SimHash, with candidates from Golay-code fuzzy hashing.

Two fingerprints that differ in at most three bits differ in at most one bit in one of their halves
of 32 bits. That half is read as a word of the (23,12) Golay code and 9 further bits, which leaves
three cases, each an equi-join:

* *exact*: the half is the same; the key is the half.
* *code*: one bit of the Golay word differs. The code is perfect with radius 3, so the codeword of one
  word lies within distance 4 of the other. One side gives the index of its own codeword, the other
  those of all codewords within distance 4 (one, or six where its own is at distance 3).
* *tail*: one of the 9 bits differs; the key holds the Golay word.

In the last two cases at most two bits differ in the other half, so one of its three blocks is the same
and joins the key. Keys have 31 bits or more, hence a fingerprint meets few others by chance even among
billions. Every pair is verified inside the join and comes out under exactly one of its keys.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.common import settle
from gridtide.llm.components import connected_components

MAX_DIFFERENT_BITS = 3
SHINGLE_WORDS = 3
HASH_SEED = 42
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator polynomial of the code
VALUE_BITS = 34
COUNT_ROWS = 1 << 15


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text as an unsigned number; without words it is zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    digest, seed = xxhash.xxh64_intdigest, HASH_SEED
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), COUNT_ROWS):
        piece = hashes[at : at + COUNT_ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


@functools.cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per syndrome: the error of weight 3 or less, and the five errors of weight 4 (zeros if none).

    The third table holds the syndromes of the upper 12 bits of a word.
    """

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = [syndrome(1 << bit) for bit in range(23)]
    leader = np.zeros(2048, dtype=np.int64)
    further: list[list[int]] = [[] for _ in range(2048)]
    for weight in (1, 2, 3, 4):
        for bits in itertools.combinations(range(23), weight):
            error, left = sum(1 << b for b in bits), 0
            for b in bits:
                left ^= single[b]
            if weight < 4:
                leader[left] = error
            else:
                further[left].append(error)
    upper = np.array([syndrome(high << 11) for high in range(4096)], dtype=np.int64)
    return leader, np.array([f or [0] * 5 for f in further], dtype=np.int64), upper


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the own codeword of each 23-bit word, those of the five at distance 4, and where these exist."""
    leader, further, upper = golay_tables()
    left = upper[words >> 11] ^ (words & 2047)
    return (words ^ leader[left]) >> 11, (words[:, None] ^ further[left]) >> 11, further[left, 0] > 0


def fuzzy_keys(prints: np.ndarray, every_codeword: bool) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of unsigned fingerprints and the row each belongs to."""
    keys, rows = [], []
    everyone = np.arange(len(prints))

    def give(tag: int, values: np.ndarray, of: np.ndarray) -> None:
        keys.append((tag << VALUE_BITS) | values)
        rows.append(of)

    halves = [(prints >> np.uint64(32)).astype(np.int64), (prints & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    for side, (half, other) in enumerate((halves, halves[::-1])):
        word, tail = half >> 9, half & 511
        own, near, has_near = codeword_indices(word)
        give(7 * side, half, everyone)
        blocks = (other >> 21, other >> 10 & 2047, other & 1023)
        for k, block in enumerate(blocks):
            rest = tail << 11 | block
            give(7 * side + 1 + k, own << 20 | rest, everyone)
            if every_codeword:
                for column in range(near.shape[1]):
                    give(7 * side + 1 + k, (near[:, column] << 20 | rest)[has_near], everyone[has_near])
            give(7 * side + 4 + k, word << 11 | block, everyone)
    return np.concatenate(keys), np.concatenate(rows)


def _keys_of(every_codeword: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(prints), 4096):
                part = prints[at : at + 4096]
                keys, rows = fuzzy_keys(part.view(np.uint64), every_codeword)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "print"])

    return run


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def near_pairs(prints: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of different fingerprints within three bits, each once; ``prints`` has distinct ``print``.

    Spark cannot foresee how many keys a fingerprint gives, so the join is hinted as a merge join and never broadcast.
    """
    left = prints.select("print").mapInArrow(_keys_of(False), "key long, print long").withColumnRenamed("print", "u")
    right = prints.select("print").mapInArrow(_keys_of(True), "key long, print long").withColumnRenamed("print", "v")
    differ = "(u ^ v)"
    high, low = f"shiftrightunsigned({differ}, 32)", f"({differ} & 4294967295L)"

    def block(of: str) -> str:
        return f"CASE WHEN ({of} & 4292870144L) = 0 THEN 0 WHEN ({of} & 2096128L) = 0 THEN 1 ELSE 2 END"

    def near(side: int, half: str, other: str) -> str:
        return f"{7 * side + 1} + CASE WHEN ({half} & 511L) = 0 THEN 0 ELSE 3 END + {block(other)}"

    tag = (
        f"CASE WHEN {high} = 0 THEN 0 WHEN {low} = 0 THEN 7 "
        f"WHEN bit_count({high}) = 1 THEN {near(0, high, low)} ELSE {near(1, low, high)} END"
    )
    return left.join(right.hint("merge"), "key").where(
        F.expr(f"u < v AND bit_count({differ}) <= {MAX_DIFFERENT_BITS} AND shiftright(key, {VALUE_BITS}) = {tag}")
    ).select("u", "v")


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, print, component_id)`` for every row of ``docs``.

    Null and empty texts have fingerprint zero and link to each other like any others; very long ones are read whole, with their
    bits counted piece by piece. Repeated rows each return; a null id never is the smallest of its component, and a component of null ids alone has a null
    component id. Equal fingerprints are joined before links are sought, so copies cost one row. Files of prints are a tenth
    of what a broadcast of them takes, so these joins are merge joins too. An empty table gives an empty result.
    """
    prints = settle(
        docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
            _fingerprints, f"doc_id {docs.schema[id_column].dataType.simpleString()}, print long"
        ),
        "prints",
    )
    distinct = settle(prints.groupBy("print").agg(F.min("doc_id").alias("least_id")), "distinct_prints")
    members = connected_components(near_pairs(distinct)).withColumnRenamed("node", "print")
    placed = distinct.join(members.hint("merge"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = placed.join(least.hint("merge"), "root").select("print", "component_id")
    return prints.join(classes.hint("merge"), "print").select("doc_id", "print", "component_id")


def op2_simhash_golay(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from gridtide.llm.common import read_table

    groups = simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
