"""Product codes of vectors, with nearest entries found exactly in the order of the Walsh-Hadamard transform.

Components become integers, vectors are cut into parts, and each part position has a codebook. Parts and entries are padded with
zeros to a power of two and transformed by integer butterflies. The transform keeps squared distances up to the factor of
its length, so the sum over the first coefficients, taken in the order of their sign changes, is a lower bound. An entry is given
up once this bound exceeds the distance of an entry already known in full. Only integers are compared.

Codebooks are of fixed size, and the sums that move them are added up in each task first.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm.common import read_table, settle

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
ROWS = 4096
#: Scaled distances stay below this, so that a distance and the number of an entry fit into one long.
MOST = 1 << 56


@functools.cache
def sequency_order(size: int) -> np.ndarray:
    """Coefficients of the transform of ``size`` values by the number of sign changes of their basis."""
    changes = (np.diff(walsh_hadamard(np.eye(size, dtype=np.int64)), axis=1) != 0).sum(axis=1)
    return np.argsort(changes, kind="stable")


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Transform of each row, whose length is a power of two, by sums and differences."""
    rows, size = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(rows, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, size)
        half *= 2
    return x


def transformed(parts: np.ndarray) -> np.ndarray:
    """Transform of zero-padded rows with coefficients in order of sequency."""
    size = 1 << max(0, parts.shape[1] - 1).bit_length()
    padded = np.zeros((len(parts), size), dtype=np.int64)
    padded[:, : parts.shape[1]] = parts
    return walsh_hadamard(padded)[:, sequency_order(size)]


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry of each row, the lower one on ties, and the squared distance."""
    x, c = transformed(parts), transformed(entries)
    size = x.shape[1]
    first = (x[:, :1] - c[:, 0]) ** 2
    guess = c[first.argmin(axis=1)]
    bound = ((x - guess) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= bound[:, None])
    partial = first[row, entry]
    for k in range(1, size):
        partial = partial + (x[row, k] - c[entry, k]) ** 2
        near = partial <= bound[row]
        row, entry, partial = row[near], entry[near], partial[near]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.minimum.reduceat(partial * len(c) + entry, starts) if len(row) else np.empty(0, dtype=np.int64)
    return best % len(c), best // len(c) // size


def _parts(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows of parts, zeros behind shorter vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), PARTS * width), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out.reshape(len(column), PARTS, width)


def _sums(books: np.ndarray):
    """Per part and entry the number of parts assigned and their sums, over all rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                vectors = _parts(batch.column(0).slice(at, ROWS), books.shape[2])
                for p, book in enumerate(books):
                    chosen, _ = nearest_entries(vectors[:, p], book)
                    np.add.at(sums[p], chosen, vectors[:, p])
                    counts[p] += np.bincount(chosen, minlength=len(book))
        p, e = np.nonzero(counts)
        at = [(i, j, k) for i, j in zip(p, e) for k in range(-1, books.shape[2])]
        values = [int(counts[i, j] if k < 0 else sums[i, j, k]) for i, j, k in at]
        columns = [pa.array([int(a[n]) for a in at], pa.int32()) for n in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.int64())], ["part", "entry", "position", "value"])

    return run


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                vectors = _parts(piece.column(2), books.shape[2])
                found = [nearest_entries(vectors[:, p], book) for p, book in enumerate(books)]
                digits = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                errors = np.sum([f[1] for f in found], axis=0)
                codes = pa.array([d.tobytes().hex() for d in digits], pa.string())
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], codes, pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, v)`` with integer components, without vectors that are null or hold null or non-finite components."""
    cast = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return cast.where(F.col("embedding").isNotNull() & finite).select(
        "vec_id", "label", F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("v")
    )


def vector_codes(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every vector that is kept.

    Vectors are cut into parts of the longest vector's width, rounded up; shorter ones, empty ones included, are
    read with zeros behind them. The first codebooks take the smallest ids, of equal ids the smaller vector, null ids last; fewer
    vectors give fewer entries. Repeated rows each return, and null labels are one label. Components whose distances could
    exceed 64 bits are refused with an error. Other columns are not read. An empty table gives an empty result.
    """
    kept = settle(integer_vectors(vectors), "integer_vectors")
    sizes = F.transform("v", lambda x: F.abs(x.cast("double")))
    longest, largest = kept.agg(F.max(F.size("v")), F.max(F.array_max(sizes))).first()
    width = -(-(longest or 0) // PARTS)
    size = 1 << max(0, width - 1).bit_length()
    if (2 * int(largest or 0)) ** 2 * width * size >= MOST:
        raise ValueError(f"components up to {largest} are too large for exact distances")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    books = np.zeros((PARTS, len(first), width), dtype=np.int64)
    for k, row in enumerate(first):
        flat = np.array(row.v + [0] * (PARTS * width - len(row.v)), dtype=np.int64)
        books[:, k] = flat.reshape(PARTS, width)
    for _ in range(ROUNDS if first else 0):
        parts = kept.select("v").mapInArrow(_sums(books), "part int, entry int, position int, value long")
        found = parts.groupBy("part", "entry", "position").agg(F.sum("value").alias("value")).collect()
        counts = {(r.part, r.entry): r.value for r in found if r.position < 0}
        books = books.copy()
        for r in found:
            if r.position >= 0:
                books[r.part, r.entry, r.position] = r.value // counts[r.part, r.entry]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    kinds = [kept.schema[n].dataType.simpleString() for n in ("vec_id", "label")]
    coded = settle(kept.mapInArrow(_codes(books), f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long"), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Code and errors of every vector."""
    return vector_codes(read_table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS (
  SELECT n, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (
    SELECT q.n, q.part, c.entry, list_sum(list_transform(generate_series(1, len(v)), lambda i: (v[i] - w[i]) * (v[i] - w[i]))) AS d
    FROM parts q JOIN c{k} c USING (part)) GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (
  SELECT part, entry, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x
  FROM a{k} JOIN parts USING (n, part), generate_series(1, len(v)) g(i) GROUP BY ALL), c{k + 1} AS (
  SELECT c.part, c.entry, coalesce(any_value(t.w), any_value(c.w)) AS w FROM c{k} c
  LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS w FROM m{k} GROUP BY ALL) t USING (part, entry) GROUP BY ALL)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS n,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT n, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) r(part)
), c0 AS (SELECT part, n - 1 AS entry, v AS w FROM parts WHERE n <= {ENTRIES}), {", ".join(steps)}, total AS (
  SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY n
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(w[i], ',' ORDER BY part, entry, i)) FROM c{ROUNDS}, generate_series(1, len(w)) g(i)) AS codebooks_sha256
FROM kept JOIN total USING (n)
"""


OP13_SQL = _sql()
