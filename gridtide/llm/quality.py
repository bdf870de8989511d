"""Text quality by a kernel model on document statistics.

Statistics of each text are counted in one scan and kept as a narrow table. Random Fourier features stand for a
Gaussian kernel over them; every partition of the labelled rows sums its share of the normal equations, Spark adds
the shares, and the ridge solution (a few hundred numbers) is computed from the sums. Isotonic regression on
labelled rows that the fit has not seen turns ridge scores into probabilities, from a histogram of fixed length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.llm.common import read_table, settle

STATISTICS = (
    "log_chars log_words word_length word_spread upper digit space stop comma bang bar symbol other_sign "
    "non_ascii distinct follows_itself top_share log_lines distinct_lines sign_end one_letter long_word"
).split()
FOURIER = 256
BANDWIDTH = 4.0
RIDGE = 1.0
SEED = 20
FIT_ROWS = 400_000
FIT_PARTS = 12
BINS, LEAST, MOST = 1024, -1.0, 2.0
FIT_SHARE = 80
#: Rows whose Fourier features are held at a time.
FEATURE_ROWS = 1024


def _classes() -> np.ndarray:
    """Byte classes, one column each: upper, digit, space, stop, comma, bang, bar, symbol, other sign, not ASCII."""
    table = np.zeros((256, 10))
    table[65:91, 0] = table[48:58, 1] = table[9:14, 2] = table[32, 2] = 1
    for column, signs in enumerate((".", ",;:", "!?", "|"), start=3):
        table[[ord(s) for s in signs], column] = 1
    table[[ord(s) for s in "#$%&*@^~+=<>"], 7] = 1
    letters = [*range(65, 91), *range(97, 123)]
    taken = table.sum(axis=1) > 0
    table[[b for b in range(33, 127) if not taken[b] and b not in letters], 8] = 1
    table[128:, 9] = 1
    return table


CLASSES = _classes()
SIGNS = "#$%&*@^~+=<>|!?"


def statistics(text: str | None) -> list[float]:
    """Figures of one text; a null text counts as empty."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    shares = np.bincount(data, minlength=256) @ CLASSES / max(1, len(data))
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    kinds = Counter(words)
    repeated = sum(map(eq, words, words[1:]))
    lines = text.split("\n")
    ends = sum(map(str.endswith, words, [tuple(SIGNS)] * len(words)))
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        float(lengths.mean()) if words else 0.0,
        float(lengths.std()) if words else 0.0,
        *shares.tolist(),
        len(kinds) / n,
        repeated / n,
        max(kinds.values(), default=0) / n,
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        ends / n,
        float((lengths == 1).sum()) / n,
        float((lengths > 12).sum()) / n,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t.as_py()) for t in batch.column(1)], dtype=float).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T)], ["row", *STATISTICS])


class Features:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.weights = rng.normal(0, 1 / BANDWIDTH, (len(STATISTICS), FOURIER))
        self.shift = rng.uniform(0, 2 * np.pi, FOURIER)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -5, 5)
        cosines = np.sqrt(2 / FOURIER) * np.cos(z @ self.weights + self.shift)
        return np.hstack([cosines, np.ones((len(x), 1))])


def _parts(rows: np.ndarray) -> Iterator[np.ndarray]:
    for start in range(0, len(rows), FEATURE_ROWS):
        yield rows[start : start + FEATURE_ROWS]


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS]).astype(float)


def _sums(features: Features):
    """Upper triangle of the normal equations of a partition, the labels as last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FOURIER + 2
        total = np.zeros((size, size))
        for batch in batches:
            rows = np.column_stack([_columns(batch), batch.column("label").to_numpy()])
            for part in _parts(rows):
                z = np.hstack([features(part[:, :-1]), part[:, -1:]])
                total += z.T @ z
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "value"])

    return run


def solve(cells: np.ndarray, size: int = FOURIER + 2) -> np.ndarray:
    """Ridge weights from the summed cells ``(i, j, value)``."""
    total = np.zeros((size, size))
    total[cells[:, 0].astype(int), cells[:, 1].astype(int)] = cells[:, 2]
    total = total + np.triu(total, 1).T
    return np.linalg.solve(total[:-1, :-1] + RIDGE * np.eye(size - 1), total[:-1, -1])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and levels of the blocks, both rising; ``x`` comes sorted."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    found = np.array(blocks)
    return found[:, 0] / found[:, 2], found[:, 1] / found[:, 2]


class Model:
    """Score of statistics; without labelled rows every score is a half."""

    def __init__(self, features: Features | None = None, weights: np.ndarray | None = None) -> None:
        self.features, self.weights = features, weights
        self.centres, self.levels = np.zeros(1), np.full(1, 0.5)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0), *(self.features(part) @ self.weights for part in _parts(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.centres, self.levels), 0, 1)


def _histogram(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((3, BINS))
        for batch in batches:
            raw = np.clip(model.raw(_columns(batch)), LEAST, MOST)
            at = np.minimum(((raw - LEAST) / (MOST - LEAST) * BINS).astype(int), BINS - 1)
            label = batch.column("label").to_numpy()
            for row, values in enumerate((None, raw, label)):
                table[row] += np.bincount(at, values, BINS)
        used = np.flatnonzero(table[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(t[used]) for t in table)], ["at", "n", "x", "y"])

    return run


def document_statistics(docs: DataFrame) -> DataFrame:
    """``row`` (all columns but ``text``) and the statistics of each document, written down once."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    source = docs.select(F.struct(*others).alias("row"), "text")
    fields = [T.StructField(s, T.DoubleType()) for s in STATISTICS]
    return settle(source.mapInArrow(_statistics, T.StructType([source.schema["row"], *fields])), "statistics")


def held_out(column: str = "doc_id"):
    """Whether labels of a document are kept from the fit."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Model of ``label`` from labelled rows that are not held out.

    Beyond ``fit_rows`` labelled rows a share of them is taken by a hash of the id, so that about that many
    are used. Several labels of one id count by their mean; null ids and labels are left out.
    """
    known = labels.where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").groupBy("doc_id")
    known = known.agg((F.avg(label) >= 0.5).cast("double").alias("label")).where(~held_out())
    rows = known.agg(F.count("*")).first()[0]
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000))
    known = known.where(draw < int(1_000_000 * min(1.0, fit_rows / max(1, rows))))
    joined = stats.withColumn("doc_id", F.col("row.doc_id")).join(known, "doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(100))
    used = settle(joined.select("label", *STATISTICS, (part < FIT_SHARE).alias("fitted")).repartition(FIT_PARTS), "labelled")
    moments = used.agg(
        F.count("*").alias("n"),
        F.array(*(F.avg(s) for s in STATISTICS)).alias("mean"),
        F.array(*(F.stddev_pop(s) for s in STATISTICS)).alias("spread"),
    ).first()
    if not moments.n:
        return Model()
    spread = np.array(moments.spread, dtype=float)
    features = Features(np.array(moments.mean, dtype=float), np.where(spread > 1e-9, spread, 1.0))
    shares = used.where("fitted").mapInArrow(_sums(features), "i long, j long, value double")
    cells = shares.groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas().to_numpy(dtype=float)
    model = Model(features, solve(cells))

    def calibration(rows_: DataFrame) -> np.ndarray:
        bins = rows_.mapInArrow(_histogram(model), "at long, n double, x double, y double").groupBy("at")
        sums = bins.agg(*(F.sum(c).alias(c) for c in "nxy")).orderBy("at")
        return sums.select("n", "x", "y").toPandas().to_numpy(dtype=float)

    table = calibration(used.where("NOT fitted"))
    if not len(table):
        table = calibration(used)
    model.centres, model.levels = isotonic(table[:, 1] / table[:, 0], table[:, 2] / table[:, 0], table[:, 0])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``row`` and ``score`` of each row of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(model.score(_columns(batch)))], ["row", "score"]
            )

    return stats.mapInArrow(run, T.StructType([stats.schema["row"], T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row`` and ``score`` of every document.

    Null and empty texts are scored by their statistics, all of them zero; very long ones are counted whole. Repeated
    rows each get a score; without labels every score is a half. An empty table gives an empty result.
    """
    stats = document_statistics(docs)
    return score(stats, fit(stats, labels))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier accepts; texts are scored where they are read, so none is moved."""
    model = fit(document_statistics(docs.select("doc_id", "text")), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)], dtype=float).reshape(-1, len(STATISTICS))
            yield batch.select(["row"]).filter(pa.array(model.score(x) >= 0.5))

    source = docs.select(F.struct("*").alias("row"), "text")
    return source.mapInArrow(run, T.StructType([source.schema["row"]])).select("row.*")


def op1_quality_fourier(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, read_table(spark, sf_dir, "labels")).select("row.doc_id", "score")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
