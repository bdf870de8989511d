"""Approximate nearest neighbours by a permutation index.

A vector is described by its nearest pivots in order of nearness. Each block of vectors keeps an inverted file for each
pivot: the vectors that have it among their ``POSTED`` nearest of ``PIVOTS``, with the place it has in their order. A query
reads the files of its own nearest pivots alone and adds up, for the vectors it meets there, the overlap of the two
orders, which is the footrule distance up to a constant. The best share of the vectors met are ranked again by exact
cosine; a vector that shares no pivot with a query is never touched. Vectors that are equal are one candidate with several ids.

Every vector is in exactly one block, queries meet blocks in blocks too, and only the best few of each pair of
blocks travel on. Block sizes are fixed, so a task's memory is bounded however many rows there are.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm.common import read_table, settle

PIVOTS = 1024
POSTED = 32
#: Share of the vectors met that are ranked again, and how many at least.
RERANK_SHARE = 0.6
RERANK_LEAST = 64
BLOCK = 8192
NEAREST = 5
QUERY_STEP = 50


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` in double precision of the vectors that have a direction."""
    cast = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return cast.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def orders(x: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """Nearest ``posted`` pivots of each row, nearest first; ties take the pivot that comes first."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :posted]


class Files(NamedTuple):
    """Inverted files of a block: where the file of each pivot starts, its vectors, and how early it comes in their orders."""

    starts: np.ndarray
    vectors: np.ndarray
    places: np.ndarray


def files(order: np.ndarray, pivots: int) -> Files:
    """Inverted files of vectors with these orders."""
    rows, posted = order.shape
    by_pivot = np.argsort(order.ravel(), kind="stable")
    starts = np.searchsorted(order.ravel()[by_pivot], np.arange(pivots + 1))
    return Files(starts, (by_pivot // posted).astype(np.int64), posted - by_pivot % posted)


def overlap(index: Files, order: np.ndarray, rows: int) -> np.ndarray:
    """Overlap of a query's order with those of the vectors in the files of its pivots; zero for all that are not met.

    The footrule distance falls by twice of it.
    """
    spans = [np.arange(index.starts[p], index.starts[p + 1]) for p in order]
    at = np.concatenate(spans)
    early = np.repeat(len(order) - np.arange(len(order)), [len(s) for s in spans])
    return np.bincount(index.vectors[at], np.minimum(index.places[at], early), minlength=rows).astype(np.int64)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of ``x`` with each row of ``y``, summed in the same order wherever it is computed."""
    return (y * x).sum(axis=1) / (np.sqrt((y * y).sum(axis=1)) * np.sqrt((x * x).sum()))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def candidates(index: Files, order: np.ndarray, rows: int, share: float, least: int) -> np.ndarray:
    """Vectors to rank again: the best of those met, or all of the block where too few are met."""
    rank = overlap(index, order, rows)
    met = int(np.count_nonzero(rank))
    if met < least:
        return np.arange(rows)
    size = min(met, max(RERANK_LEAST, least, math.ceil(share * met)))
    return np.argpartition(rank, rows - size)[rows - size :]


def _search(bases: dict[int, np.ndarray], posted: int, share: float, keep: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(vectors) and len(queries):
            x, q = _matrix(vectors.column("embedding")), _matrix(queries.column("embedding"))
            pivots = bases[x.shape[1]]
            used = min(posted, len(pivots))
            index = files(orders(x, pivots, used), len(pivots))
            ids = vectors.column("ids").to_pylist()
            least = np.array([i[0] for i in ids])
            heads = zip(queries.column("a").to_pylist(), queries.column("b").to_pylist(), orders(q, pivots, used))
            for k, (a, b, order) in enumerate(heads):
                near = candidates(index, order, len(x), share, keep)
                exact = cosines(q[k], x[near])
                best = np.lexsort((least[near], -exact))[:keep]
                found = sorted((-exact[i], v) for i in best for v in ids[near[i]])[:keep]
                out.extend((a, b, v, -s) for s, v in found)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], ["a", "b", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = NEAREST,
    pivots: int = PIVOTS,
    posted: int = POSTED,
    share: float = RERANK_SHARE,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found for each row that is a query.

    Rows with a null id, and vectors that are null, zero or hold null or non-finite numbers take no part. Vectors are
    sought among those of their own length, each length with pivots of its own; a table is expected to have few lengths.
    Rows with the same id and vector are one; a query never finds its own id. Ties go to the smaller id. With fewer candidates than ``k`` all return; an empty table gives nothing.
    """
    keys = (F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"))
    good = usable(vectors).select("vec_id", "embedding", *keys)
    asked = good.where(is_query).select(F.col("vec_id").alias("query_id"), "a", "b").distinct()
    copies = Window.partitionBy("a", "b").orderBy("vec_id")
    few = good.withColumn("n", F.dense_rank().over(copies)).where(F.col("n") <= k + 1)
    classes = few.groupBy("a", "b").agg(
        F.first("embedding").alias("embedding"), F.sort_array(F.collect_set("vec_id")).alias("ids")
    )
    asking = asked.select("a", "b", F.lit(True).alias("asks")).distinct()
    classes = settle(classes.join(asking, ["a", "b"], "left"), "vectors")
    sized = classes.withColumn("size", F.size("embedding"))
    drawn = F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("a"), "b"))
    sample = sized.select("size", "embedding", drawn.alias("n")).where(F.col("n") <= pivots).collect()
    if not sample:
        return asked.select("query_id", *(F.lit(None).cast(t).alias(n) for n, t in (("rank", "int"), ("vec_id", "long"), ("score", "double")))).limit(0)
    bases = {}
    for size in {r.size for r in sample}:
        base = np.array([r.embedding for r in sample if r.size == size])
        bases[size] = base / np.linalg.norm(base, axis=1, keepdims=True)
    counts = sized.groupBy("size").agg(F.count("*").alias("n"), F.count("asks").alias("asked"))
    parts = counts.select("size", *(F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int").alias(p) for c, p in (("n", "vs"), ("asked", "qs"))))
    laid_out = sized.join(parts, "size")

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        placed = df.withColumn(own, F.pmod("b", F.col(f"{own}s")).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop("vs", "qs")

    left = spread(laid_out.select("a", "b", "embedding", "ids", "size", "vs", "qs"), "v", "q")
    right = spread(laid_out.where("asks").select("a", "b", "embedding", "size", "vs", "qs"), "q", "v")
    right = right.toDF(*right.columns)  # columns of its own, as both sides come from one table
    search = _search(bases, posted, share, k + 1)
    key = ("size", "v", "q")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        search, "a long, b long, vec_id long, score double"
    )
    order = (F.col("score").desc(), F.col("vec_id"))
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("a", "b").orderBy(*order))).where(F.col("n") <= k + 1)
    answers = asked.join(found.drop("n"), ["a", "b"]).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "a", "b").orderBy(*order))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_permutation_index(spark, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each vector whose id is divisible by 50."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
