"""Small helpers of the operators in this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.session import scratch_path
from gridtide.sources.files import remove

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
SLICE_BYTES = 1 << 20
#: Setting by which Spark deletes the shuffle files of a query when it ends, on all executors.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folder of the tables that go at the end of the block in hand.
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, folder: str | None, name: str) -> str:
    return f"{folder}/{name}-{uuid.uuid4().hex}" if folder else scratch_path(spark, name)


def _settled(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared scratch folder and read it back, which cuts its lineage.

    A lost executor then costs only the tasks that read the files again. The shuffle files of the write go at once.
    """
    return _settled(df, _path(df.sparkSession, _folder.get(), name))


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables settled within the block are deleted at its end, but for those settled by the function it gives.

    What leaves the block must come from that function, as results read settled tables lazily.
    """
    outer = _folder.get()
    own = _path(spark, outer, "passing")
    token = _folder.set(own)
    try:
        yield lambda df, name: _settled(df, _path(spark, outer, name))
    finally:
        _folder.reset(token)
        remove(spark, own)


def plain_lower(column):
    """Lower-case A-Z alone, whatever the locale."""
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def ranges(sizes: Iterable[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of items that add up to about ``most``; a larger item stands alone."""
    start = size = end = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
        end = i + 1
    if start < end:
        yield start, end


def slices(texts: list, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text stands alone."""
    return ranges((len(text or b"") + 1 for text in texts), most)


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``SLICE_BYTES`` of text, so that what is made of the texts stays small."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    for start, end in ranges((n or 0) + 1 for n in sizes):
        yield batch.slice(start, end - start)
