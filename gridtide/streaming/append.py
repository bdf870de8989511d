"""Appending missing periods: as one batch, as a running query, and as a full rebuild."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gridtide.errors import GridError, NoDataError, ShapeError, SplitPeriodError
from gridtide.functions.periods import PERIOD_STEPS, period_id, period_start, periods_between
from gridtide.operators.combine import pending_periods
from gridtide.operators.elementwise import run_transforms
from gridtide.registry import SourceAdapter
from gridtide.streaming.store import PeriodStore, first_misfit

Fetch = Callable[[DataFrame], DataFrame]

# Column that carries the landed file of a row through a batch.
FILE = "__landed_file"


def enumerate_periods(
    spark: SparkSession, start: str, end: str, period_type: str, cutoff: Column | None = None
) -> DataFrame:
    """Periods from ``start`` to ``end``, both included, as ``period_id`` rows."""
    first, last = period_start(F.lit(start)), period_start(F.lit(end))
    steps = periods_between(first, last, period_type, cutoff)
    return spark.range(1).select(F.explode(steps).alias("t")).select(period_id("t", period_type).alias("period_id"))


def rows_of(source: DataFrame, periods: DataFrame, period_type: str) -> DataFrame:
    """Rows of a cube that belong to the given periods.

    The overall range goes first as a plain comparison on ``t``; the semi join then takes out what
    lies between wanted periods.
    """
    starts = periods.select(period_start("period_id").alias("at"))
    high = F.max("at") + F.expr(PERIOD_STEPS[period_type])
    span = starts.agg(F.struct(F.min("at").alias("low"), high.alias("high"))).scalar()
    near = source.filter((F.col("t") >= span["low"]) & (F.col("t") < span["high"]))
    keyed = near.withColumn("period_id", period_id("t", period_type))
    return keyed.join(periods.select("period_id"), "period_id", "left_semi").drop("period_id")


def append_missing(
    source: DataFrame | Fetch,
    store: PeriodStore,
    template: Mapping[str, Any],
    start: str,
    end: str,
    cutoff: Column | None = None,
    same_cells: bool = False,
) -> int:
    """Store the periods of a range that are missing, and return how many were written.

    ``source`` is a cube, or a function that gives the rows of a table of periods. A period of
    another shape stops the run: the ones before it stay stored, it and later ones do not.
    """
    spark = store.spark
    wanted = enumerate_periods(spark, start, end, store.period_type, cutoff)
    pending = pending_periods(wanted, store.committed_periods())
    if pending.isEmpty():
        return 0
    store.refuse_unsafe_first_write()
    rows = source(pending) if callable(source) else rows_of(source, pending, store.period_type)
    return _store_rows(store, run_transforms(rows, template), uuid.uuid4().hex, same_cells)


def append_from(
    adapter: SourceAdapter,
    store: PeriodStore,
    template: Mapping[str, Any],
    start: str,
    end: str,
    bbox: tuple[float, float, float, float] | None = None,
    same_cells: bool = False,
) -> int:
    """Store the periods a source has to offer in a range and the store lacks; returns how many were written.

    The adapter names its periods and fetches only those that are missing.
    """
    offered = adapter.periods(start, end).select("period_id").distinct()
    pending = pending_periods(offered, store.committed_periods())
    if pending.isEmpty():
        return 0
    store.refuse_unsafe_first_write()
    rows = run_transforms(adapter.fetch(pending, bbox), template)
    return _store_rows(store, rows, uuid.uuid4().hex, same_cells)


def _store_rows(
    store: PeriodStore, rows: DataFrame, batch: str, same_cells: bool, landed: DataFrame | None = None
) -> int:
    generation = store.generation()
    generation = store.next_generation() if generation is None else generation
    store.announce(batch, generation)
    if landed is not None:  # before the ledger names the periods, so that no stored one lacks its files
        landed.write.mode("append").parquet(store.landed_path(generation))
    if not store.write_values(rows, batch, generation):
        return 0
    shapes = store.written_shapes(batch, generation)
    misfit = first_misfit(shapes, store.ledger(generation), same_cells)
    if misfit is None:
        return store.commit(shapes, batch, generation)
    good = shapes.filter(F.col("period_id") < misfit[0])
    if not good.isEmpty():
        store.commit(good, batch, generation, until=misfit[0])
    raise ShapeError(misfit[1])


def rematerialize(
    source: DataFrame | Fetch,
    store: PeriodStore,
    template: Mapping[str, Any],
    start: str,
    end: str,
    cutoff: Column | None = None,
) -> int:
    """Build the whole range anew and switch over. Readers see the old data until the new is complete."""
    spark = store.spark
    wanted = enumerate_periods(spark, start, end, store.period_type, cutoff)
    if wanted.isEmpty():
        raise NoDataError(f"No period between {start} and {end}")
    rows = source(wanted) if callable(source) else rows_of(source, wanted, store.period_type)
    batch, generation = uuid.uuid4().hex, store.next_generation()
    store.announce(batch, generation)
    if not store.write_values(run_transforms(rows, template), batch, generation):
        raise NoDataError(f"The source has no data between {start} and {end}")
    shapes = store.written_shapes(batch, generation)
    misfit = first_misfit(shapes, store.ledger(generation))
    if misfit is not None:
        raise ShapeError(misfit[1])
    return store.commit(shapes, batch, generation)


def refuse_split_periods(brought: DataFrame, committed: DataFrame, known: DataFrame) -> None:
    """Raise if a stored period comes again in a file that did not bring it."""
    stored = known.join(committed, "period_id", "left_semi")
    again = brought.join(stored.select("period_id").distinct(), "period_id", "left_semi")
    odd = again.join(stored, ["period_id", "file"], "left_anti").orderBy("period_id", "file").first()
    if odd is not None:
        raise SplitPeriodError(f"Period {odd['period_id']} is stored already, but {odd['file']} brings more rows of it")


class AppendProgress:
    """What a running append has done so far."""

    def __init__(self) -> None:
        self.periods_written = 0
        self.periods_skipped = 0
        self.batches = 0


def stream_append(
    spark: SparkSession,
    landing_dir: str,
    schema: T.StructType | str,
    store: PeriodStore,
    template: Mapping[str, Any],
    checkpoint: str,
    max_files_per_trigger: int = 64,
    same_cells: bool = False,
    available_now: bool = True,
) -> tuple[StreamingQuery, AppendProgress]:
    """Append as files land: the files of one trigger hold complete periods.

    The store keeps which file brought a period. A replayed batch finds its periods there and writes nothing, so the
    store ends up the same. A stored period that comes again in another file stops the query before anything of
    the batch is written, since it would be stored in part. Periods that were appended by other means
    are skipped and counted.
    """
    if max_files_per_trigger < 1:
        raise GridError("max_files_per_trigger must be positive")
    landed = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(landing_dir)
        .withColumn(FILE, F.col("_metadata.file_path"))
    )
    progress = AppendProgress()

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        session_store = PeriodStore(batch.sparkSession, store.path, store.period_type)
        keyed = batch.withColumn("period_id", period_id("t", store.period_type))
        brought = keyed.select("period_id", F.col(FILE).alias("file")).distinct().persist()
        try:
            present = brought.select("period_id").distinct()
            committed = session_store.committed_periods()
            known = session_store.landed()
            refuse_split_periods(brought, committed, known)
            pending = pending_periods(present, committed)
            progress.batches += 1
            progress.periods_skipped += present.join(committed, "period_id", "left_semi").count()
            if pending.isEmpty():
                return
            session_store.refuse_unsafe_first_write()
            rows = keyed.join(pending, "period_id", "left_semi").drop("period_id", FILE)
            new = brought.join(pending, "period_id", "left_semi")
            name = f"stream-{batch_id}-{uuid.uuid4().hex}"
            written = _store_rows(session_store, run_transforms(rows, template), name, same_cells, new)
            progress.periods_written += written
        finally:
            brought.unpersist()

    writer = landed.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    return query, progress
