"""A store that grows period by period.

Layout below the store path::

    generation=<n>/data/batch=<b>/time_bucket=<k>/...   the values, one folder per write
    generation=<n>/ledger/...                           one row per stored period, with its batch
    generation=<n>/shapes/batch=<b>/...                 shapes of what a write holds, before it counts
    generation=<n>/landed/...                           which landed file brought a period
    intents/...                                         what a writer was about to store

A period counts as stored only once the ledger names it. Every write goes to a folder of its own
and becomes visible with its ledger rows, so a crash in between leaves nothing to repair and files
are as large as the write allows, however many periods it holds. A rebuild goes to the next
generation, which takes over when its ledger is complete.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.errors import ShapeError, UnsafeStoreError
from gridtide.functions.crs import WGS84
from gridtide.functions.periods import period_id, period_start
from gridtide.operators.reduce import coverage, described_extent
from gridtide.sources import files
from gridtide.sources.cube import ROW_GROUP_BYTES, bucket_seconds, cut_by_bucket, in_layout, time_bucket

LEDGER_SCHEMA = (
    "period_id string, ny bigint, nx bigint, cells bigint, cell_hash decimal(38,0), batch string, until timestamp_ntz, "
    "t_min timestamp_ntz, t_max timestamp_ntz, x_min double, x_max double, y_min double, y_max double"
)
# ISO step of each period type, which sets the width of a time bucket.
ISO_STEPS = {"hourly": "PT1H", "daily": "P1D", "weekly": "P1W", "monthly": "P1M", "yearly": "P1Y"}

INTENT_SCHEMA = "batch string, generation int"
LANDED_SCHEMA = "period_id string, file string"


class PeriodStore:
    """One dataset's periods on shared storage."""

    def __init__(
        self, spark: SparkSession, path: str, period_type: str = "daily", tile: tuple[float, float] | None = None
    ) -> None:
        """``tile`` lays values out by tiles of that width and height, see ``write_cube``."""
        self.spark = spark
        self.path = path.rstrip("/")
        self.period_type = period_type
        self.tile = tile

    # -- where things are -------------------------------------------------

    def _generations(self) -> list[int]:
        names = files.child_names(self.spark, self.path)
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("generation="))

    def data_path(self, generation: int) -> str:
        return f"{self.path}/generation={generation:06d}/data"

    def ledger_path(self, generation: int) -> str:
        return f"{self.path}/generation={generation:06d}/ledger"

    def generation(self) -> int | None:
        """The newest generation with a complete ledger."""
        complete = [g for g in self._generations() if files.is_complete(self.spark, self.ledger_path(g))]
        return complete[-1] if complete else None

    def next_generation(self) -> int:
        return max(self._generations(), default=-1) + 1

    # -- what is stored ---------------------------------------------------

    def ledger(self, generation: int | None = None) -> DataFrame:
        generation = self.generation() if generation is None else generation
        if generation is None or not files.is_complete(self.spark, self.ledger_path(generation)):
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(self.ledger_path(generation))

    def committed_periods(self) -> DataFrame:
        """Distinct stored periods; none for a store that does not exist."""
        return self.ledger().select("period_id").distinct()

    def landed(self) -> DataFrame:
        """Which landed files brought which periods; a period that was appended otherwise has none."""
        generation = self.generation()
        if generation is None or not files.is_complete(self.spark, self.landed_path(generation)):
            return self.spark.createDataFrame([], LANDED_SCHEMA)
        return self.spark.read.schema(LANDED_SCHEMA).parquet(self.landed_path(generation)).distinct()

    def landed_path(self, generation: int) -> str:
        return f"{self.path}/generation={generation:06d}/landed"

    def read(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """The stored values. A batch that the ledger does not name stays out of sight.

        A range, both ends included, is cut by bucket folders first and by time then.

        Batches are partitions and their list is one row per write, so whole folders are pruned;
        ``until`` cuts a batch whose later periods were refused.
        """
        generation = self.generation()
        if generation is None:
            raise FileNotFoundError(f"No stored periods at {self.path}")
        data = self.spark.read.parquet(self.data_path(generation)).withColumn("batch", F.col("batch").cast("string"))
        data = cut_by_bucket(data, start, end)
        batches = self.ledger(generation).groupBy("batch").agg(F.min("until").alias("until"))
        visible = data.join(batches, "batch").filter(F.col("until").isNull() | (F.col("t") < F.col("until")))
        return visible.drop("batch", "until", "time_bucket")

    def coverage(self, crs: str = WGS84) -> DataFrame:
        """What ``coverage`` says of the stored values, from the extents that the ledger keeps of every period.

        Extents merge, so no value is read. Only a ledger with entries from before extents were kept sends
        the question to the values.
        """
        ledger = self.ledger()
        if not ledger.filter(F.col("t_min").isNull()).isEmpty():
            return coverage(self.read(), self.period_type, crs)
        ends = [fn(f"{axis}_{fn.__name__}").alias(f"{axis}{fn.__name__}") for axis in ("x", "y") for fn in (F.min, F.max)]
        measured = ledger.agg(F.count("*").alias("steps"), F.min("t_min").alias("t0"), F.max("t_max").alias("t1"), *ends)
        return described_extent(measured, self.period_type, crs)

    # -- changing it ------------------------------------------------------

    def refuse_unsafe_first_write(self) -> None:
        """Raise if there are values but neither a ledger nor an intent explains them."""
        if self.generation() is not None:
            return
        holds_data = any(files.child_names(self.spark, self.data_path(g)) for g in self._generations())
        strangers = [
            n for n in files.child_names(self.spark, self.path) if n != "intents" and not n.startswith("generation=")
        ]
        if (holds_data and not self._has_intents()) or strangers:
            raise UnsafeStoreError(
                f"{self.path} holds files that no finished or announced write explains; nothing was written"
            )

    def _has_intents(self) -> bool:
        try:
            return not self.spark.read.schema(INTENT_SCHEMA).json(f"{self.path}/intents").isEmpty()
        except AnalysisException:
            return False

    def announce(self, batch: str, generation: int) -> None:
        row = self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(generation).alias("generation"))
        row.write.mode("append").json(f"{self.path}/intents")

    def batch_path(self, batch: str, generation: int) -> str:
        return f"{self.data_path(generation)}/batch={batch}"

    def write_values(self, rows: DataFrame, batch: str, generation: int) -> bool:
        """Write one batch, and say whether it has any row. The rebalance splits what is too big for one task."""
        seconds = bucket_seconds(self.spark, ISO_STEPS[self.period_type])
        writer = in_layout(time_bucket(rows, seconds), ["time_bucket"], self.tile).write.mode("overwrite")
        if self.tile is not None:
            writer = writer.option("parquet.block.size", ROW_GROUP_BYTES)
        writer.option("partitionOverwriteMode", "static").partitionBy("time_bucket").parquet(self.batch_path(batch, generation))
        return bool(files.child_names(self.spark, self.batch_path(batch, generation)))

    def written_shapes(self, batch: str, generation: int) -> DataFrame:
        """Shapes and extents of a batch as it lies on disk, from its axis columns alone; counted once and kept beside it."""
        data = self.spark.read.parquet(self.batch_path(batch, generation))
        shapes = period_shapes(data.select(period_id("t", self.period_type).alias("period_id"), "t", "y", "x"), extents=True)
        path = f"{self.path}/generation={generation:06d}/shapes/batch={batch}"
        shapes.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(shapes.schema).parquet(path)

    def commit(self, shapes: DataFrame, batch: str, generation: int, until: str | None = None) -> int:
        """Add the periods of a batch to the ledger, up to but not including ``until``. Returns their number."""
        end = period_start(F.lit(until).cast("string"))
        entries = shapes.select(*shapes.columns, F.lit(batch).alias("batch"), end.alias("until"))
        # one small file; the shapes were written down before, so this task only copies a row for each period
        entries.coalesce(1).write.mode("append").parquet(self.ledger_path(generation))
        return self.ledger(generation).filter(F.col("batch") == batch).count()


def period_shapes(rows: DataFrame, extents: bool = False) -> DataFrame:
    """Cells per axis, cell count and a hash of the cell set per period, and with ``extents`` the ends of all axes.

    The distinct coordinates are kept as sets, which are as long as an axis, so a row is counted once
    and not once for each axis.
    """
    return rows.groupBy("period_id").agg(
        F.size(F.collect_set("y")).cast("bigint").alias("ny"),
        F.size(F.collect_set("x")).cast("bigint").alias("nx"),
        F.count("*").alias("cells"),
        F.sum(F.xxhash64("y", "x").cast("decimal(38,0)")).cast("decimal(38,0)").alias("cell_hash"),
        *[
            fn(F.col(axis).cast("timestamp_ntz" if axis == "t" else "double")).alias(f"{axis}_{fn.__name__}")
            for axis in ("t", "x", "y")
            for fn in (F.min, F.max)
            if extents
        ],
    )


def first_misfit(shapes: DataFrame, stored: DataFrame, same_cells: bool = False) -> tuple[str, str] | None:
    """Earliest new period whose shape is not the expected one, with the reason.

    Expected is the shape of the stored periods, or of the earliest new period in an empty store.
    ``same_cells`` also wants the same set of cells.
    """
    fields = ["ny", "nx", "cells", "cell_hash"] if same_cells else ["ny", "nx"]
    shape = F.struct(*fields)
    reference = (
        stored.select("period_id", shape.alias("shape"), F.lit(0).alias("rank"))
        .unionByName(shapes.select("period_id", shape.alias("shape"), F.lit(1).alias("rank")))
        .agg(F.min_by("shape", F.struct("rank", "period_id")))
        .scalar()
    )
    compared = shapes.select("period_id", shape.alias("shape"), reference.alias("expected"))
    row = (
        compared.filter(~F.col("shape").eqNullSafe(F.col("expected")))
        .agg(F.min_by(F.struct("period_id", "shape", "expected"), "period_id").alias("m"))
        .first()["m"]
    )
    if row is None:
        return None
    got, want = row["shape"], row["expected"]
    text = f"({got['ny']}, {got['nx']}), expected ({want['ny']}, {want['nx']})"
    if same_cells and (got["ny"], got["nx"]) == (want["ny"], want["nx"]):
        text += " with another set of cells"
    # fixed value: the words "has spatial shape" are part of the contract
    return row["period_id"], f"Period {row['period_id']} has spatial shape {text}"


def assert_shape(shapes: DataFrame, stored: DataFrame, same_cells: bool = False) -> None:
    """Raise if any new period does not have the expected shape."""
    misfit = first_misfit(shapes, stored, same_cells)
    if misfit is not None:
        raise ShapeError(misfit[1])
