"""Cube tables: reading, canonical columns, missing values and the storage layout."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.errors import GridError
from gridtide.functions.periods import iso_step_hours, steps_per_bucket
from gridtide.operators.select import filter_bbox, time_bounds
from gridtide.schema import key_columns, value_columns

# Accepted names of the axes, in order of preference.
TIME_NAMES = ("t", "valid_time", "time")
SPACE_NAMES = (("x", "y"), ("lon", "lat"), ("longitude", "latitude"))

BUCKET_KEY = "bucket_seconds"

# Tiles are numbered from this one, so that those left of and below the origin have numbers too.
FIRST_TILE = -(1 << 30)

# Size of a row group of a tiled store: small enough that a box needs few of the rows of a file.
ROW_GROUP_BYTES = 16 * 1024 * 1024


def normalise_axes(cube: DataFrame) -> DataFrame:
    """Rename the time and space columns to ``t``, ``x``, ``y``; times become naive."""
    time_name = next((name for name in TIME_NAMES if name in cube.columns), None)
    if time_name is None:
        raise GridError(f"No time column among {cube.columns}; expected one of {list(TIME_NAMES)}")
    space = next((pair for pair in SPACE_NAMES if set(pair) <= set(cube.columns)), None)
    if space is None:
        raise GridError(f"No coordinate columns among {cube.columns}; expected one of {list(SPACE_NAMES)}")
    renamed = cube.withColumnsRenamed({time_name: "t", space[0]: "x", space[1]: "y"})
    if not isinstance(renamed.schema["t"].dataType, T.TimestampNTZType):
        renamed = renamed.withColumn("t", F.col("t").cast("timestamp_ntz"))
    return renamed


def select_variable(cube: DataFrame, variable: str, extra_dims: Iterable[str] = ()) -> DataFrame:
    """The axes and one variable; every other coordinate is dropped."""
    if variable not in cube.columns:
        raise GridError(f"Variable '{variable}' not found. Available: {value_columns(cube, extra_dims)}")
    return cube.select(*key_columns(cube, extra_dims), variable)


def missing_if(value: Column, nodata: float | None) -> Column:
    bad = F.isnan(value) if nodata is None else F.isnan(value) | (value == F.lit(float(nodata)))
    return F.when(~bad, value)


def mask_nodata(cube: DataFrame, columns: Sequence[str] | None = None, nodata: float | None = None) -> DataFrame:
    """NaN and the sentinel become NULL, so that sums and means skip them."""
    columns = list(columns) if columns is not None else value_columns(cube)
    masked = cube.withColumns({name: missing_if(F.col(name).cast("double"), nodata) for name in columns})
    for name in columns:
        masked = masked.withMetadata(name, cube.schema[name].metadata)
    return masked


def read_many(spark: SparkSession, paths: Sequence[str], dataset_id: str | None = None) -> DataFrame:
    """Several files of one dataset as one cube. Rows are taken as they are, no values are merged.

    The dataset is matched by its exact id, so ``temperature`` never picks up ``temperature_max``.
    """
    if not paths:
        raise GridError("No files given")
    try:
        cube = spark.read.option("mergeSchema", "true").parquet(*paths)  # one scan, however many files
    except PySparkException:
        # stores of different layouts, or types that only a union widens
        parts = [spark.read.parquet(path) for path in paths]
        cube = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if dataset_id is not None:
        cube = cube.filter(F.col("dataset_id") == dataset_id)
    return normalise_axes(cube)


def read_cube(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    bbox: Sequence[float] | None = None,
    dataset_id: str | None = None,
) -> DataFrame:
    """Open a stored cube and cut it. Time is cut only if both ends are given; the box is inclusive."""
    cube = spark.read.parquet(path)
    if dataset_id is not None:
        cube = cube.filter(F.col("dataset_id") == dataset_id)
    cube = normalise_axes(cube)
    if start and end:
        cube = cut_by_bucket(cube, start, end)
    if bbox is not None:
        xmin, ymin, xmax, ymax = map(float, bbox)
        cube = filter_bbox(cube, west=xmin, south=ymin, east=xmax, north=ymax)
    return cube


def cut_by_bucket(cube: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Time range with both ends included, an open end where none is given.

    If the store carries the bucket width, the range also prunes its folders.
    """
    seconds = cube.schema["t"].metadata.get(BUCKET_KEY) if "time_bucket" in cube.columns else None
    if start:
        low = time_bounds(start, start)[0]
        if seconds:
            cube = cube.filter(F.col("time_bucket") >= bucket_of(low, seconds))
        cube = cube.filter(F.col("t") >= low)
    if end:
        high = time_bounds(end, end)[1]
        if seconds:
            cube = cube.filter(F.col("time_bucket") <= bucket_of(high, seconds))
        cube = cube.filter(F.col("t") < high)
    return cube


def bucket_of(t: Column, seconds: int | Column) -> Column:
    width = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.floor(F.unix_seconds(t.cast("timestamp")) / width).cast("int")


def bucket_seconds(spark: SparkSession, iso_step: str | None) -> int:
    """Seconds of data per storage bucket for an ISO step; an unknown step counts as days."""
    step = F.lit(iso_step).cast("string")
    hours = F.coalesce(iso_step_hours(step), F.lit(24.0))
    return int(spark.range(1).select(F.ceil(steps_per_bucket(step) * hours * 3600)).first()[0])


def time_bucket(cube: DataFrame, seconds: int) -> DataFrame:
    """Add the storage bucket and note its width on ``t`` so that readers can prune by it."""
    metadata = {**cube.schema["t"].metadata, BUCKET_KEY: seconds}
    return cube.withColumn("time_bucket", bucket_of(F.col("t"), seconds)).withMetadata("t", metadata)


def tile_order(tile: tuple[float, float]) -> Column:
    """Number of the tile of a cell on a Z-shaped curve: the bits of its row and column by turns, so near tiles come near each other."""

    def spread(number: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            number = number.bitwiseOR(F.shiftleft(number, shift)).bitwiseAND(F.lit(mask))
        return number

    across, down = (spread(F.floor(F.col(axis) / F.lit(float(size))).cast("bigint") - FIRST_TILE) for axis, size in zip("xy", tile))
    return across.bitwiseOR(F.shiftleft(down, 1))


def in_layout(bucketed: DataFrame, layout: Sequence[str], tile: tuple[float, float] | None = None) -> DataFrame:
    """Rows dealt out and sorted as a store holds them: by ``layout``, then by cell, or with ``tile`` by tile and cell."""
    if tile is None:
        return bucketed.hint("rebalance", *layout).sortWithinPartitions(*layout, "y", "x", "t")
    # blocks of 16 x 16 tiles stay together, so that a task holds few stretches of the curve
    tiled = bucketed.withColumn("__tile", tile_order(tile)).withColumn("__block", F.shiftright("__tile", 8))
    tiled = tiled.hint("rebalance", *layout, "__block").sortWithinPartitions(*layout, "__tile", "y", "x", "t")
    return tiled.drop("__tile", "__block")


def write_cube(
    cube: DataFrame,
    path: str,
    mode: str = "overwrite",
    dataset_id: str | None = None,
    iso_step: str | None = "P1D",
    tile: tuple[float, float] | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """Write a cube by dataset and time bucket.

    ``overwrite`` replaces the store, ``append`` adds rows, ``replace_buckets`` replaces only
    the buckets that occur in the cube. The rebalance splits a bucket that is too big for one
    task and joins small ones; sorting by cell keeps each file's box narrow. With ``tile``, a width and height in the
    units of the axes, cells are dealt out and sorted by tiles along a Z-shaped curve and row groups are kept small, so that a
    reader with a box skips most of them.
    """
    if mode not in ("overwrite", "append", "replace_buckets"):
        raise GridError(f"Unknown write mode '{mode}'")
    if dataset_id is not None:
        cube = cube.withColumn("dataset_id", F.lit(dataset_id))
    elif "dataset_id" not in cube.columns:
        raise GridError("A dataset_id column or argument is needed")
    seconds = bucket_seconds(cube.sparkSession, iso_step)
    layout = ["dataset_id", "time_bucket"]
    laid_out = in_layout(time_bucket(cube, seconds), layout, tile)
    overwrite = "static" if mode == "overwrite" else "dynamic"
    writer = laid_out.write.mode("append" if mode == "append" else "overwrite").option("partitionOverwriteMode", overwrite)
    if tile is not None:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.partitionBy(*layout).parquet(path)
