"""Reducing dimensions, summaries of a cube, and coarser overviews."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.errors import GridError
from gridtide.functions.crs import WGS84, bounds_wgs84
from gridtide.functions.periods import period_id
from gridtide.functions.reducers import Reducer, reducer
from gridtide.schema import folded_columns, key_columns, value_columns
from gridtide.sources.cube import bucket_of, bucket_seconds, write_cube
from gridtide.sources.grid import GridSpec

# When overviews are needed, and how many.
OVERVIEW_CELLS = 2048 * 2048
OVERVIEW_TILE = 512
OVERVIEW_MIN_LEVELS = 2
OVERVIEW_MAX_LEVELS = 8

# Fixed value: decimals of a spatial step.
STEP_DECIMALS = 8


def reduce_dimension(
    cube: DataFrame, dimension: str, reducer_name: str | Reducer, extra_dims: Sequence[str] = ()
) -> DataFrame:
    """Collapse one dimension (``t``, ``x``, ``y``, ``bands`` or a further one) with a reducer."""
    column = "band" if dimension == "bands" else dimension
    keys = key_columns(cube, extra_dims)
    if column not in keys:
        raise GridError(f"Dimension '{dimension}' not found. Available: {keys}")
    fold = reducer(reducer_name)
    keys, values = folded_columns(cube, extra_dims)
    return cube.groupBy(*[k for k in keys if k != column]).agg(*[fold(F.col(v)).alias(v) for v in values])


def reduce_bands(stacked: DataFrame, reducer_name: str | Reducer, extra_dims: Sequence[str] = ()) -> DataFrame:
    """Collapse the band labels of a stacked cube."""
    return reduce_dimension(stacked, "bands", reducer_name, extra_dims)


def reduce_spatial(cube: DataFrame, reducer_name: str | Reducer, extra_dims: Sequence[str] = ()) -> DataFrame:
    """One value per time step over all cells."""
    fold = reducer(reducer_name)
    keys, values = folded_columns(cube, extra_dims, drop=("x", "y"))
    return cube.groupBy(*keys).agg(*[fold(F.col(v)).alias(v) for v in values])


def coverage(cube: DataFrame, period_type: str, crs: str = WGS84) -> DataFrame:
    """Extent of a cube in one row: first and last period, box, and the longitude/latitude box if it differs."""
    measured = cube.agg(
        F.count("t").alias("steps"),
        F.min("t").alias("t0"),
        F.max("t").alias("t1"),
        *[fn(axis).cast("double").alias(f"{axis}{fn.__name__}") for axis in ("x", "y") for fn in (F.min, F.max)],
    )
    return described_extent(measured, period_type, crs)


def described_extent(measured: DataFrame, period_type: str, crs: str = WGS84) -> DataFrame:
    """The row of ``coverage`` from ``steps``, first and last time ``t0, t1`` and the box of the cell centres."""
    box = [F.col(name) for name in ("xmin", "ymin", "xmax", "ymax")]
    return measured.select(
        (F.col("steps") > 0).alias("has_data"),
        period_id("t0", period_type).alias("start"),
        period_id("t1", period_type).alias("end"),
        *["xmin", "ymin", "xmax", "ymax"],
        F.when(F.col("steps") > 0, bounds_wgs84(*box, crs)).alias("spatial_wgs84"),
    )


def axis_summary(
    cube: DataFrame, iso_step: str | None = None, descending: Sequence[str] = (), by: Sequence[str] = ()
) -> DataFrame:
    """Extent, size and step of every axis, per ``by`` group.

    One pass collects the distinct values of all axes; only these, and never the cube, are ordered.
    The spatial step is the median gap, rounded and negative for an axis that runs downwards; the
    step of the time axis is the declared one. Time extents are seconds since the epoch in
    ``low``/``high`` and naive times in ``start``/``end``.
    """
    seconds = F.unix_micros(F.col("t").cast("timestamp")) / 1e6
    entries = [
        F.struct(F.lit("t").alias("axis"), seconds.alias("at")),
        F.struct(F.lit("x").alias("axis"), F.col("x").cast("double").alias("at")),
        F.struct(F.lit("y").alias("axis"), F.col("y").cast("double").alias("at")),
    ]
    values = cube.select(*by, F.inline(F.array(*entries))).distinct()
    gap = F.lead("at").over(Window.partitionBy(*by, "axis").orderBy("at")) - F.col("at")
    sign = F.when(F.col("axis").isin(*descending), -1.0).otherwise(1.0) if descending else F.lit(1.0)
    temporal = F.col("axis") == "t"
    measured = values.withColumn("gap", gap).groupBy(*by, "axis").agg(
        F.count("at").alias("size"),
        F.min("at").alias("low"),
        F.max("at").alias("high"),
        F.percentile("gap", F.lit(0.5)).alias("gap"),
    )

    def as_time(name: str):
        return F.when(temporal, F.timestamp_micros((F.col(name) * 1e6).cast("bigint")).cast("timestamp_ntz"))

    return measured.select(
        *by,
        "axis",
        F.when(temporal, "temporal").otherwise("spatial").alias("type"),
        "size",
        "low",
        "high",
        as_time("low").alias("start"),
        as_time("high").alias("end"),
        F.when(~temporal, F.round(F.col("gap") * sign, STEP_DECIMALS)).alias("step"),
        F.when(temporal, F.lit(iso_step)).alias("iso_step"),
    )


def variable_summary(cube: DataFrame, extra_dims: Sequence[str] = ()) -> DataFrame:
    """One row per variable with its dimensions, long name and units. Read from the schema, no job runs.

    Columns that are neither keys nor numeric are helpers without dimensions and are left out.
    """
    dimensions = key_columns(cube, extra_dims, drop=("dataset_id",))
    rows = []
    for name in value_columns(cube, extra_dims):
        metadata = cube.schema[name].metadata
        rows.append((name, dimensions, metadata.get("long_name"), metadata.get("units")))
    schema = "variable string, dimensions array<string>, long_name string, units string"
    return cube.sparkSession.createDataFrame(rows, schema)


def overview_levels(grid: GridSpec) -> int:
    """Levels above the base; 0 for a grid that needs none."""
    if grid.nx * grid.ny <= OVERVIEW_CELLS:
        return 0
    wanted = math.ceil(math.log2(max(grid.nx, grid.ny) / OVERVIEW_TILE))
    return max(OVERVIEW_MIN_LEVELS, min(wanted, OVERVIEW_MAX_LEVELS))


def coarser_grid(grid: GridSpec) -> GridSpec:
    """Grid of 2x2 blocks; an odd last row or column is trimmed."""
    return replace(
        grid,
        x0=grid.x0 + grid.dx / 2,
        dx=grid.dx * 2,
        nx=grid.nx // 2,
        y0=grid.y0 + grid.dy / 2,
        dy=grid.dy * 2,
        ny=grid.ny // 2,
    )


def coarsen(cube: DataFrame, grid: GridSpec, extra_dims: Sequence[str] = ()) -> tuple[DataFrame, GridSpec]:
    """One overview level: means of 2x2 blocks over the values that exist, and the new grid."""
    target = coarser_grid(grid)
    values = value_columns(cube, extra_dims)
    keys = key_columns(cube, extra_dims, drop=("x", "y"))
    block_y = F.floor(grid.iy(F.col("y")) / 2).cast("bigint")
    block_x = F.floor(grid.ix(F.col("x")) / 2).cast("bigint")
    blocks = cube.select(*keys, block_y.alias("__by"), block_x.alias("__bx"), *values).filter(
        F.col("__by").between(0, target.ny - 1) & F.col("__bx").between(0, target.nx - 1)
    )
    means = blocks.groupBy(*keys, "__by", "__bx").agg(*[F.avg(v).alias(v) for v in values])
    placed = means.select(
        *keys, target.y_at(F.col("__by")).alias("y"), target.x_at(F.col("__bx")).alias("x"), *values
    )
    return placed, target


def build_overviews(
    cube: DataFrame, grid: GridSpec, path: str, levels: int | None = None, extra_dims: Sequence[str] = ()
) -> list[tuple[str, GridSpec]]:
    """Write every overview level below ``path``, each from the one before.

    A level is read back before the next is built, so no level recomputes its predecessors.
    """
    spark = cube.sparkSession
    levels = overview_levels(grid) if levels is None else levels
    written = []
    for level in range(1, levels + 1):
        cube, grid = coarsen(cube, grid, extra_dims)
        target = f"{path.rstrip('/')}/level_{level}"
        cube.write.mode("overwrite").parquet(target)
        cube = spark.read.parquet(target)
        written.append((target, grid))
    return written


def update_overviews(
    cube: DataFrame,
    grid: GridSpec,
    path: str,
    changed: DataFrame,
    levels: int | None = None,
    iso_step: str | None = "P1D",
    dataset_id: str = "overview",
    extra_dims: Sequence[str] = (),
) -> list[tuple[str, GridSpec]]:
    """Bring the overview levels below ``path`` up to a cube that has new or rewritten times ``t`` in ``changed``.

    Levels are stored by time bucket. Only buckets with a changed time go up, level by level: they are read from the level
    below, and replace the same buckets there; all other files stay as they are. A first call with all times
    builds everything. Times that have no row any more keep their old blocks. Use ``read_overview`` to read a level.
    """
    spark = cube.sparkSession
    seconds = bucket_seconds(spark, iso_step)
    touched = changed.select(bucket_of(F.col("t"), seconds).alias("time_bucket")).distinct().persist()
    try:
        low, high = touched.agg(F.min("time_bucket"), F.max("time_bucket")).first()
        written = []
        source = cube.withColumn("time_bucket", bucket_of(F.col("t"), seconds))
        for level in range(1, (overview_levels(grid) if levels is None else levels) + 1):
            target = f"{path.rstrip('/')}/level_{level}"
            if low is not None:
                first, last = (F.timestamp_seconds(F.lit(b * seconds)).cast("timestamp_ntz") for b in (low, high + 1))
                near = source.filter((F.col("t") >= first) & (F.col("t") < last) & F.col("time_bucket").between(low, high))
                near = near.join(touched, "time_bucket", "left_semi").drop("time_bucket", "dataset_id")
                coarse, grid = coarsen(near, grid, extra_dims)
                write_cube(coarse, target, "replace_buckets", dataset_id, iso_step)
                source = spark.read.parquet(target)
            else:
                grid = coarser_grid(grid)
            written.append((target, grid))
        return written
    finally:
        touched.unpersist()


def read_overview(spark: SparkSession, path: str) -> DataFrame:
    """The cube of a level that ``update_overviews`` keeps."""
    return spark.read.parquet(path).drop("time_bucket", "dataset_id")
