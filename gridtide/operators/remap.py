"""Regridding by weights: how much each source cell counts for a target cell.

On one coordinate system the weight of a pair of cells is the product of two weights along the axes, so two tables as
short as an axis are joined with the cube where it lies. Between coordinate systems there is one table with a
few rows for each target cell. The sums are aggregated on the map side, and only cells that have a value count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.errors import GridError
from gridtide.functions.crs import transform_point
from gridtide.schema import key_columns, value_columns
from gridtide.sources.grid import GridSpec

# Methods by weights. "average" is the mean over the area, "sum" keeps the total.
WEIGHTED_METHODS = ("bilinear", "average", "sum")

# Shares below this come from rounding of the axes.
LEAST_OVERLAP = 1e-9


def axis_overlaps(spark: SparkSession, source: tuple[float, float, int], target: tuple[float, float, int]) -> DataFrame:
    """``target, source, share``: the share of each source cell that lies in a target cell, along one axis.

    An axis is the first centre, the step and the number of cells.
    """
    (s0, ds, ns), (t0, dt, nt) = source, target
    start = ((F.lit(t0) + F.col("id") * F.lit(dt) - abs(dt) / 2) - s0) / ds
    end = ((F.lit(t0) + F.col("id") * F.lit(dt) + abs(dt) / 2) - s0) / ds
    cells = spark.range(nt).select(F.col("id").alias("target"), F.least(start, end).alias("a"), F.greatest(start, end).alias("b"))
    low, high = F.greatest(F.floor(F.col("a") + 0.5), F.lit(0)), F.least(F.ceil(F.col("b") - 0.5), F.lit(ns - 1))
    near = cells.filter((F.col("b") > -0.5) & (F.col("a") < ns - 0.5)).withColumn("low", low).withColumn("high", high)
    pairs = near.filter("low <= high").select("target", "a", "b", F.explode(F.sequence("low", "high")).alias("source"))
    share = F.least(F.col("b"), F.col("source") + 0.5) - F.greatest(F.col("a"), F.col("source") - 0.5)
    return pairs.select("target", "source", share.alias("share")).filter(F.col("share") > LEAST_OVERLAP)


def _neighbours(place: Column, count: int) -> Column:
    """The two cells around a place on an axis with their weights; the ends take what lies beyond them within half a cell."""
    held = F.least(F.greatest(place, F.lit(0.0)), F.lit(count - 1.0))
    low = F.floor(held).cast("bigint")
    part = held - low
    both = F.array(
        F.struct(low.alias("source"), (F.lit(1.0) - part).alias("share")), F.struct((low + 1).alias("source"), part.alias("share"))
    )
    inside = (place > -0.5 - LEAST_OVERLAP) & (place < count - 0.5 + LEAST_OVERLAP)
    return F.when(inside, F.filter(both, lambda n: n["share"] > LEAST_OVERLAP))


def axis_neighbours(spark: SparkSession, source: tuple[float, float, int], target: tuple[float, float, int]) -> DataFrame:
    """``target, source, share``: the source cells around the centre of each target cell, along one axis."""
    (s0, ds, ns), (t0, dt, nt) = source, target
    place = (F.lit(t0) + F.col("id") * F.lit(dt) - s0) / ds
    return spark.range(nt).select(F.col("id").alias("target"), F.inline(_neighbours(place, ns)))


def _folded(rows: DataFrame, keys: Sequence[str], values: Sequence[str], method: str) -> list[Column]:
    w = F.col("__w")
    out = []
    for name in values:
        v = F.col(name).cast("double")
        total = F.sum(v * w)
        out.append((total if method == "sum" else total / F.sum(F.when(v.isNotNull(), w))).alias(name))
    return out


def remap(
    cube: DataFrame, source: GridSpec, target: GridSpec, method: str = "average", extra_dims: Sequence[str] = ()
) -> DataFrame:
    """Put a cube on another grid in the same coordinate system by weights.

    ``average`` takes the mean over the area of a target cell, ``sum`` splits the amount of each source cell by area, so that
    totals are kept as far as the grids overlap, and ``bilinear`` weighs the four cells around a centre. Missing cells
    do not count: means are over the weights of cells that have a value. A target cell that meets no cell of the
    cube has no row, one that meets only missing values has a missing value.
    """
    if method not in WEIGHTED_METHODS:
        raise GridError(f"Unsupported method '{method}'. Supported: near, {', '.join(WEIGHTED_METHODS)}")
    spark = cube.sparkSession
    maps = axis_neighbours if method == "bilinear" else axis_overlaps
    keys = [k for k in key_columns(cube, extra_dims, drop=("x", "y"))]
    values = value_columns(cube, extra_dims)
    along = {
        "x": maps(spark, (source.x0, source.dx, source.nx), (target.x0, target.dx, target.nx)),
        "y": maps(spark, (source.y0, source.dy, source.ny), (target.y0, target.dy, target.ny)),
    }
    rows = cube.select(*keys, *values, source.ix(F.col("x")).alias("__ix"), source.iy(F.col("y")).alias("__iy"))
    for axis, table in along.items():
        rows = rows.join(table.select(F.col("source").alias(f"__i{axis}"), F.col("target").alias(f"__t{axis}"), F.col("share").alias(f"__w{axis}")), f"__i{axis}")
    weighted = rows.withColumn("__w", F.col("__wx") * F.col("__wy"))
    folded = weighted.groupBy(*keys, "__ty", "__tx").agg(*_folded(weighted, keys, values, method))
    return folded.select(*keys, target.y_at(F.col("__ty")).alias("y"), target.x_at(F.col("__tx")).alias("x"), *values)


def reproject_bilinear(cube: DataFrame, source: GridSpec, target: GridSpec, extra_dims: Sequence[str] = ()) -> DataFrame:
    """Put a cube on a grid in another coordinate system, from the four source cells around each projected centre.

    The table of weights has up to four rows for each target cell and is joined on integer cell numbers. Missing cells
    do not count, as in ``remap``.
    """
    back = transform_point(F.struct("x", "y"), target.crs, source.crs)
    centres = target.cells(cube.sparkSession).select("iy", "ix", back.alias("at"))
    px, py = (F.col("at.x") - source.x0) / source.dx, (F.col("at.y") - source.y0) / source.dy
    across = centres.select("iy", "ix", py.alias("py"), F.inline(_neighbours(px, source.nx))).withColumnsRenamed({"source": "__ix", "share": "__wx"})
    table = across.select("iy", "ix", "__ix", "__wx", F.inline(_neighbours(F.col("py"), source.ny)))
    table = table.select("iy", "ix", "__ix", F.col("source").alias("__iy"), (F.col("__wx") * F.col("share")).alias("__w"))
    keys = [k for k in key_columns(cube, extra_dims, drop=("x", "y"))]
    values = value_columns(cube, extra_dims)
    rows = cube.select(*keys, *values, source.ix(F.col("x")).alias("__ix"), source.iy(F.col("y")).alias("__iy")).join(table, ["__iy", "__ix"])
    folded = rows.groupBy(*keys, "iy", "ix").agg(*_folded(rows, keys, values, "bilinear"))
    return folded.select(*keys, target.y_at(F.col("iy")).alias("y"), target.x_at(F.col("ix")).alias("x"), *values)
