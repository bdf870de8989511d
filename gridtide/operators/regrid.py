"""Moving a cube to another grid or coordinate system, by nearest cell or by weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.errors import GridError
from gridtide.functions.crs import normalise_crs, transform_bounds, transform_point
from gridtide.operators.remap import WEIGHTED_METHODS, remap, reproject_bilinear
from gridtide.operators.select import nearest_on_axis
from gridtide.schema import key_columns, value_columns
from gridtide.sources.grid import GridSpec, axis_number, infer_grid


def resample_cube_spatial(
    cube: DataFrame,
    target: GridSpec,
    method: str = "near",
    extra_dims: Sequence[str] = (),
    cells: DataFrame | None = None,
    source: GridSpec | None = None,
) -> DataFrame:
    """Put a cube on another grid in the same coordinate system.

    With ``source``, the grid of the cube, the maps are computed and the cube is read once.

    Columns and rows of the target are matched to the source axis by axis. Both maps are as short
    as an axis, so the cube is joined with them where it lies and no cell-by-cell table arises.
    ``cells`` may name a cheaper table with the same axis values, such as the cells of the grid.
    The methods ``bilinear``, ``average`` and ``sum`` weigh cells, see ``remap``; without ``source`` the grid is
    derived from the axes of the cube.
    """
    if method in WEIGHTED_METHODS:
        return remap(cube, source or infer_grid(cube), target, method, extra_dims)
    if method != "near":
        raise GridError(f"Unsupported method '{method}'. Supported: near, {', '.join(WEIGHTED_METHODS)}")
    spark = cube.sparkSession
    keys = key_columns(cube, extra_dims, drop=("x", "y"))
    if source is not None:
        columns = spark.range(target.nx).select(target.x_at(F.col("id")).alias("tx"))
        rows = spark.range(target.ny).select(target.y_at(F.col("id")).alias("ty"))
        numbered = cube.withColumns({"__ix": source.ix(F.col("x")), "__iy": source.iy(F.col("y"))})
        moved = numbered.join(columns.withColumn("__ix", source.nearest_ix(F.col("tx"))), "__ix")
        moved = moved.join(rows.withColumn("__iy", source.nearest_iy(F.col("ty"))), "__iy")
        return moved.select(*keys, F.col("ty").alias("y"), F.col("tx").alias("x"), *value_columns(cube, extra_dims))
    cells = cube if cells is None else cells
    columns = spark.range(target.nx).select(target.x_at(F.col("id")).alias("tx"))
    rows = spark.range(target.ny).select(target.y_at(F.col("id")).alias("ty"))
    x_map = nearest_on_axis(columns, "tx", cells.select("x"), "x", "x").select("x", "tx")
    y_map = nearest_on_axis(rows, "ty", cells.select("y"), "y", "y").select("y", "ty")
    moved = cube
    for axis, axis_map in (("x", x_map), ("y", y_map)):
        here, there = axis_number([cells, axis_map], axis)
        moved = moved.withColumn(f"__i{axis}", here).join(
            axis_map.select(there.alias(f"__i{axis}"), f"t{axis}"), f"__i{axis}"
        )
    return moved.select(*keys, F.col("ty").alias("y"), F.col("tx").alias("x"), *value_columns(cube, extra_dims))


def projected_grid(cube: DataFrame, source: GridSpec, target_crs: str) -> GridSpec:
    """Regular grid in the target system around the projected source box, with as many cells per axis."""
    box = [F.lit(value) for value in source.outer_box]
    row = cube.sparkSession.range(1).select(transform_bounds(*box, source.crs, target_crs).alias("b")).first()["b"]
    dx = (row["xmax"] - row["xmin"]) / source.nx
    dy = (row["ymax"] - row["ymin"]) / source.ny
    return GridSpec(
        row["xmin"] + dx / 2, dx, source.nx, row["ymin"] + dy / 2, dy, source.ny, crs=normalise_crs(target_crs)
    )


def reproject(
    cube: DataFrame,
    source_crs: str = "EPSG:4326",
    target_crs: str = "EPSG:4326",
    source_grid: GridSpec | None = None,
    target_grid: GridSpec | None = None,
    extra_dims: Sequence[str] = (),
    method: str = "near",
) -> DataFrame:
    """Cube on a regular grid in another coordinate system; unchanged if the systems are equal.

    Each target cell is projected back and takes the source cell it falls into. The map from target
    to source cells has one row per target cell and is joined on integer cell numbers; hand in the
    grids to spare the aggregate that derives them. ``bilinear`` weighs the four source cells around it instead.
    """
    if method not in ("near", "bilinear"):
        raise GridError(f"Unsupported method '{method}'. Supported: near, bilinear")
    if normalise_crs(source_crs) == normalise_crs(target_crs):
        return cube
    source = (source_grid or infer_grid(cube)).with_crs(normalise_crs(source_crs))
    target = (target_grid or projected_grid(cube, source, target_crs)).with_crs(normalise_crs(target_crs))
    if method == "bilinear":
        return reproject_bilinear(cube, source, target, extra_dims)
    back = transform_point(F.struct("x", "y"), target_crs, source_crs)
    cell_map = (
        target.cells(cube.sparkSession)
        .select(F.col("x").alias("tx"), F.col("y").alias("ty"), back.alias("at"))
        .select("tx", "ty", source.ix(F.col("at.x")).alias("__ix"), source.iy(F.col("at.y")).alias("__iy"))
        .filter(F.col("__ix").between(0, source.nx - 1) & F.col("__iy").between(0, source.ny - 1))
    )
    keys = key_columns(cube, extra_dims, drop=("x", "y"))
    values = value_columns(cube, extra_dims)
    indexed = cube.select(*keys, *values, source.ix(F.col("x")).alias("__ix"), source.iy(F.col("y")).alias("__iy"))
    return indexed.join(cell_map, ["__iy", "__ix"]).select(
        *keys, F.col("ty").alias("y"), F.col("tx").alias("x"), *values
    )
