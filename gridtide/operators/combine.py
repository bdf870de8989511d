"""Putting cubes together: merging, appending, filling gaps, finding them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.errors import GridError
from gridtide.functions.periods import PERIOD_STEPS, period_id, periods_between, truncate_to_period
from gridtide.schema import key_columns, value_columns
from gridtide.sources.grid import GridSpec, numbered_cells


def merge_cubes(
    left: DataFrame,
    right: DataFrame,
    overlap: Callable[[Column, Column], Column] | None = None,
    extra_dims: Sequence[str] = (),
    grid: GridSpec | None = None,
) -> DataFrame:
    """Combine two aligned cubes.

    Variables of only one cube are kept beside each other. A variable of both needs ``overlap``,
    which decides where both have a value; elsewhere the one value there is is taken. Cells are matched by their
    numbers on ``grid``, see ``numbered_cells``; where both cubes have a cell, its coordinates are those of the left one.
    """
    keys = key_columns(left, extra_dims)
    if set(keys) != set(key_columns(right, extra_dims)):
        raise GridError(f"Cubes differ in their dimensions: {keys} and {key_columns(right, extra_dims)}")
    left_values, right_values = value_columns(left, extra_dims), value_columns(right, extra_dims)
    shared = [name for name in left_values if name in right_values]
    if shared and overlap is None:
        raise GridError(f"Both cubes have {shared}; an overlap function is needed")
    spots = [k for k in ("y", "x") if k in keys]
    others = [k for k in keys if k not in spots]
    if len(spots) == 2:
        left, right = numbered_cells(left, right, grid)
        joined = left.alias("a").join(right.alias("b"), [*others, "__iy", "__ix"], "full_outer")
    else:
        others = keys
        joined = left.alias("a").join(right.alias("b"), keys, "full_outer")
    columns = []
    for name in [*left_values, *[v for v in right_values if v not in shared]]:
        if name in shared:
            a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
            both = a.isNotNull() & b.isNotNull()
            columns.append(F.when(both, overlap(a, b)).otherwise(F.coalesce(a, b)).alias(name))
        else:
            columns.append(F.col(f"{'a' if name in left_values else 'b'}.{name}").alias(name))
    here = [F.col(k) if k in others else F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
    return joined.select(*here, *columns)


def append_periods(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new periods behind it."""
    return store.unionByName(new)


def pending_periods(wanted: DataFrame, committed: DataFrame) -> DataFrame:
    """Wanted periods that are not stored, in order; gaps before the newest stored one are included."""
    return wanted.join(committed.select("period_id"), "period_id", "left_anti").orderBy("period_id")


def covered_periods(cube: DataFrame, period_type: str, by: Sequence[str] = ()) -> DataFrame:
    """Every period from the first to the last time of a cube, per ``by`` group."""
    bounds = cube.groupBy(*by).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    spanned = bounds.filter(F.col("first").isNotNull())
    return spanned.select(*by, F.explode(periods_between("first", "last", period_type)).alias("t"))


def find_gaps(cube: DataFrame, period_type: str, by: Sequence[str] = ()) -> DataFrame:
    """Periods missing inside the covered range. They are reported, not refused."""
    present = cube.select(*by, truncate_to_period("t", period_type).alias("t")).distinct()
    missing = covered_periods(cube, period_type, by).join(present, [*by, "t"], "left_anti")
    return missing.select(*by, "t", period_id("t", period_type).alias("period_id"))


def densify(
    cube: DataFrame,
    period_type: str,
    cells: DataFrame | None = None,
    start: Column | None = None,
    end: Column | None = None,
    extra_dims: Sequence[str] = (),
    grid: GridSpec | None = None,
) -> DataFrame:
    """Give every cell a row in every period; what was not there becomes NULL.

    Each cell generates its own periods, so nothing is paired up across tasks. Times are taken to
    be period starts. Cells are matched by their numbers on ``grid``, see ``numbered_cells``.
    """
    if period_type not in PERIOD_STEPS:
        raise GridError(f"Unsupported period_type '{period_type}'")
    spots = key_columns(cube, extra_dims, drop=("t",))
    others = [k for k in spots if k not in ("x", "y")]
    if cells is None:
        numbered, _ = numbered_cells(cube, cube, grid)
        one = numbered.groupBy(*others, "__iy", "__ix").agg(F.min("y").alias("y"), F.min("x").alias("x"))
        cells = one.select(*spots)
    if start is None or end is None:
        span = cube.agg(F.struct(F.min("t").alias("a"), F.max("t").alias("b"))).scalar()
        start = span["a"] if start is None else start
        end = span["b"] if end is None else end
    values, spots_of = numbered_cells(cube, cells.select(*spots), grid)
    spine = spots_of.select(*spots, "__iy", "__ix", F.explode(periods_between(start, end, period_type)).alias("t"))
    joined = spine.join(values.drop("x", "y"), [*others, "t", "__iy", "__ix"], "left")
    return joined.select(*key_columns(cube, extra_dims), *value_columns(cube, extra_dims))
