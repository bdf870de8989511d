"""Column roles of a cube table: ``dataset_id, t, y, x``, further keys, and numeric values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridtide.errors import GridError

AXES = ("t", "y", "x")
HELPER_COLUMNS = ("dataset_id", "time_bucket", "period_id", "band", "zone_id")


def value_columns(cube: DataFrame, extra_dims: Iterable[str] = ()) -> list[str]:
    """Numeric columns that are neither axes nor helper columns."""
    keys = {*AXES, *HELPER_COLUMNS, *extra_dims}
    return [f.name for f in cube.schema.fields if f.name not in keys and isinstance(f.dataType, T.NumericType)]


def key_columns(cube: DataFrame, extra_dims: Iterable[str] = (), drop: Iterable[str] = ()) -> list[str]:
    """Columns that name one value of the cube: dataset, zone, axes, band and further dimensions."""
    known = ("dataset_id", "zone_id", *AXES, "band", *extra_dims)
    return [name for name in known if name in cube.columns and name not in set(drop)]


def folded_columns(
    cube: DataFrame, extra_dims: Iterable[str] = (), drop: Iterable[str] = ()
) -> tuple[list[str], list[str]]:
    """Keys and values of an aggregation. A column that is neither is refused, as folding it away would mix its groups."""
    keys, values = key_columns(cube, extra_dims, drop), value_columns(cube, extra_dims)
    allowed = {*keys, *values, *drop, *HELPER_COLUMNS}
    unknown = [name for name in cube.columns if name not in allowed]
    if unknown:
        raise GridError(f"Columns {unknown} are neither values nor known dimensions; name them as extra_dims or drop them")
    return keys, values
