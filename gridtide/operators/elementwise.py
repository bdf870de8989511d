"""Work on single values: unit conversion, declared transforms, callbacks, labels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.errors import GridError
from gridtide.registry import transform_by_name
from gridtide.schema import value_columns

# Offset of degree Celsius from Kelvin, millimetres per metre.
KELVIN_OFFSET = -273.15
MM_PER_METRE = 1000.0


def linear_convert(cube: DataFrame, var: str, scale: float, offset: float, units: str) -> DataFrame:
    """``v * scale + offset``; the units are replaced, other column metadata is kept."""
    metadata = {**cube.schema[var].metadata, "units": units}
    value = F.col(var) if scale == 1.0 else F.col(var) * F.lit(float(scale))
    value = value if offset == 0.0 else value + F.lit(float(offset))
    return cube.withColumn(var, value.cast("double")).withMetadata(var, metadata)


def kelvin_to_celsius(cube: DataFrame, var: str) -> DataFrame:
    return linear_convert(cube, var, 1.0, KELVIN_OFFSET, "degC")


def metres_to_mm(cube: DataFrame, var: str) -> DataFrame:
    return linear_convert(cube, var, MM_PER_METRE, 0.0, "mm")


def clamp_min(cube: DataFrame, var: str, lo: float) -> DataFrame:
    """Raise values below ``lo`` to it; missing values stay missing."""
    metadata = cube.schema[var].metadata
    clamped = F.when(F.col(var).isNotNull(), F.greatest(F.col(var), F.lit(float(lo))))
    return cube.withColumn(var, clamped).withMetadata(var, metadata)


def run_transforms(cube: DataFrame, template: Mapping[str, Any]) -> DataFrame:
    """Apply the transforms a template declares, in order.

    An entry is a name, or a mapping with ``function`` and optional ``params``.
    """
    owner = template.get("id", "?")
    for entry in template.get("transforms") or []:
        if isinstance(entry, str):
            name, params = entry, {}
        elif isinstance(entry, Mapping):
            if "function" not in entry:
                raise GridError(f"Transform entry of dataset '{owner}' has no 'function': {entry!r}")
            name, params = entry["function"], dict(entry.get("params") or {})
        else:
            raise GridError(
                f"Transform entry of dataset '{owner}' must be a name or a mapping, got {type(entry).__name__}"
            )
        cube = transform_by_name(name)(cube, template, **params)
    return cube


def apply(cube: DataFrame, fn: Callable[[Column], Column], columns: Sequence[str] | None = None) -> DataFrame:
    """Apply a callback to every value of the cube."""
    columns = list(columns) if columns is not None else value_columns(cube)
    out = cube.withColumns({name: fn(F.col(name)) for name in columns})
    for name in columns:
        out = out.withMetadata(name, cube.schema[name].metadata)
    return out


def rename_labels(
    cube: DataFrame, dimension: str, target: Sequence[str], source: Sequence[str] | None = None
) -> DataFrame:
    """Replace the labels of a dimension by ``target``, position by position.

    ``source`` names the present labels in order; without it they are taken in ascending order.
    The map is as long as the list handed in, so it travels inside the plan. A label without a
    target, and a target without a label, fail the query.
    """
    if source is not None:
        if len(source) != len(target):
            raise GridError(f"{len(source)} labels cannot be replaced by {len(target)}")
        pairs = [part for old, new in zip(source, target) for part in (F.lit(old), F.lit(new))]
        renamed = F.create_map(*pairs)[F.col(dimension)]
        unknown = F.raise_error(F.concat(F.lit(f"No new label for {dimension} "), F.col(dimension).cast("string")))
        kept = F.when(F.col(dimension).isNotNull(), F.coalesce(renamed, unknown))
        return cube.withColumn(dimension, kept)
    ordered = cube.agg(F.array_sort(F.collect_set(dimension)).alias("labels")).scalar()
    new_labels = F.array(*[F.lit(label) for label in target])
    position = F.array_position(ordered, F.col(dimension)).cast("int")
    differ = F.raise_error(
        F.concat(F.size(ordered).cast("string"), F.lit(f" labels of {dimension} cannot be replaced by {len(target)}"))
    )
    fits = F.size(ordered) == len(target)
    return cube.withColumn(dimension, F.when(fits, F.try_element_at(new_labels, position)).otherwise(differ))
