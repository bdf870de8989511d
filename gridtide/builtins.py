"""Registers the built-in transforms and processes under their names."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from gridtide.functions.reducers import CALLBACKS
from gridtide.operators import combine, elementwise, reduce, resample, select, zones
from gridtide.operators.regrid import reproject, resample_cube_spatial
from gridtide.registry import register_process, register_transform
from gridtide.sources.sinks import save_result


def _on_variable(fn):
    def transform(cube: DataFrame, template: Mapping[str, Any], **params: Any) -> DataFrame:
        return fn(cube, template["variable"], **params)

    return transform


def _reproject(cube: DataFrame, template: Mapping[str, Any], **params: Any) -> DataFrame:
    return reproject(cube, **params)


def _max_time(data: DataFrame) -> DataFrame:
    return reduce.reduce_dimension(data, "t", "max")


def install() -> None:
    """Register everything; calling it again changes nothing."""
    for fn in (
        elementwise.kelvin_to_celsius,
        elementwise.metres_to_mm,
        elementwise.linear_convert,
        elementwise.clamp_min,
    ):
        register_transform(fn.__name__, _on_variable(fn))
    register_transform("reproject", _reproject)

    processes = {
        "filter_temporal": select.filter_temporal,
        "filter_bbox": select.filter_bbox,
        "filter_bands": select.filter_bands,
        "apply": elementwise.apply,
        "rename_labels": elementwise.rename_labels,
        "reduce_dimension": reduce.reduce_dimension,
        "aggregate_temporal_period": resample.aggregate_temporal_period,
        "aggregate_spatial": zones.aggregate_spatial,
        "resample_cube_spatial": resample_cube_spatial,
        "merge_cubes": combine.merge_cubes,
        "resample": resample.resample,
        "max_time": _max_time,
        "save_result": save_result,
    }
    for name, fn in processes.items():
        register_process(name, fn, builtin=True)
    for name, make in CALLBACKS.items():
        register_process(name, lambda data, y, _make=make: elementwise.apply(data, _make(y)), builtin=True)
