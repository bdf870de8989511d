"""Period totals per zone: the usual way from a daily cube to a table per district."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridtide.operators.resample import aggregate_temporal_period
from gridtide.operators.select import slice_time
from gridtide.operators.zones import aggregate_spatial, cells_in_zones, stored_assignment


def zonal_period_totals(
    cube: DataFrame,
    zones: DataFrame,
    cells: DataFrame,
    start: str | None = None,
    end: str | None = None,
    period: str = "month",
    temporal_reducer: str = "sum",
    spatial_reducer: str = "mean",
) -> DataFrame:
    """Reduce in time per cell, then over the cells of every zone.

    The time slice reaches the scan, the first aggregate shrinks the cube by the length of the
    period, and only then are the zones joined. The assignment of cells to zones is written down first,
    so that Spark knows its size and moves the cube only if the assignment is too large to be sent around.
    """
    periods = aggregate_temporal_period(slice_time(cube, start, end), period, temporal_reducer)
    return aggregate_spatial(periods, stored_assignment(cells_in_zones(cells, zones)), spatial_reducer)
