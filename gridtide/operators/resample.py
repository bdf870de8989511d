"""Aggregation in time: resampling with complete periods, and plain calendar groups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.errors import GridError, NoDataError
from gridtide.functions.frequency import Frequency, parse_frequency
from gridtide.functions.periods import by_period_type, truncate_to_period
from gridtide.functions.reducers import RESAMPLE_METHODS, Reducer, reducer
from gridtide.operators.select import naive, parse_partial
from gridtide.schema import folded_columns, key_columns

# Calendar groups of aggregate_temporal_period.
CALENDAR_PERIODS = ("day", "week", "month", "season", "year")


def _previous_period_start(boundary: Column, period_type: str) -> Column:
    """Start of the last source period that ends at ``boundary``."""

    def make(name: str) -> Column:
        if name == "hourly":
            return boundary - F.expr("INTERVAL 1 HOUR")
        if name == "daily":
            return boundary - F.expr("INTERVAL 1 DAY")
        if name == "weekly":
            return boundary - F.expr("INTERVAL 7 DAY")
        unit = "month" if name == "monthly" else "year"
        return F.date_trunc(unit, boundary).cast("timestamp_ntz") - F.expr(f"INTERVAL 1 {unit.upper()}")

    return by_period_type(period_type, make)


def complete_range(first: Column, last: Column, freq: Frequency, source_period_type: str) -> Column:
    """Half-open time range ``struct<low, high>`` of the bins that the source covers in full.

    ``first`` and ``last`` are the first and last source times. The first bin is left out if the
    source starts after its label, the last one if the source ends before the last source period
    it needs. Bins in between always count.
    """
    origin = F.to_date(first) if freq.needs_origin else None
    first_label = freq.label(freq.bin_key(first, origin))
    last_label = freq.label(freq.bin_key(last, origin))
    starts_late = truncate_to_period(first, source_period_type) > first_label
    needed = _previous_period_start(freq.next_label(last_label), source_period_type)
    ends_early = truncate_to_period(last, source_period_type) < needed
    low = F.when(starts_late, freq.next_label(first_label)).otherwise(first_label)
    high = F.when(ends_early, last_label).otherwise(freq.next_label(last_label))
    start = origin if freq.needs_origin else F.lit(None).cast("date")
    return F.struct(low.alias("low"), high.alias("high"), start.alias("origin"))


def drop_incomplete_edges(
    result: DataFrame, times: DataFrame, source_period_type: str, frequency: str | Frequency
) -> DataFrame:
    """Drop the incomplete first and last bin of an already resampled cube.

    ``times`` holds the source times ``t``; only their first and last are used.
    """
    freq = parse_frequency(frequency) if isinstance(frequency, str) else frequency
    edges = _edges(times, freq, source_period_type)
    return result.filter((F.col("t") >= edges["low"]) & (F.col("t") < edges["high"]))


def _edges(times: DataFrame, freq: Frequency, source_period_type: str) -> Column:
    """Range of complete bins as a scalar subquery over a one-row aggregate."""
    bounds = times.agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return bounds.select(complete_range(F.col("first"), F.col("last"), freq, source_period_type)).scalar()


def target_range(start: str, end: str, freq: Frequency) -> tuple[dt.datetime, dt.datetime]:
    """Requested source range: from ``start`` up to one whole offset after ``end``."""
    return parse_partial(start)[0], freq.roll_forward(parse_partial(end)[0])


def resample(
    cube: DataFrame,
    frequency: str,
    method: str,
    start: str,
    end: str,
    source_period_type: str,
    times: DataFrame | None = None,
    extra_dims: Sequence[str] = (),
) -> DataFrame:
    """Resample in time to left-closed, left-labelled bins that the source covers in full.

    The bounds of the source are a one-row aggregate over its times, used as a scalar subquery:
    it prunes rows of incomplete edge bins before they are aggregated, and it is the origin of
    multi-day bins. ``times`` may name a cheaper table with the same times ``t``, such as the
    table a cube was built from. A bin without any value of a cell gives no row for it.
    """
    freq = parse_frequency(frequency)
    if method not in RESAMPLE_METHODS:
        raise GridError(f"Unsupported method '{method}'. Supported: {', '.join(RESAMPLE_METHODS)}")
    low, high = target_range(start, end, freq)

    def in_range(df: DataFrame) -> DataFrame:
        return df.filter((F.col("t") >= naive(low)) & (F.col("t") < naive(high)))

    source_times = in_range((times if times is not None else cube).select("t"))
    edges = _edges(source_times, freq, source_period_type)

    keys, values = folded_columns(cube, extra_dims, drop=("t",))
    fold = reducer(method)
    complete = in_range(cube).filter((F.col("t") >= edges["low"]) & (F.col("t") < edges["high"]))
    binned = complete.select(
        freq.bin_key(F.col("t"), edges["origin"] if freq.needs_origin else None).alias("__bin"), *keys, *values
    )
    folded = binned.groupBy("__bin", *keys).agg(*[fold(F.col(name)).alias(name) for name in values])
    any_value = F.coalesce(*[F.col(name) for name in values]).isNotNull()
    label = freq.label(F.col("__bin")).alias("t")
    out_keys = [label if k == "t" else F.col(k) for k in key_columns(cube, extra_dims)]
    kept = folded.filter(any_value).select(*out_keys, *values)
    for name in values:
        kept = kept.withMetadata(name, cube.schema[name].metadata)
    return kept


def require_data(result: DataFrame, message: str = "No complete target period in the requested range") -> DataFrame:
    """The result itself, or an error if it has no row. Runs a job."""
    if result.isEmpty():
        raise NoDataError(message)
    return result


def calendar_start(t: Column, period: str) -> Column:
    """First day of the calendar group; seasons are the three months from December, March, June and September."""
    if period not in CALENDAR_PERIODS:
        raise GridError(f"Unsupported period '{period}'. Supported: {', '.join(CALENDAR_PERIODS)}")
    day = F.to_date(t)
    if period == "day":
        return day
    if period == "season":
        # a month later, seasons are the calendar quarters
        return F.add_months(F.trunc(F.add_months(day, 1), "quarter"), -1)
    return F.trunc(day, period)


def aggregate_temporal_period(
    cube: DataFrame, period: str, reducer_name: str | Reducer, extra_dims: Sequence[str] = ()
) -> DataFrame:
    """Reduce every calendar group per cell. Incomplete groups at the edges are kept."""
    fold = reducer(reducer_name)
    keys, values = folded_columns(cube, extra_dims, drop=("t",))
    grouped = cube.groupBy(calendar_start(F.col("t"), period).alias("__start"), *keys)
    folded = grouped.agg(*[fold(F.col(name)).alias(name) for name in values])
    start = F.col("__start").cast("timestamp_ntz").alias("t")
    kept = [F.col(v).alias(v, metadata=cube.schema[v].metadata) for v in values]
    return folded.select(*[start if k == "t" else F.col(k) for k in key_columns(cube, extra_dims)], *kept)
