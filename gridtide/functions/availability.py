"""How far a source can be synced, by release policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtide.functions.periods import period_id

# Names of the policies a template may declare.
COMPLETE_MONTH = "complete_month"
LAGGED = "lagged"
RELEASE = "release"

# Fixed value: day of the month after which the previous month counts as complete.
COMPLETE_AFTER_DAY = 20


def latest_complete_month(now: Column, threshold: int | Column = COMPLETE_AFTER_DAY) -> Column:
    """Last day of the newest month that is fully released, as daily period text."""
    threshold = F.lit(threshold) if isinstance(threshold, int) else F.coalesce(threshold, F.lit(COMPLETE_AFTER_DAY))
    months_back = F.when(F.dayofmonth(now) > threshold, 1).otherwise(2)
    return F.date_format(F.last_day(F.add_months(F.to_date(now), -months_back)), "yyyy-MM-dd")


def lagged_available(
    now: Column,
    period_type: Column,
    requested_end: Column,
    lag_hours: Column,
    lag_days: Column,
    latest_year_offset: Column,
) -> Column:
    """Newest period after the declared lag; the requested end where no lag applies."""
    hour = period_id(now - F.make_dt_interval(F.lit(0), lag_hours), "hourly")
    day = F.date_sub(F.to_date(now), lag_days)
    year = (F.year(now) - latest_year_offset).cast("string")
    return (
        F.when((period_type == "hourly") & (lag_hours > 0), hour)
        .when((period_type == "daily") & (lag_days > 0), F.date_format(day, "yyyy-MM-dd"))
        .when((period_type == "monthly") & (lag_days > 0), F.date_format(day, "yyyy-MM"))
        .when((period_type == "yearly") & (latest_year_offset >= 0), year)
        .otherwise(requested_end)
    )


def release_available(
    allow_future: Column,
    latest_year: Column,
    requested_end: Column,
    lagged: Column,
) -> Column:
    """Newest release: any requested one if projections are allowed, else the declared year, else the lag rule."""
    return (
        F.when(F.coalesce(allow_future, F.lit(False)), requested_end)
        .when(latest_year.isNotNull(), latest_year.cast("string"))
        .otherwise(lagged)
    )
