import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridtide.errors import GridError
from gridtide.functions import periods as p
from gridtide.functions.availability import lagged_available, latest_complete_month, release_available
from gridtide.functions.frequency import parse_frequency


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, kind, expected",
    [
        ("2026-04-21T13:30:00+02:00", "hourly", "2026-04-21T11"),
        ("2026-04-21T00:30:00+02:00", "daily", "2026-04-20"),
        ("2026-04-21T13:30:00+00:00", "weekly", "2026-W17"),
        ("2026-04-21T13", "hourly", "2026-04-21T13"),
        ("2026-W54", "weekly", None),
        ("2021-W53", "weekly", None),
        ("2020-W53", "weekly", "2020-W53"),
        ("2024-13", "monthly", None),
        ("2024-05", "monthly", "2024-05"),
        ("2024", "yearly", "2024"),
        ("20x4", "yearly", None),
        ("2023-02-29", "daily", None),
        ("2024-02-29T25:00", "daily", None),
    ],
)
def test_normalise(spark, text, kind, expected):
    assert value(spark, p.normalize_period(F.lit(text), kind)) == expected
    assert value(spark, p.normalize_period(F.lit(text), F.lit(kind))) == expected
    assert (value(spark, p.period_rejection(F.lit(text), kind)) is None) == (expected is not None)


def test_unknown_period_type_is_an_error():
    with pytest.raises(GridError, match="Unsupported period_type"):
        p.period_id(F.lit("x"), "decadal")


@pytest.mark.parametrize(
    "text, kind, expected",
    [
        ("2020-W53", "weekly", "2021-W01"),
        ("2026-04-21T13", "hourly", "2026-04-21T14"),
        ("2024-02-28", "daily", "2024-02-29"),
        ("2024-12", "monthly", "2025-01"),
        ("1999", "yearly", "2000"),
    ],
)
def test_next_period(spark, text, kind, expected):
    assert value(spark, p.next_period(F.lit(text), kind)) == expected


def test_week_starts_on_monday(spark):
    assert value(spark, p.period_start(F.lit("2026-W01"))) == dt.datetime(2025, 12, 29)
    assert value(spark, p.period_start(F.lit("2026-04-21T13:30:00+02:00"))) == dt.datetime(2026, 4, 21, 11, 30)


def test_new_year_belongs_to_the_iso_year(spark):
    day = F.lit("2021-01-01 00:00:00").cast("timestamp_ntz")
    assert value(spark, p.period_id(day, "weekly")) == "2020-W53"


@pytest.mark.parametrize(
    "step, hours, steps",
    [("PT1H", 1.0, 168), ("P1D", 24.0, 30), ("P1W", 168.0, 52), ("P1M", 730.5, 12), ("P1Y", 8766.0, 1), ("P0D", None, 12), ("day", None, 12)],
)
def test_steps(spark, step, hours, steps):
    assert value(spark, p.iso_step_hours(F.lit(step))) == hours
    assert value(spark, p.steps_per_bucket(F.lit(step))) == steps


def test_periods_between_is_empty_backwards_and_clamped(spark):
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    assert value(spark, F.size(p.periods_between(at("2026-01-05"), at("2026-01-01"), "daily"))) == 0
    assert value(spark, F.size(p.periods_between(at("2026-01-01"), at("2026-01-31"), "daily"))) == 31
    clamped = p.periods_between(at("2026-01-01"), at("2026-01-31"), "daily", at("2026-01-10"))
    assert value(spark, F.size(clamped)) == 10


@pytest.mark.parametrize("today, expected", [("2026-04-21", "2026-03-31"), ("2026-04-20", "2026-02-28"), ("2026-01-05", "2025-11-30")])
def test_latest_complete_month(spark, today, expected):
    assert value(spark, latest_complete_month(F.lit(f"{today} 12:34:00").cast("timestamp_ntz"))) == expected


def test_lag(spark):
    now = F.lit("2026-04-21 12:34:00").cast("timestamp_ntz")
    none = F.lit(None).cast("int")

    def lag(kind, hours=none, days=none, years=none):
        return value(spark, lagged_available(now, F.lit(kind), F.lit("asked"), hours, days, years))

    assert lag("hourly", hours=F.lit(5)) == "2026-04-21T07"
    assert lag("hourly", hours=F.lit(0)) == "asked"
    assert lag("daily", days=F.lit(3)) == "2026-04-18"
    assert lag("monthly", days=F.lit(30)) == "2026-03"
    assert lag("weekly", days=F.lit(3)) == "asked"
    assert lag("yearly", years=F.lit(0)) == "2026"


def test_release(spark):
    def release(future, year):
        return value(spark, release_available(F.lit(future), F.lit(year).cast("int"), F.lit("2030"), F.lit("2025")))

    assert release(True, 2020) == "2030"
    assert release(False, 2020) == "2020"
    assert release(None, None) == "2025"


def test_derived_id(spark):
    assert value(spark, p.derived_id(F.lit("rain"), F.lit("W-MON"), F.lit("sum"))) == "rain_w_mon_sum"


@pytest.mark.parametrize("alias", ["ME", "2ME", "W-XYZ", "0D", "", "B", "0min", "15T"])
def test_other_frequencies_are_refused_by_name(alias):
    with pytest.raises(GridError, match="Invalid frequency"):
        parse_frequency(alias)


@pytest.mark.parametrize(
    "alias, moment, expected",
    [
        ("W-MON", "2026-01-12", "2026-01-19"),
        ("W-MON", "2026-01-14", "2026-01-19"),
        ("MS", "2026-01-01", "2026-02-01"),
        ("MS", "2026-12-15", "2027-01-01"),
        ("QS", "2026-02-01", "2026-04-01"),
        ("YS", "2026-01-01", "2027-01-01"),
        ("10D", "2026-01-01", "2026-01-11"),
        ("6h", "2026-01-01", "2026-01-01T06:00"),
        ("2W-MON", "2026-01-14", "2026-01-26"),
        ("3MS", "2026-01-15", "2026-04-01"),
        ("2QS", "2026-02-01", "2026-07-01"),
        ("30min", "2026-01-01", "2026-01-01T00:30"),
    ],
)
def test_offset_after_a_date(alias, moment, expected):
    assert parse_frequency(alias).roll_forward(dt.datetime.fromisoformat(moment)) == dt.datetime.fromisoformat(expected)


@pytest.mark.parametrize(
    "alias, moment, expected",
    [
        ("30min", "2026-01-05T10:44", "2026-01-05T10:30"),
        ("45min", "2026-01-05T10:44", "2026-01-05T10:30"),
        ("2W-MON", "2026-01-14T00:00", "2026-01-05T00:00"),
        ("2W-MON", "2026-01-20T00:00", "2026-01-19T00:00"),
        ("3MS", "2026-05-31T00:00", "2026-04-01T00:00"),
        ("2QS", "2026-06-30T00:00", "2026-01-01T00:00"),
        ("2YS", "2027-06-30T00:00", "2026-01-01T00:00"),
    ],
)
def test_bins_of_several_units_count_from_the_data(spark, alias, moment, expected):
    from gridtide.functions.frequency import bin_start

    at, origin = (F.lit(dt.datetime.fromisoformat(m)).cast("timestamp_ntz") for m in (moment, "2026-01-05T08:00"))
    assert value(spark, bin_start(at, alias, origin)) == dt.datetime.fromisoformat(expected)
