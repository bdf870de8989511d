import datetime as dt

import pytest

from gridtide.errors import GridError, NoDataError
from gridtide.functions.periods import period_id
from gridtide.operators.reduce import coverage
from gridtide.operators.resample import aggregate_temporal_period, require_data, resample


def pairs(df, kind):
    rows = df.select(period_id("t", kind).alias("p"), "value").orderBy("p").collect()
    return [(r["p"], r["value"]) for r in rows]


def test_hours_to_daily_means(cube_of):
    cube = cube_of("2026-01-01T00:00", 1, range(48))
    out = resample(cube, "1D", "mean", "2026-01-01", "2026-01-02", "hourly")
    assert pairs(out, "daily") == [("2026-01-01", 11.5), ("2026-01-02", 35.5)]
    row = coverage(out, "daily").first()
    assert (row["has_data"], row["start"], row["end"]) == (True, "2026-01-01", "2026-01-02")


def test_ten_days(cube_of):
    out = resample(cube_of("2026-01-01", 24, [1] * 10), "10D", "sum", "2026-01-01", "2026-01-01", "daily")
    assert pairs(out, "daily") == [("2026-01-01", 10.0)]


@pytest.mark.parametrize(
    "first, days, end, expected",
    [
        ("2026-01-05", 10, "2026-01-12", [("2026-W02", 7.0)]),
        ("2026-01-07", 12, "2026-01-18", [("2026-W03", 7.0)]),
        ("2026-01-05T06:00", 7, "2026-01-11", [("2026-W02", 7.0)]),
    ],
)
def test_only_complete_weeks(cube_of, first, days, end, expected):
    out = resample(cube_of(first, 24, [1] * days), "W-MON", "sum", first[:10], end, "daily")
    assert pairs(out, "weekly") == expected


def test_month(cube_of):
    out = resample(cube_of("2026-01-01", 24, [1] * 31), "MS", "sum", "2026-01-01", "2026-01-31", "daily")
    assert pairs(out, "monthly") == [("2026-01", 31.0)]


def test_nothing_in_range(cube_of):
    out = resample(cube_of("2026-01-01", 24, [1] * 7), "MS", "sum", "2026-03-02", "2026-03-31", "daily")
    with pytest.raises(NoDataError):
        require_data(out)


def test_one_incomplete_bin_leaves_nothing(cube_of):
    out = resample(cube_of("2026-01-07", 24, [1] * 3), "W-MON", "sum", "2026-01-01", "2026-01-31", "daily")
    assert out.isEmpty()


def test_gap_inside_is_kept_and_missing_gives_no_row(cube_of):
    cube = cube_of("2026-01-05", 24, [1] * 7 + [None] * 7 + [1, None, 1, 1, 1, 1, 1])
    out = resample(cube, "W-MON", "sum", "2026-01-05", "2026-01-25", "daily")
    assert pairs(out, "weekly") == [("2026-W02", 7.0), ("2026-W04", 6.0)]


@pytest.mark.parametrize("source, frequency, expected", [("monthly", "YS", ["2026"]), ("monthly", "QS", ["2026-01", "2026-04", "2026-07", "2026-10"])])
def test_coarse_sources(spark, source, frequency, expected):
    rows = [(dt.datetime(2026, m, 1), 0.0, 0.0, 1.0) for m in range(1, 13)] + [(dt.datetime(2027, 1, 1), 0.0, 0.0, 1.0)]
    cube = spark.createDataFrame(rows, "t timestamp_ntz, y double, x double, value double")
    out = resample(cube, frequency, "sum", "2026-01-01", "2027-12-31", source)
    kind = "yearly" if frequency == "YS" else "monthly"
    assert [p for p, _ in pairs(out, kind)] == expected


def test_method_and_type_are_checked(cube_of):
    cube = cube_of("2026-01-01", 24, [1])
    with pytest.raises(GridError, match="Unsupported method"):
        resample(cube, "MS", "median", "2026-01-01", "2026-01-31", "daily")
    with pytest.raises(GridError, match="Unsupported period_type"):
        resample(cube, "MS", "sum", "2026-01-01", "2026-01-31", "fortnightly")


def test_seasons(cube_of):
    cube = cube_of("2025-11-30", 24, [1] * 3)
    out = aggregate_temporal_period(cube, "season", "sum")
    assert pairs(out, "monthly") == [("2025-09", 1.0), ("2025-12", 2.0)]


def test_one_shuffle_and_pushed_bounds(spark, cube_of):
    from gridtide.session import scratch_path

    path = scratch_path(spark, "plan")
    cube_of("2026-01-01", 24, [1] * 40).write.parquet(path)
    out = resample(spark.read.parquet(path), "MS", "sum", "2026-01-01", "2026-02-28", "daily")
    plan = out._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert main.count("Exchange hashpartitioning") == 1
    assert "GreaterThanOrEqual(t,2026-01-01" in plan
