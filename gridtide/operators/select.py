"""Selection by time, box, band, period, place and feature property."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.errors import GridError, NotFoundError
from gridtide.functions.periods import PERIOD_STEPS, WEEK_TEXT
from gridtide.schema import key_columns, value_columns
from gridtide.sources.grid import GridSpec

# Precision of a partial date text by its length.
PARTIAL_FORMATS = {
    4: ("%Y", "year"),
    7: ("%Y-%m", "month"),
    10: ("%Y-%m-%d", "day"),
    13: ("%Y-%m-%dT%H", "hour"),
    16: ("%Y-%m-%dT%H:%M", "minute"),
    19: ("%Y-%m-%dT%H:%M:%S", "second"),
}


def parse_partial(text: str) -> tuple[dt.datetime, dt.datetime]:
    """First instant of a partial date text and the first instant after it."""
    plain = re.sub(r"(Z|\+00:00)$", "", text.strip()).replace(" ", "T")
    plain = re.sub(r"(?<=:\d\d)\.\d+$", "", plain)
    if len(plain) not in PARTIAL_FORMATS:
        raise GridError(f"Cannot read date '{text}'")
    pattern, unit = PARTIAL_FORMATS[len(plain)]
    try:
        first = dt.datetime.strptime(plain, pattern)
    except ValueError as exc:
        raise GridError(f"Cannot read date '{text}'") from exc
    if unit == "year":
        after = first.replace(year=first.year + 1)
    elif unit == "month":
        after = first.replace(year=first.year + first.month // 12, month=first.month % 12 + 1)
    else:
        after = first + dt.timedelta(**{unit + "s": 1})
    return first, after


def naive(moment: dt.datetime) -> Column:
    """A naive time literal, so that a comparison with ``t`` needs no cast and is pushed to the scan."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def time_bounds(start: str, end: str) -> tuple[Column, Column]:
    """Inclusive partial-date bounds as a half-open range."""
    return naive(parse_partial(start)[0]), naive(parse_partial(end)[1])


def slice_time(cube: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Keep times from ``start`` to ``end``, both included; a partial end covers its whole unit.

    Either end may be open. A cube without a time column passes unfiltered.
    """
    if "t" not in cube.columns:
        return cube
    if start is not None:
        cube = cube.filter(F.col("t") >= naive(parse_partial(start)[0]))
    if end is not None:
        cube = cube.filter(F.col("t") < naive(parse_partial(end)[1]))
    return cube


def filter_temporal(cube: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Keep the half-open interval from ``start`` up to but not including ``end``."""
    if start is not None:
        cube = cube.filter(F.col("t") >= naive(parse_partial(start)[0]))
    if end is not None:
        cube = cube.filter(F.col("t") < naive(parse_partial(end)[0]))
    return cube


def between(cube: DataFrame, axis: str, low: float, high: float) -> Column:
    """Inclusive range of an axis. An integer axis gets integer ends, so that no cast hides it from the scan."""
    if isinstance(cube.schema[axis].dataType, T.IntegralType):
        return F.col(axis).between(math.ceil(low), math.floor(high))
    return F.col(axis).between(float(low), float(high))


def filter_bbox(
    cube: DataFrame,
    extent: Mapping[str, float | None] | None = None,
    *,
    west: float | None = None,
    south: float | None = None,
    east: float | None = None,
    north: float | None = None,
) -> DataFrame:
    """Keep cell centres inside the box, edges included. An axis is cut only if both of its sides are given."""
    sides = {"west": west, "south": south, "east": east, "north": north}
    for key, value in (extent or {}).items():
        if key.lower() in sides and value is not None:
            sides[key.lower()] = float(value)
    if sides["west"] is not None and sides["east"] is not None:
        cube = cube.filter(between(cube, "x", sides["west"], sides["east"]))
    if sides["south"] is not None and sides["north"] is not None:
        cube = cube.filter(between(cube, "y", sides["south"], sides["north"]))
    return cube


def clip_to_extent(cube: DataFrame, bbox: Sequence[float], dx: float, dy: float) -> DataFrame:
    """Keep cells whose area touches the box."""
    xmin, ymin, xmax, ymax = map(float, bbox)
    half_x, half_y = abs(dx) / 2, abs(dy) / 2
    # the half cell is moved to the literal side, so the comparison stays on the raw column
    return cube.filter(
        between(cube, "x", xmin - half_x, xmax + half_x) & between(cube, "y", ymin - half_y, ymax + half_y)
    )


def filter_bands(cube: DataFrame, bands: Sequence[str] | None, extra_dims: Sequence[str] = ()) -> DataFrame:
    """Keep the named variables that exist; none of them existing is an error, an empty list keeps all."""
    if not bands:
        return cube
    available = value_columns(cube, extra_dims)
    kept = [name for name in bands if name in available]
    if not kept:
        raise NotFoundError(f"None of the requested bands {list(bands)!r} exist. Available: {available}")
    return cube.select(*key_columns(cube, extra_dims), *kept)


def stack_bands(cube: DataFrame, extra_dims: Sequence[str] = ()) -> DataFrame:
    """Several variables become rows with a ``band`` label; a single one is left as it is."""
    bands = value_columns(cube, extra_dims)
    if len(bands) <= 1:
        return cube
    return cube.unpivot(key_columns(cube, extra_dims), bands, "band", "value")


def first_steps(cube: DataFrame, n: int) -> DataFrame:
    """The first ``n`` time steps."""
    steps = cube.select("t").distinct().orderBy("t").limit(n)
    return cube.filter(F.col("t") <= steps.agg(F.max("t")).scalar())


def snapshot(cube: DataFrame, n: int = 0) -> DataFrame:
    """The time step at position ``n``; nothing if the cube has fewer steps."""
    steps = cube.select("t").distinct().orderBy("t").limit(n + 1)
    at = steps.agg(F.when(F.count("t") == n + 1, F.max("t")))
    return cube.filter(F.col("t") == at.scalar())


def period_span(period: str, period_type: str) -> tuple[dt.datetime, dt.datetime]:
    """First instant of a period given as text, and the first instant after it."""
    if period_type not in PERIOD_STEPS:
        raise GridError(f"Unsupported period_type '{period_type}'")
    week = re.fullmatch(WEEK_TEXT, period)
    try:
        first = dt.datetime.fromisocalendar(int(week[1]), int(week[2]), 1) if week else parse_partial(period)[0]
    except ValueError as exc:
        raise GridError(f"Invalid {period_type} period '{period}'") from exc
    if period_type == "weekly":
        first = first.replace(hour=0, minute=0, second=0) - dt.timedelta(days=first.weekday())
        return first, first + dt.timedelta(days=7)
    length = {"hourly": 13, "daily": 10, "monthly": 7, "yearly": 4}[period_type]
    return parse_partial(first.isoformat()[:length])


def select_period(cube: DataFrame, period: str, period_type: str) -> DataFrame:
    """Exactly one period, as a range over the raw time column with literal ends."""
    low, high = period_span(period, period_type)
    return cube.filter((F.col("t") >= naive(low)) & (F.col("t") < naive(high)))


def nearest_point(
    cube: DataFrame, x: float | None = None, y: float | None = None, grid: GridSpec | None = None
) -> DataFrame:
    """Time series of the cell nearest to a place, per axis; the smaller coordinate wins a tie.

    A coordinate left out is the centre of the grid, which is the mean of the axis values. With
    ``grid`` the cell is computed; without it the axes are looked up in the cube.
    """
    if grid is not None:
        px, py = (given if given is not None else middle for given, middle in zip((x, y), grid.centre))
        here = (grid.ix(F.col("x")) == grid.nearest_ix(F.lit(px))) & (grid.iy(F.col("y")) == grid.nearest_iy(F.lit(py)))
        return cube.filter(here)

    def target(axis: str, given: float | None) -> Column:
        if given is not None:
            return F.lit(float(given))
        return cube.select(axis).distinct().agg(F.avg(axis)).scalar()

    def nearest(axis: str, place: Column) -> Column:
        return F.min(F.struct(F.abs(F.col(axis) - place), F.col(axis).alias("at")))["at"].alias(axis)

    hit = cube.select("x", "y", target("x", x).alias("px"), target("y", y).alias("py")).agg(
        F.struct(nearest("x", F.col("px")), nearest("y", F.col("py"))).alias("hit")
    )
    cell = hit.scalar()
    return cube.filter((F.col("x") == cell["x"]) & (F.col("y") == cell["y"]))


def axis_intervals(axis: DataFrame, name: str) -> DataFrame:
    """Each value of one axis with the half-open stretch ``(low, high]`` nearer to it than to its neighbours.

    ``axis`` holds the distinct values of one grid axis, so it is as long as the grid is wide
    and never as long as the cube.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("at")
    values = axis.select(F.col(name).cast("double").alias("at")).distinct()
    before, after = F.lag("at").over(order), F.lead("at").over(order)
    return values.select(
        "at",
        F.coalesce((before + F.col("at")) / 2, F.lit(float("-inf"))).alias("low"),
        F.coalesce((after + F.col("at")) / 2, F.lit(float("inf"))).alias("high"),
    )


def nearest_on_axis(places: DataFrame, place: str, axis: DataFrame, name: str, out: str) -> DataFrame:
    """Add the nearest axis value of every place as ``out``.

    Both sides get the number of the stretch of equal width they fall into, so the join is an
    equi-join; the width is the mean gap of the axis. Places beyond the axis belong to its ends.
    """
    stretches = axis_intervals(axis, name)
    span = stretches.agg(
        F.struct(
            F.min("at").alias("first"),
            F.max("at").alias("last"),
            F.when(F.count("at") > 1, (F.max("at") - F.min("at")) / (F.count("at") - 1)).otherwise(1.0).alias("gap"),
        )
    ).scalar()

    def slot(value: Column) -> Column:
        inside = F.least(F.greatest(value, F.col("__span.first")), F.col("__span.last"))
        return F.floor((inside - F.col("__span.first")) / F.col("__span.gap")).cast("bigint")

    slotted = (
        stretches.withColumn("__span", span)
        .withColumn("__slot", F.explode(F.sequence(slot(F.col("low")), slot(F.col("high")))))
        .select("__slot", "low", "high", F.col("at").alias(out))
    )
    located = places.withColumn("__span", span).withColumn("__slot", slot(F.col(place).cast("double")))
    inside = (F.col(place) > F.col("low")) & (F.col(place) <= F.col("high"))
    # the condition sits in the join, so rows of the same slot that do not hold the place are not emitted
    joined = located.alias("p").join(
        slotted.alias("s"), (F.col("p.__slot") == F.col("s.__slot")) & inside, "inner"
    )
    return joined.select("p.*", out).drop("__span", "__slot")


def nearest_points(
    cube: DataFrame,
    points: DataFrame,
    point_id: str = "point_id",
    cells: DataFrame | None = None,
    grid: GridSpec | None = None,
) -> DataFrame:
    """Time series for many places at once. ``points`` has the id and columns ``px``, ``py``.

    With ``grid`` cells are computed, so the cube is read once. Without it, ``cells`` may name a cheaper
    table with the same axis values than the cube.
    """
    if grid is not None:
        hits = points.select(
            point_id, grid.nearest_iy(F.col("py")).alias("__iy"), grid.nearest_ix(F.col("px")).alias("__ix")
        )
        numbered = cube.withColumns({"__iy": grid.iy(F.col("y")), "__ix": grid.ix(F.col("x"))})
        return numbered.join(hits, ["__iy", "__ix"]).drop("__iy", "__ix")
    cells = cube if cells is None else cells
    located = nearest_on_axis(points, "px", cells.select("x"), "x", "x")
    located = nearest_on_axis(located, "py", cells.select("y"), "y", "y")
    hits = located.select(point_id, "x", "y")
    return cube.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")}).join(hits, ["x", "y"])


def covers_extent(templates: DataFrame, requests: DataFrame) -> DataFrame:
    """Check each request against the declared box of the dataset it names.

    Only boxes that do not meet at all are refused, touching counts as meeting, and latitude is
    judged first. A dataset without a usable box accepts everything.
    ``templates``: dataset_id, bbox array<double>; ``requests``: request_id, dataset_id, xmin..ymax.
    """
    boxes = templates.select("dataset_id", F.when(F.size("bbox") == 4, F.col("bbox")).alias("box"))
    box = F.col("box")
    apart_in_y = (F.col("ymin") > box[3]) | (F.col("ymax") < box[1])
    apart_in_x = (F.col("xmin") > box[2]) | (F.col("xmax") < box[0])
    rejected = F.when(apart_in_y, "latitude").when(apart_in_x, "longitude")
    return requests.join(boxes, "dataset_id").select(
        *requests.columns, rejected.isNull().alias("covered"), rejected.alias("rejected_on")
    )


def filter_features(features: DataFrame, predicate: str | Column) -> DataFrame:
    """Features whose properties meet a condition: a Column, or the text of one in Spark SQL."""
    return features.filter(predicate)
