"""Period texts: formatting, parsing, stepping and enumerating.

A period type is one of ``hourly daily weekly monthly yearly``. Every function takes
it either as a plain string, which gives one expression, or as a Column, which gives
a ``when`` chain so that a table can mix period types row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtide.errors import GridError

PERIOD_TYPES = ("hourly", "daily", "weekly", "monthly", "yearly")

# Text formats of the period types (weekly is built from ISO year and week).
PERIOD_FORMATS = {"hourly": "yyyy-MM-dd'T'HH", "daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}

# Step of one period, as interval text for sequence().
PERIOD_STEPS = {
    "hourly": "INTERVAL 1 HOUR",
    "daily": "INTERVAL 1 DAY",
    "weekly": "INTERVAL 7 DAY",
    "monthly": "INTERVAL 1 MONTH",
    "yearly": "INTERVAL 1 YEAR",
}

# Accepted inputs named in the rejection reason.
PERIOD_INPUTS = {
    "hourly": "YYYY-MM-DDTHH or ISO datetime",
    "daily": "YYYY-MM-DD or ISO datetime",
    "weekly": "YYYY-Www or ISO datetime",
    "monthly": "YYYY-MM or ISO datetime",
    "yearly": "YYYY or ISO datetime",
}

# Hours per ISO 8601 duration unit, months and years as calendar averages.
ISO_UNIT_HOURS = {
    "years": 365.25 * 24,
    "months": 30.4375 * 24,
    "weeks": 7 * 24,
    "days": 24,
    "hours": 1,
    "minutes": 1 / 60,
    "seconds": 1 / 3600,
}

# Text patterns.
WEEK_TEXT = r"^(\d{4})-W(\d{2})$"
ISO_DURATION = r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
ISO_DATETIME = (
    r"^(\d{4}-\d{2}-\d{2})"
    r"(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:[.,]\d+)?)?)?"
    r"(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)


def _check_type(period_type: str) -> None:
    if period_type not in PERIOD_TYPES:
        raise GridError(f"Unsupported period_type '{period_type}'")


def by_period_type(period_type: str | Column, make: Callable[[str], Column]) -> Column:
    """``make(type)`` for a fixed type, or a chain over all types for a column of types."""
    if isinstance(period_type, str):
        _check_type(period_type)
        return make(period_type)
    chain: Column | None = None
    for name in PERIOD_TYPES:
        branch = make(name)
        chain = F.when(period_type == name, branch) if chain is None else chain.when(period_type == name, branch)
    return chain.otherwise(
        F.when(period_type.isNull(), F.lit(None)).otherwise(
            F.raise_error(F.concat(F.lit("Unsupported period_type '"), period_type, F.lit("'")))
        )
    )


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once.

    Expressions have no names, so one that uses its input many times would otherwise copy it into
    the plan each time. Meant for catalog-sized tables and literals, not for cube values.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def period_id(t: str | Column, period_type: str | Column) -> Column:
    """Text of the period that holds ``t``."""
    t = as_column(t)

    def make(name: str) -> Column:
        if name == "weekly":
            year = F.lpad(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), 4, "0")
            week = F.lpad(F.weekofyear(t).cast("string"), 2, "0")
            return F.concat(year, F.lit("-W"), week)
        return F.date_format(t, PERIOD_FORMATS[name])

    return by_period_type(period_type, make)


def truncate_to_period(t: str | Column, period_type: str | Column) -> Column:
    """First instant of the period that holds ``t``; weeks start on Monday."""
    t = as_column(t)
    units = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}
    return by_period_type(period_type, lambda name: F.date_trunc(units[name], t).cast("timestamp_ntz"))


def parse_iso_datetime(text: str | Column) -> Column:
    """ISO date or datetime text to a naive UTC time; anything else becomes NULL."""
    return let(as_column(text), lambda v: F.when(v.rlike(ISO_DATETIME), let(_iso_parts(v), _from_iso_parts)))


def _iso_parts(text: Column) -> Column:
    """Date, hour, minute, second and signed zone digits of a text that matches."""
    parts = [F.regexp_extract(text, ISO_DATETIME, index) for index in range(1, 5)]
    zone = F.rpad(F.regexp_replace(F.regexp_extract(text, ISO_DATETIME, 5), "[:Z]", ""), 5, "0")
    return F.array(*parts, zone)


def _from_iso_parts(parts: Column) -> Column:
    def number(digits: Column) -> Column:
        return F.concat(F.lit("0"), digits).cast("int")

    hour, minute, second, zone = number(parts[1]), number(parts[2]), number(parts[3]), parts[4]
    zone_minutes = number(F.substring(zone, 2, 2)) * 60 + number(F.substring(zone, 4, 2))
    zone_minutes = F.when(F.substring(zone, 1, 1) == "-", -zone_minutes).otherwise(zone_minutes)
    day = F.try_to_date(parts[0], "yyyy-MM-dd")
    shift = F.make_dt_interval(F.lit(0), hour, minute - zone_minutes, second.cast("decimal(18,6)"))
    return F.when((hour < 24) & (minute < 60) & (second < 60), day.cast("timestamp_ntz") + shift)


def iso_week_start(year: Column, week: Column) -> Column:
    """Monday of an ISO week as a date; NULL for a week the year does not have."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_add(F.trunc(fourth, "week"), (week - 1) * 7)
    exists = (week >= 1) & (F.extract(F.lit("YEAROFWEEK"), monday) == year)
    return F.when(exists, monday)


def _week_start_of_text(text: Column) -> Column:
    def number(index: int) -> Column:
        return F.nullif(F.regexp_extract(text, WEEK_TEXT, index), F.lit("")).cast("int")

    return F.when(text.rlike(WEEK_TEXT) & (number(1) >= 1), iso_week_start(number(1), number(2)).cast("timestamp_ntz"))


def period_start(text: str | Column) -> Column:
    """Naive UTC start of a period text of any type, weekly on Monday; NULL if malformed."""

    def read(v: Column) -> Column:
        padded = (
            F.when(v.contains("T"), v)
            .when(F.length(v) == 4, F.concat(v, F.lit("-01-01")))
            .when(F.length(v) == 7, F.concat(v, F.lit("-01")))
            .otherwise(v)
        )
        return F.when(v.rlike(WEEK_TEXT), _week_start_of_text(v)).otherwise(parse_iso_datetime(padded))

    return let(F.trim(as_column(text)), read)


def normalize_period(text: str | Column, period_type: str | Column) -> Column:
    """Native text of the period meant by ``text``; NULL if it cannot be read.

    Offsets are converted to UTC before the period is taken. A year of four
    characters only has to be an integer, and a month of seven only has to exist.
    """

    def native(v: Column, name: str) -> Column:
        """Text already in the native format, where that is not an ISO datetime."""
        if name == "weekly":
            return F.when(v.rlike(WEEK_TEXT), period_id(_week_start_of_text(v), name))
        if name == "monthly":
            exists = parse_iso_datetime(F.concat(v, F.lit("-01"))).isNotNull()
            return F.when((F.length(v) == 7) & exists, v)
        if name == "yearly":
            return F.when((F.length(v) == 4) & v.rlike(r"^\s*[+-]?\d+\s*$"), v)
        return F.lit(None).cast("string")

    def read(v: Column) -> Column:
        return let(
            parse_iso_datetime(v),
            lambda at: by_period_type(period_type, lambda name: F.coalesce(native(v, name), period_id(at, name))),
        )

    return let(as_column(text), read)


def period_rejection(text: str | Column, period_type: str | Column) -> Column:
    """Why ``normalize_period`` refused a text; NULL where it accepted it."""

    def message(v: Column) -> Column:
        return by_period_type(
            period_type,
            lambda name: F.concat(F.lit(f"Invalid {name} period '"), v, F.lit(f"'; expected {PERIOD_INPUTS[name]}")),
        )

    text = as_column(text)
    return F.when(text.isNotNull() & normalize_period(text, period_type).isNull(), message(text))


def next_period(text: str | Column, period_type: str | Column) -> Column:
    """The period after ``text``, in native format."""
    return let(
        period_start(text),
        lambda at: by_period_type(period_type, lambda name: period_id(at + F.expr(PERIOD_STEPS[name]), name)),
    )


def periods_between(start: str | Column, end: str | Column, period_type: str, cutoff: Column | None = None) -> Column:
    """Array of period starts from ``start`` to ``end``, both included; empty if start is later.

    ``start`` and ``end`` are times. ``cutoff`` lowers the end to what a source offers.
    """
    _check_type(period_type)
    first = truncate_to_period(as_column(start), period_type)
    last = truncate_to_period(as_column(end), period_type)
    if cutoff is not None:
        last = F.least(last, truncate_to_period(cutoff, period_type))
    steps = F.sequence(first, F.greatest(first, last), F.expr(PERIOD_STEPS[period_type]))
    return F.when(first <= last, steps).otherwise(F.slice(steps, 1, 0))


def iso_step_hours(text: str | Column) -> Column:
    """Approximate hours of an ISO 8601 duration; NULL if unreadable or zero."""
    text = as_column(text)
    hours: Column = F.lit(0.0)
    for index, weight in enumerate(ISO_UNIT_HOURS.values(), start=1):
        digits = F.nullif(F.regexp_extract(text, ISO_DURATION, index), F.lit(""))
        hours = hours + F.coalesce(digits.cast("double"), F.lit(0.0)) * F.lit(float(weight))
    return F.when(text.rlike(ISO_DURATION) & (hours > 0), hours)


def steps_per_bucket(text: str | Column) -> Column:
    """Time steps stored together: about a week, a month or a year; 12 if the step is unknown."""
    hours = iso_step_hours(text)
    span = F.when(hours < 24, 24.0 * 7).when(hours < 24 * 7, 24.0 * 30).otherwise(24 * 365.25)
    # bround is half-to-even, which is how the step counts are defined
    steps = F.greatest(F.lit(1), F.bround(span / hours).cast("int"))
    return F.when(hours.isNull(), F.lit(12)).otherwise(steps)


def derived_id(source: str | Column, frequency: str | Column, method: str | Column) -> Column:
    """Stable id of a resampled dataset."""
    slug = F.regexp_replace(F.lower(as_column(frequency)), "[^a-z0-9]", "_")
    slug = F.regexp_replace(slug, "^_+|_+$", "")
    return F.concat_ws("_", as_column(source), slug, as_column(method))


def default_end(period_type: str | Column, now: Column) -> Column:
    """Current period; ``now`` is always handed in so that a plan can be repeated."""
    return period_id(now, period_type)
