"""Calendar frequencies and their left-closed, left-labelled bins."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtide.errors import GridError

# Weekday names of the weekly aliases, Monday first.
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")

# Unit -> period type of the resampled dataset.
RESULT_PERIOD_TYPES = {
    "minute": "hourly",
    "hour": "hourly",
    "day": "daily",
    "week": "weekly",
    "month": "monthly",
    "quarter": "monthly",
    "year": "yearly",
}


# Months of each calendar unit.
UNIT_MONTHS = {"month": 1, "quarter": 3, "year": 12}


@dataclass(frozen=True)
class Frequency:
    """A parsed frequency alias: ``n`` minutes, hours, days, weeks with their first weekday, or calendar units."""

    alias: str
    unit: str
    n: int = 1
    weekday: int = 0

    @property
    def period_type(self) -> str:
        return RESULT_PERIOD_TYPES[self.unit]

    @property
    def needs_origin(self) -> bool:
        """Whether the bins depend on the first day of the data."""
        return self.n > 1

    def bin_date(self, day: Column, origin_day: Column | None = None) -> Column:
        """Bin label of a day, as a date. Only for frequencies of whole days."""
        if self.unit == "day":
            if self.n == 1:
                return day
            return F.date_sub(day, F.pmod(F.datediff(day, origin_day), F.lit(self.n)))
        if self.unit == "week":
            start = self._week_start(day)
            if self.n == 1:
                return start
            return F.date_sub(start, F.pmod(F.datediff(start, self._week_start(origin_day)), F.lit(7 * self.n)))
        start = F.trunc(day, self.unit)
        if self.n == 1:
            return start
        since = F.round(F.months_between(start, F.trunc(origin_day, self.unit))).cast("int")
        return F.add_months(start, -F.pmod(since, F.lit(self.n * UNIT_MONTHS[self.unit])))

    def _week_start(self, day: Column) -> Column:
        return F.date_sub(day, F.pmod(F.weekday(day) - self.weekday, F.lit(7)))

    def bin_key(self, t: Column, origin_day: Column | None = None) -> Column:
        """Grouping key of the bin: a date, or minutes or hours since the epoch for shorter bins."""
        day = F.to_date(t)
        if self.unit == "minute":
            minutes = (_epoch_hours(day) + F.hour(t)) * 60 + F.minute(t)
            if self.n == 1:
                return minutes
            return minutes - F.pmod(minutes - _epoch_hours(origin_day) * 60, F.lit(self.n))
        if self.unit != "hour":
            return self.bin_date(day, origin_day)
        hours = _epoch_hours(day) + F.hour(t)
        if self.n == 1:
            return hours
        return hours - F.pmod(hours - _epoch_hours(origin_day), F.lit(self.n))

    def label(self, key: Column) -> Column:
        """Bin key to its naive start time."""
        if self.unit == "minute":
            day = F.date_from_unix_date((key / 1440).cast("int")).cast("timestamp_ntz")
            return day + F.make_dt_interval(F.lit(0), F.lit(0), F.pmod(key, F.lit(1440)))
        if self.unit != "hour":
            return key.cast("timestamp_ntz")
        return F.date_from_unix_date((key / 24).cast("int")).cast("timestamp_ntz") + F.make_dt_interval(
            F.lit(0), F.pmod(key, F.lit(24))
        )

    def next_label(self, label: Column) -> Column:
        """Start of the bin after the one labelled ``label``."""
        return label + F.expr(self.step_text)

    @property
    def step_text(self) -> str:
        size, unit = {
            "minute": (1, "MINUTE"),
            "hour": (1, "HOUR"),
            "day": (1, "DAY"),
            "week": (7, "DAY"),
            "month": (1, "MONTH"),
            "quarter": (3, "MONTH"),
            "year": (1, "YEAR"),
        }[self.unit]
        size *= self.n
        return f"INTERVAL {size} {unit}"

    def roll_forward(self, moment: dt.datetime) -> dt.datetime:
        """First calendar anchor strictly after ``moment``, keeping its time of day."""
        if self.unit == "minute":
            return moment + dt.timedelta(minutes=self.n)
        if self.unit == "hour":
            return moment + dt.timedelta(hours=self.n)
        if self.unit == "day":
            return moment + dt.timedelta(days=self.n)
        if self.unit == "week":
            ahead = (self.weekday - moment.weekday()) % 7 or 7
            return moment + dt.timedelta(days=ahead + 7 * (self.n - 1))
        months = UNIT_MONTHS[self.unit]
        index = moment.year * 12 + moment.month - 1
        index += months - index % months + months * (self.n - 1)
        return moment.replace(year=index // 12, month=index % 12 + 1, day=1)


def _epoch_hours(day: Column) -> Column:
    return F.unix_date(day).cast("bigint") * 24


def parse_frequency(alias: str) -> Frequency:
    """Read ``nmin``, ``nh``, ``nD``, ``nW`` / ``nW-XXX``, ``nMS``, ``nQS`` or ``nYS``; anything else is refused by name.

    Bins of several units count from the first bin of the data.
    """
    text = (alias or "").strip()
    fixed = re.fullmatch(r"(\d*)(min|h|H|D|d)", text)
    units = {"min": "minute", "h": "hour", "H": "hour", "D": "day", "d": "day"}
    if fixed and int(fixed[1] or 1) > 0:
        return Frequency(text, units[fixed[2]], int(fixed[1] or 1))
    week = re.fullmatch(r"(\d*)W(?:-([A-Z]{3}))?", text.upper())
    if week and (week[2] or "SUN") in WEEKDAYS and int(week[1] or 1) > 0:
        return Frequency(text, "week", int(week[1] or 1), WEEKDAYS.index(week[2] or "SUN"))
    calendar = {"MS": "month", "QS": "quarter", "QS-JAN": "quarter", "YS": "year", "YS-JAN": "year"}
    several = re.fullmatch(r"(\d*)([MQY]S(?:-JAN)?)", text.upper())
    if several and several[2] in calendar and int(several[1] or 1) > 0:
        return Frequency(text, calendar[several[2]], int(several[1] or 1))
    raise GridError(f"Invalid frequency '{alias}'")


def bin_start(t: Column, frequency: str | Frequency, origin: Column | None = None) -> Column:
    """Start of the bin that holds ``t``. ``origin`` is the first time of the data; its midnight starts the first bin."""
    freq = parse_frequency(frequency) if isinstance(frequency, str) else frequency
    if freq.needs_origin and origin is None:
        raise GridError(f"Frequency '{freq.alias}' needs the first time of the data as origin")
    origin_day = F.to_date(origin) if origin is not None else None
    return freq.label(freq.bin_key(t, origin_day))
