"""Resampling a stream of cube rows to bins of fixed width and to calendar bins."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gridtide.errors import GridError
from gridtide.functions.frequency import UNIT_MONTHS, Frequency, parse_frequency
from gridtide.functions.reducers import RESAMPLE_METHODS, reducer
from gridtide.operators.select import naive, parse_partial
from gridtide.schema import key_columns, value_columns

EPOCH = dt.datetime(1970, 1, 1)


def stream_resample(
    rows: DataFrame,
    frequency: str,
    method: str,
    start: str,
    watermark: str = "1 hour",
    extra_dims: Sequence[str] = (),
) -> DataFrame:
    """Bins of a streaming cube. In append mode a bin comes out once the watermark has passed its end,
    so the last, incomplete one is never emitted.

    ``start`` is the first source time: its midnight is the origin of multi-day bins, and a bin that
    began before it is left out. Rows behind the watermark are dropped by Spark; see ``LateRows``. Months, quarters and
    years are bins too, see ``calendar_bins``; of a start within a bin, that bin is left out.
    """
    freq = parse_frequency(frequency)
    if freq.unit == "minute":
        raise GridError(f"Frequencies below an hour cannot be streamed, not '{frequency}'")
    if method not in RESAMPLE_METHODS:
        raise GridError(f"Unsupported method '{method}'. Supported: {', '.join(RESAMPLE_METHODS)}")
    first = parse_partial(start)[0]
    values = value_columns(rows, extra_dims)
    keys = key_columns(rows, extra_dims, drop=("t",))
    if freq.unit in UNIT_MONTHS:
        bins, start_of_bin = calendar_bins(freq, first)
        rows = rows.withColumn("t", F.date_trunc("second", "t"))
    else:
        bins, start_of_bin = fixed_bins(freq, first), F.col("bin.start").cast("timestamp_ntz")
    fold = reducer(method)
    folded = (
        rows.withColumn("t", F.col("t").cast("timestamp"))  # a watermark needs this type; the session zone is UTC
        .withWatermark("t", watermark)
        .groupBy(bins.alias("bin"), *keys)
        .agg(*[fold(F.col(name)).alias(name) for name in values])
    )
    any_value = F.coalesce(*[F.col(name) for name in values]).isNotNull()
    complete = folded.filter(any_value & (start_of_bin >= naive(first)))
    return complete.select(start_of_bin.alias("t"), *keys, *values)


def fixed_bins(freq: Frequency, first: dt.datetime) -> Column:
    """Windows of hours, days and weeks, counted from the day of the first time."""
    hours = {"hour": 1, "day": 24, "week": 24 * 7}[freq.unit] * freq.n
    if freq.unit == "week":
        days = (first - EPOCH).days - (first.weekday() - freq.weekday) % 7
        offset = days * 24 % hours
    else:
        midnight = first.replace(hour=0, minute=0, second=0, microsecond=0)
        offset = int((midnight - EPOCH).total_seconds() // 3600) % hours
    return F.window("t", f"{hours} hours", startTime=f"{offset} hours")


def calendar_bins(freq: Frequency, first: dt.datetime) -> tuple[Column, Column]:
    """Windows of calendar length over ``t`` in whole seconds, and the start of the bin a window lies in.

    Spark has no windows of months, but sessions whose gap is an expression: with a gap that ends just before the end of
    its bin, all rows of a bin lie in one session and rows of two bins never do. The watermark stays on the time of
    the rows, so a bin comes out when the watermark has passed its last moment, however long the month is.
    """
    origin = F.lit(first.date())

    def start(t: Column) -> Column:
        return freq.label(freq.bin_key(t.cast("timestamp_ntz"), origin))

    end = freq.next_label(start(F.col("t"))).cast("timestamp")
    gap = F.unix_micros(end) - F.unix_micros("t") - 1
    return F.session_window("t", F.concat(gap.cast("string"), F.lit(" microseconds"))), start(F.col("bin.start"))


class LateRows(StreamingQueryListener):
    """Counts rows that came behind the watermark and were left out, over the whole life of every query.

    Progress that Spark keeps for a query is cut to the last hundred triggers; events are not.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._counts: dict[str, int] = {}
        self._ended: dict[str, threading.Event] = {}
        self._spark = spark
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._ended.setdefault(str(event.id), threading.Event()).clear()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        name = str(event.progress.id)
        late = sum(int(o.numRowsDroppedByWatermark) for o in event.progress.stateOperators)
        self._counts[name] = self._counts.get(name, 0) + late

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._ended.setdefault(str(event.id), threading.Event()).set()

    def of(self, query: StreamingQuery, wait: float = 30.0) -> int:
        """Rows left out so far; of an ended query all of them, once its last event has come."""
        if not query.isActive:
            self._ended.setdefault(str(query.id), threading.Event()).wait(wait)
        return self._counts.get(str(query.id), 0)

    def close(self) -> None:
        self._spark.streams.removeListener(self)
