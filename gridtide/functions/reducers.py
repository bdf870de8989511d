"""Named reducers and element-wise callbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtide.errors import GridError

Reducer = Callable[[Column], Column]
Callback = Callable[[Column], Column]

# All of these keep a partial state per group on the map side, so a hot group is
# reduced before it is shuffled. Missing values are skipped by each.
REDUCERS: dict[str, Reducer] = {
    "count": F.count,
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_pop,
}

RESAMPLE_METHODS = ("max", "mean", "min", "sum")


def reducer(name: str | Reducer) -> Reducer:
    """A reducer by name, or the function itself."""
    if callable(name):
        return name
    if name not in REDUCERS:
        raise GridError(f"Unknown reducer '{name}'. Known: {', '.join(sorted(REDUCERS))}")
    return REDUCERS[name]


def divide(by: float) -> Callback:
    """Callback that divides every value."""
    return lambda value: value / F.lit(float(by))


def multiply(by: float) -> Callback:
    return lambda value: value * F.lit(float(by))


def add(amount: float) -> Callback:
    return lambda value: value + F.lit(float(amount))


def subtract(amount: float) -> Callback:
    return lambda value: value - F.lit(float(amount))


CALLBACKS: dict[str, Callable[[float], Callback]] = {
    "divide": divide,
    "multiply": multiply,
    "add": add,
    "subtract": subtract,
}
