"""Medians of values that count by a weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Values by which the values of a group are dealt out before one part of them is ranked.
CUTS = 256
CUT_ACCURACY = 10_000

# Sums of weights count as equal within this share of the total.
EQUAL_WEIGHT = 1e-9


def weighted_median(rows: DataFrame, keys: Sequence[str], value: str, weight: str, out: str = "median") -> DataFrame:
    """Median per group of values that count by a weight; values without one, or with a weight of zero, are left out.

    It is the value at which the weights below reach half of all, or the middle between that and the next value where they
    reach exactly half, so equal weights give the plain median. Values are collapsed to distinct ones with the sum of their weights
    where they lie. A mergeable sketch of a group then deals its values into ranges, whose weights are sums again, and only
    the range that holds the middle is ranked, about one in ``CUTS`` of the distinct values. The sums are whole, so the
    result does not depend on how good the sketch is.
    """
    keys = list(keys)
    known = rows.select(*keys, F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))
    values = known.filter("v IS NOT NULL AND NOT isnan(v) AND w > 0").groupBy(*keys, "v").agg(F.sum("w").alias("w"))
    shares = F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)])
    bounds = values.groupBy(*keys).agg(F.percentile_approx("v", shares, CUT_ACCURACY).alias("cuts"), F.sum("w").alias("total"))

    def same(a: str, b: str) -> list[Column]:
        return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] or [F.lit(True)]

    def kept(a: str) -> list[Column]:
        return [F.col(f"{a}.{k}").alias(k) for k in keys]

    part = F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part")
    dealt = values.alias("a").join(bounds.alias("b"), same("a", "b")).select(*kept("a"), "v", "w", "total", part)
    parts = dealt.groupBy(*keys, "part").agg(F.sum("w").alias("pw"), F.first("total").alias("total"), F.min("v").alias("least"))
    order = Window.partitionBy(*keys).orderBy("part")
    slack = F.col("total") * EQUAL_WEIGHT
    run = parts.select(
        *keys, "part", "pw", "total", F.sum("pw").over(order).alias("upto"), F.lead("least").over(order).alias("above")
    )
    middle = run.filter((F.col("upto") >= F.col("total") / 2 - slack) & (F.col("upto") - F.col("pw") < F.col("total") / 2 - slack))
    held = dealt.drop("total").alias("a").join(middle.alias("b"), [*same("a", "b"), F.col("a.part") == F.col("b.part")])
    held = held.select(*kept("a"), "v", "w", "total", "above", (F.col("upto") - F.col("pw")).alias("below"))
    ranks = Window.partitionBy(*keys).orderBy("v")
    ranked = held.select(
        *keys, "v", "w", "total", (F.col("below") + F.sum("w").over(ranks)).alias("upto"), F.coalesce(F.lead("v").over(ranks), F.col("above")).alias("next")
    )
    half = F.col("total") / 2
    reached = ranked.filter((F.col("upto") >= half - slack) & (F.col("upto") - F.col("w") < half - slack))
    exactly = F.abs(F.col("upto") - half) <= slack
    return reached.select(*keys, F.when(exactly & F.col("next").isNotNull(), (F.col("v") + F.col("next")) / 2).otherwise(F.col("v")).alias(out))
