"""Queries over period texts and availability rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import query
from checks.views import SQL_PERIOD_TYPE, period_type_of, sql_period, sql_period_start, table
from gridtide.functions.availability import lagged_available, latest_complete_month, release_available
from gridtide.functions.periods import (
    default_end,
    derived_id,
    iso_step_hours,
    next_period,
    normalize_period,
    period_id,
    period_rejection,
    period_start,
    periods_between,
    steps_per_bucket,
)

PT = SQL_PERIOD_TYPE.format("o_custkey")


@query(
    "SELECT event_id, "
    + ", ".join(f"{sql_period('ts', repr(p))} AS {p}" for p in ("hourly", "daily", "weekly", "monthly", "yearly"))
    + " FROM events"
)
def period_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("hourly", "daily", "weekly", "monthly", "yearly")
    return table(spark, sf_dir, "events").select("event_id", *[period_id("ts", kind).alias(kind) for kind in kinds])


RAW_SQL = f"""raw AS (
  SELECT o_orderkey, o_orderdate AS d, pt,
         CASE o_orderkey % 8
           WHEN 0 THEN STRFTIME(o_orderdate, '%Y-%m-%d') || 'T00:30:00+02:00'
           WHEN 1 THEN STRFTIME(o_orderdate, '%Y-%m-%d') || ' 23:15:10.25-01:30'
           WHEN 2 THEN STRFTIME(o_orderdate, '%Y-%m-%d') || 'T13:00Z'
           WHEN 3 THEN STRFTIME(o_orderdate, '%Y-%m-%d')
           WHEN 4 THEN {sql_period('o_orderdate', 'pt')}
           WHEN 5 THEN STRFTIME(o_orderdate, '%Y-%m') || '-31'
           WHEN 6 THEN STRFTIME(o_orderdate, '%Y') || '-W' || LPAD(CAST(o_orderkey % 60 AS VARCHAR), 2, '0')
           ELSE STRFTIME(o_orderdate, '%Y') || '-' || LPAD(CAST(o_orderkey % 15 AS VARCHAR), 2, '0') END AS text
  FROM (SELECT *, {PT} AS pt FROM orders))"""

# what each kind of text means, per period type
NORMAL_SQL = f"""CASE
  WHEN o_orderkey % 8 = 0 THEN {sql_period("(d + INTERVAL 30 MINUTE - INTERVAL 2 HOUR)", 'pt')}
  WHEN o_orderkey % 8 = 1 THEN {sql_period("(d + INTERVAL 23 HOUR + INTERVAL 15 MINUTE + INTERVAL 90 MINUTE)", 'pt')}
  WHEN o_orderkey % 8 = 2 THEN {sql_period("(d + INTERVAL 13 HOUR)", 'pt')}
  WHEN o_orderkey % 8 = 3 THEN {sql_period('d', 'pt')}
  WHEN o_orderkey % 8 = 4 THEN text
  WHEN o_orderkey % 8 = 5 THEN CASE WHEN DAY(LAST_DAY(d)) = 31 THEN {sql_period('LAST_DAY(d)', 'pt')} END
  WHEN o_orderkey % 8 = 6 THEN CASE WHEN pt = 'weekly' AND o_orderkey % 60 BETWEEN 1 AND
       WEEKOFYEAR(MAKE_DATE(YEAR(d), 12, 28)) THEN text END
  ELSE CASE WHEN pt = 'monthly' AND o_orderkey % 15 BETWEEN 1 AND 12 THEN text END END"""


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders in eight spellings, some of them wrong, with a period type each."""
    d, key = F.col("o_orderdate"), F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("pt", period_type_of("o_custkey"))
    day, pick = F.date_format(d, "yyyy-MM-dd"), key % 8
    text = (
        F.when(pick == 0, F.concat(day, F.lit("T00:30:00+02:00")))
        .when(pick == 1, F.concat(day, F.lit(" 23:15:10.25-01:30")))
        .when(pick == 2, F.concat(day, F.lit("T13:00Z")))
        .when(pick == 3, day)
        .when(pick == 4, period_id(d, F.col("pt")))
        .when(pick == 5, F.concat(F.date_format(d, "yyyy-MM"), F.lit("-31")))
        .when(pick == 6, F.concat(F.date_format(d, "yyyy"), F.lit("-W"), F.lpad((key % 60).cast("string"), 2, "0")))
        .otherwise(F.concat(F.date_format(d, "yyyy"), F.lit("-"), F.lpad((key % 15).cast("string"), 2, "0")))
    )
    return orders.select("o_orderkey", "pt", text.alias("text"))


@query(
    f"""WITH {RAW_SQL} SELECT o_orderkey, text, pt, normal, CASE WHEN normal IS NULL THEN
        'Invalid ' || pt || ' period ''' || text || '''; expected ' || CASE pt WHEN 'hourly' THEN 'YYYY-MM-DDTHH'
        WHEN 'daily' THEN 'YYYY-MM-DD' WHEN 'weekly' THEN 'YYYY-Www' WHEN 'monthly' THEN 'YYYY-MM' ELSE 'YYYY' END
        || ' or ISO datetime' END AS rejection
        FROM (SELECT *, {NORMAL_SQL} AS normal FROM raw)"""
)
def normalised_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period texts brought to native format, offsets taken into account, with the reason where refused."""
    return raw_texts(spark, sf_dir).select(
        "o_orderkey",
        "text",
        "pt",
        normalize_period("text", F.col("pt")).alias("normal"),
        period_rejection("text", F.col("pt")).alias("rejection"),
    )


@query(
    f"""SELECT o_orderkey, period, {sql_period_start('period', 'pt')} AS starts
        FROM (SELECT o_orderkey, pt, {sql_period('o_orderdate', 'pt')} AS period FROM (SELECT *, {PT} AS pt FROM orders))"""
)
def period_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    texts = orders.select("o_orderkey", period_id("o_orderdate", period_type_of("o_custkey")).alias("period"))
    return texts.withColumn("starts", period_start("period"))


@query(
    f"""SELECT o_orderkey, period, CASE pt WHEN 'hourly' THEN STRFTIME(s + INTERVAL 1 HOUR, '%Y-%m-%dT%H')
          WHEN 'daily' THEN STRFTIME(s + INTERVAL 1 DAY, '%Y-%m-%d') WHEN 'weekly' THEN STRFTIME(s + INTERVAL 7 DAY, '%G-W%V')
          WHEN 'monthly' THEN STRFTIME(s + INTERVAL 1 MONTH, '%Y-%m') ELSE STRFTIME(s + INTERVAL 1 YEAR, '%Y') END AS following
        FROM (SELECT *, {sql_period_start('period', 'pt')} AS s FROM
        (SELECT o_orderkey, pt, {sql_period('o_orderdate', 'pt')} AS period FROM (SELECT *, {PT} AS pt FROM orders)))"""
)
def following_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("pt", period_type_of("o_custkey"))
    texts = orders.select("o_orderkey", "pt", period_id("o_orderdate", F.col("pt")).alias("period"))
    return texts.select("o_orderkey", "period", next_period("period", F.col("pt")).alias("following"))


@query(
    """WITH span AS (SELECT l_suppkey, DATE_TRUNC('month', MIN(l_shipdate)) AS a, MAX(l_shipdate) AS z FROM lineitem GROUP BY 1)
       SELECT l_suppkey, STRFTIME(UNNEST(GENERATE_SERIES(a, LEAST(z, TIMESTAMP '2001-06-30'), INTERVAL 1 MONTH)), '%Y-%m') AS period
       FROM span"""
)
def months_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month between first and last shipment of a supplier, up to what is released."""
    items = table(spark, sf_dir, "lineitem")
    span = items.groupBy("l_suppkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("z"))
    released = F.lit("2001-06-30 00:00:00").cast("timestamp_ntz")
    months = span.select("l_suppkey", F.explode(periods_between("a", "z", "monthly", released)).alias("t"))
    return months.select("l_suppkey", period_id("t", "monthly").alias("period"))


@query(
    """SELECT o_orderkey, text,
         CASE WHEN bad OR h <= 0 THEN NULL ELSE ROUND(h, 6) END AS hours,
         CAST(CASE WHEN bad OR h <= 0 THEN 12 WHEN h < 24 THEN GREATEST(1, ROUND_EVEN(168 / h, 0))
              WHEN h < 168 THEN GREATEST(1, ROUND_EVEN(720 / h, 0)) ELSE GREATEST(1, ROUND_EVEN(8766 / h, 0)) END AS BIGINT) AS steps
       FROM (SELECT *, CASE k WHEN 0 THEN n / 60.0 WHEN 1 THEN n WHEN 2 THEN n * 24.0 WHEN 3 THEN n * 168.0 WHEN 4 THEN n * 730.5
                       WHEN 5 THEN 8766.0 + n * 730.5 + 24 + n + n / 3600.0 ELSE 0 END AS h, k = 6 AS bad FROM
         (SELECT *, CASE k WHEN 0 THEN 'PT' || n || 'M' WHEN 1 THEN 'PT' || n || 'H' WHEN 2 THEN 'P' || n || 'D'
                    WHEN 3 THEN 'P' || n || 'W' WHEN 4 THEN 'P' || n || 'M' WHEN 5 THEN 'P1Y' || n || 'M1DT' || n || 'H' || n || 'S'
                    ELSE n || ' days' END AS text
          FROM (SELECT o_orderkey, o_orderkey % 7 AS k, o_custkey % 40 AS n FROM orders)))"""
)
def step_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of ISO durations and the number of steps stored together."""
    n, kind = (F.col("o_custkey") % 40).cast("string"), F.col("o_orderkey") % 7
    one_year = F.concat(F.lit("P1Y"), n, F.lit("M1DT"), n, F.lit("H"), n, F.lit("S"))
    text = F.when(kind == 5, one_year).when(kind == 6, F.concat(n, F.lit(" days")))
    for index, (head, tail) in enumerate((("PT", "M"), ("PT", "H"), ("P", "D"), ("P", "W"), ("P", "M"))):
        text = text.when(kind == index, F.concat(F.lit(head), n, F.lit(tail)))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).select(
        "o_orderkey",
        "text",
        F.round(iso_step_hours("text"), 6).alias("hours"),
        steps_per_bucket("text").cast("bigint").alias("steps"),
    )


@query(
    """SELECT o_orderkey, 'cube_' || o_custkey || '_' || CASE o_orderkey % 4 WHEN 0 THEN 'w_mon' WHEN 1 THEN '10d'
              WHEN 2 THEN 'ms' ELSE 'qs_jan' END || '_' || LOWER(o_orderpriority) AS derived FROM orders"""
)
def derived_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    alias = F.when(kind == 0, "W-MON").when(kind == 1, "10D").when(kind == 2, "_MS").otherwise("QS-JAN ")
    source = F.concat(F.lit("cube_"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", derived_id(source, alias, F.lower("o_orderpriority")).alias("derived")
    )


@query(
    f"""SELECT event_id, {sql_period('ts', SQL_PERIOD_TYPE.format('user_id'))} AS default_end,
          STRFTIME(LAST_DAY(ts - INTERVAL (CASE WHEN DAY(ts) > 20 THEN 1 ELSE 2 END) MONTH), '%Y-%m-%d') AS complete_month,
          CASE WHEN pt = 'hourly' AND lag > 0 THEN STRFTIME(ts - INTERVAL (lag) HOUR, '%Y-%m-%dT%H')
               WHEN pt = 'daily' AND lag > 0 THEN STRFTIME(ts - INTERVAL (lag) DAY, '%Y-%m-%d')
               WHEN pt = 'monthly' AND lag > 0 THEN STRFTIME(ts - INTERVAL (lag) DAY, '%Y-%m')
               WHEN pt = 'yearly' AND off >= 0 THEN CAST(YEAR(ts) - off AS VARCHAR) ELSE 'asked' END AS lagged,
          CASE WHEN future THEN 'asked' WHEN fixed IS NOT NULL THEN CAST(fixed AS VARCHAR)
               WHEN off >= 0 THEN CAST(YEAR(ts) - off AS VARCHAR) ELSE 'asked' END AS release
        FROM (SELECT *, {SQL_PERIOD_TYPE.format('user_id')} AS pt, event_id % 50 - 5 AS lag,
                     CASE WHEN event_id % 3 <> 0 THEN event_id % 4 - 1 END AS off,
                     CASE WHEN event_id % 5 = 0 THEN 2000 + event_id % 20 END AS fixed, event_id % 9 = 0 AS future FROM events)"""
)
def availability_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the three release policies offer if "now" is the time of an event."""
    key, at = F.col("event_id"), F.col("ts")
    kind = period_type_of("user_id")
    lag = (key % 50 - 5).cast("int")
    offset = F.when(key % 3 != 0, key % 4 - 1).cast("int")
    asked = F.lit("asked")
    yearly = lagged_available(at, F.lit("yearly"), asked, lag, lag, offset)
    return table(spark, sf_dir, "events").select(
        "event_id",
        default_end(kind, at).alias("default_end"),
        latest_complete_month(at).alias("complete_month"),
        lagged_available(at, kind, asked, lag, lag, offset).alias("lagged"),
        release_available(key % 9 == 0, F.when(key % 5 == 0, 2000 + key % 20), asked, yearly).alias("release"),
    )
