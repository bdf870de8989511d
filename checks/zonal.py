"""Queries over polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import query
from checks.views import GRID, hourly_cube, precip_cube, table, with_views, zones
from gridtide.operators.combine import densify
from gridtide.operators.reduce import reduce_dimension
from gridtide.operators.resample import aggregate_temporal_period
from gridtide.operators.zones import (
    aggregate_spatial,
    attach_statistics,
    cell_weights,
    cells_in_zones,
    data_values,
    pivot_zones,
    zonal_statistics,
)
from gridtide.plans.zonal_report import zonal_period_totals
from gridtide.sources.grid import GridSpec

ZONAL = with_views("daily", "zones", "assigned")

MONTHLY_SQL = """, monthly AS (SELECT DATE_TRUNC('month', t) AS t, y, x, SUM(precip) AS precip FROM daily GROUP BY 1, 2, 3),
         zonal AS (SELECT zone_id, t, AVG(precip) AS precip FROM monthly JOIN assigned USING (x, y) GROUP BY 1, 2)"""

def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonal_period_totals(precip_cube(spark, sf_dir), zones(spark, sf_dir), GRID.cells(spark))


@query(ZONAL + MONTHLY_SQL + "SELECT zone_id, t, ROUND(precip, 6) AS precip FROM zonal")
def monthly_zone_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sums per cell, then the mean over the cells of every zone."""
    return _totals(spark, sf_dir).withColumn("precip", F.round("precip", 6))


@query("WITH " + ZONAL.split("WITH ", 1)[1] + "SELECT zone_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM assigned WHERE (x, y) IN (SELECT (x, y) FROM daily)")
def cells_of_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the cube in each square."""
    cells = precip_cube(spark, sf_dir).select(F.col("x").cast("double"), F.col("y").cast("double")).distinct()
    return cells_in_zones(cells, zones(spark, sf_dir)).select("zone_id", "x", "y")


@query(
    """WITH places AS (SELECT c_custkey, (c_custkey * 37 % 1000) / 100.0 AS x, (c_custkey * 91 % 1000) / 100.0 AS y FROM customer),
            frames AS (SELECT CAST(n_nationkey AS VARCHAR) AS zone_id, n_nationkey % 5 * 1.5 + 0.0037 AS x0,
                              FLOOR(n_nationkey / 5.0) * 1.5 + 0.0041 AS y0 FROM nation)
       SELECT zone_id, COUNT(*) AS n, SUM(c_custkey) AS keys
       FROM places JOIN frames ON (y > y0 AND y < y0 + 4 AND x > x0 AND x < x0 + 4 - (y - y0))
        AND NOT (x > x0 + 0.5 AND x < x0 + 1.5 AND y > y0 + 0.5 AND y < y0 + 1.5) GROUP BY 1"""
)
def places_in_holed_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' places in overlapping triangles, each with a square hole."""
    nation = table(spark, sf_dir, "nation")
    x0 = F.col("n_nationkey") % 5 * 1.5 + 0.0037
    y0 = F.floor(F.col("n_nationkey") / 5.0) * 1.5 + 0.0041

    def ring(*corners: tuple[float, float]):
        return F.array(*[F.struct((x0 + a).alias("x"), (y0 + b).alias("y")) for a, b in corners])

    outer = ring((0, 0), (4, 0), (0, 4), (0, 0))
    hole = ring((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5))
    frames = nation.select(F.col("n_nationkey").cast("string").alias("id"), F.array(outer, hole).alias("rings"))
    key = F.col("c_custkey")
    places = table(spark, sf_dir, "customer").select(
        "c_custkey", (key * 37 % 1000 / 100.0).alias("x"), (key * 91 % 1000 / 100.0).alias("y")
    )
    held = cells_in_zones(places, frames, dx=0.1, dy=0.1)
    return held.groupBy("zone_id").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query(
    """WITH frames AS (SELECT CAST(n_nationkey AS VARCHAR) AS zone_id, n_nationkey % 5 * 1.9 - 0.2 AS x0,
                              FLOOR(n_nationkey / 5.0) * 1.9 - 0.3 AS y0 FROM nation),
            cells AS (SELECT DISTINCT CAST(FLOOR(l_suppkey / 10.0) AS BIGINT) % 10 AS y, l_suppkey % 10 AS x FROM lineitem)
       SELECT zone_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM cells JOIN frames
         ON x + 0.5 >= x0 AND x - 0.5 <= x0 + 1.1 AND y + 0.5 >= y0 AND y - 0.5 <= y0 + 1.4"""
)
def touched_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose area a rectangle touches, also where it does not reach the centre."""
    frames = _frames(spark, sf_dir, 1.9, -0.2, -0.3, 1.1, 1.4)
    held = cells_in_zones(_cells(spark, sf_dir), frames, 1.0, 1.0, all_touched=True)
    return held.select("zone_id", "x", "y")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_suppkey")
    y = (F.floor(key / 10.0) % 10).cast("double").alias("y")
    return table(spark, sf_dir, "lineitem").select(y, (key % 10).cast("double").alias("x")).distinct()


def _frames(spark, sf_dir, step: float, left: float, bottom: float, width: float, height: float) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    x0 = F.col("n_nationkey") % 5 * step + left
    y0 = F.floor(F.col("n_nationkey") / 5.0) * step + bottom
    corners = ((0, 0), (width, 0), (width, height), (0, height), (0, 0))
    ring = F.array(*[F.struct((x0 + a).alias("x"), (y0 + b).alias("y")) for a, b in corners])
    return nation.select(F.col("n_nationkey").cast("string").alias("id"), F.array(ring).alias("rings"))


@query(
    with_views("hourly", "zones", "assigned")
    + """SELECT zone_id, t, CAST(COUNT(v) AS DOUBLE) AS "count", ROUND(SUM(v), 9) AS "sum", ROUND(AVG(v), 9) AS mean,
                ROUND(MIN(v), 9) AS "min", ROUND(MAX(v), 9) AS "max", ROUND(MEDIAN(v), 9) AS median,
                ROUND(STDDEV_POP(v), 6) AS std
         FROM (SELECT zone_id, t, CASE WHEN t2m <> 10.5 THEN t2m END AS v FROM hourly JOIN assigned USING (x, y)) GROUP BY 1, 2"""
)
def zone_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven statistics per zone and hour; one value stands for missing."""
    names = ("count", "sum", "mean", "min", "max", "median", "std")
    held = cells_in_zones(GRID.cells(spark), zones(spark, sf_dir))
    stats = zonal_statistics(hourly_cube(spark, sf_dir), held, "t2m", names, nodata=10.5)
    return stats.withColumns({name: F.round(name, 6 if name == "std" else 9) for name in names})


@query(
    with_views("daily", "zones", "assigned")
    + """SELECT zone_id, ROUND(MEDIAN(precip), 6) AS median, CAST(COUNT(*) AS DOUBLE) AS "count"
         FROM daily JOIN assigned USING (x, y) GROUP BY 1"""
)
def zone_medians_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over all cells and days of a zone: groups far larger than one time step."""
    held = cells_in_zones(GRID.cells(spark), zones(spark, sf_dir))
    cube = precip_cube(spark, sf_dir).drop("t")
    return zonal_statistics(cube, held, "precip", ("median", "count")).withColumn("median", F.round("median", 6))


@query(
    with_views("daily")
    + """, frames AS (SELECT CAST(n_nationkey AS VARCHAR) AS zone_id, n_nationkey % 5 * 2 AS x0,
                           FLOOR(n_nationkey / 5.0) * 2 AS y0 FROM nation),
         shares AS (SELECT zone_id, x, y,
                     GREATEST(0, LEAST(x + 0.5, x0 + 1.75) - GREATEST(x - 0.5, x0 - 0.25)) *
                     GREATEST(0, LEAST(y + 0.5, y0 + 2.0) - GREATEST(y - 0.5, y0 - 0.5)) AS w
                    FROM (SELECT a.r AS x, b.r AS y FROM RANGE(10) a(r), RANGE(10) b(r)) JOIN frames ON x > x0 - 1 AND x < x0 + 3 AND y > y0 - 1 AND y < y0 + 3)
         SELECT zone_id, t, ROUND(SUM(w), 6) AS "count", ROUND(SUM(w * precip), 6) AS "sum",
                ROUND(SUM(w * precip) / SUM(w), 6) AS mean, MIN(precip) AS "min", MAX(precip) AS "max"
         FROM daily JOIN shares USING (x, y) WHERE w > 0 GROUP BY 1, 2"""
)
def weighted_zone_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partly covered cells count by their covered share, here on quarter-cell sample points."""
    frames = _frames(spark, sf_dir, 2.0, -0.25, -0.5, 2.0, 2.5)
    shares = cell_weights(GRID.cells(spark), frames, 1.0, 1.0, k=4)
    names = ("count", "sum", "mean", "min", "max")
    stats = zonal_statistics(precip_cube(spark, sf_dir), shares, "precip", names)
    return stats.withColumns({name: F.round(name, 6) for name in names})


@query(
    with_views("daily", "zones", "assigned")
    + """SELECT name, ROUND(AVG(precip), 6) AS mean, CAST(COUNT(precip) AS DOUBLE) AS n
         FROM daily JOIN assigned USING (x, y) GROUP BY 1
         UNION ALL SELECT name, NULL, NULL FROM zones WHERE zone_id NOT IN
           (SELECT zone_id FROM daily JOIN assigned USING (x, y))"""
)
def zones_with_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features themselves with their statistics as a property."""
    features = zones(spark, sf_dir)
    held = cells_in_zones(GRID.cells(spark), features)
    stats = zonal_statistics(precip_cube(spark, sf_dir).drop("t"), held, "precip", ("mean", "count"))
    packed = attach_statistics(features, stats, ("mean", "count"), "rain")
    return packed.select("name", F.round("rain.mean", 6).alias("mean"), F.col("rain.count").alias("n"))


@query(
    ZONAL
    + MONTHLY_SQL
    + """, months AS (SELECT DISTINCT STRFTIME(t, '%Y-%m') AS month FROM monthly), named AS (SELECT DISTINCT zone_id FROM zonal)
         SELECT (SELECT name FROM zones z WHERE z.zone_id = n.zone_id) AS name, zone_id, month,
                COALESCE((SELECT PRINTF('%.1f', ROUND(precip, 6) + 1e-9) FROM zonal l
                          WHERE l.zone_id = n.zone_id AND STRFTIME(l.t, '%Y-%m') = month), 'n/a') AS text
         FROM named n CROSS JOIN months"""
)
def zone_month_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone by month table of texts with one decimal; its months are those of the data. Unpivoted to compare it."""
    features = zones(spark, sf_dir)
    # a hair above the rounded value, so that both engines print halves alike
    totals = _totals(spark, sf_dir).withColumn("precip", F.round("precip", 6) + F.lit(1e-9))
    wide = pivot_zones(totals, "precip", names=features)
    months = [name for name in wide.columns if name not in ("name", "zone_id")]
    return wide.unpivot(["name", "zone_id"], months, "month", "text")


@query(
    with_views("daily", "zones", "assigned")
    + """SELECT 'rain' AS data_element, zone_id AS org_unit, STRFTIME(t, '%G-W%V') AS period, ROUND(SUM(precip), 6) AS value,
                'default' AS category_option_combo
         FROM (SELECT DATE_TRUNC('week', t) AS t, x, y, precip FROM daily) JOIN assigned USING (x, y) GROUP BY t, zone_id"""
)
def weekly_import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly zonal sums as rows to be imported elsewhere."""
    weeks = aggregate_temporal_period(precip_cube(spark, sf_dir), "week", "sum")
    held = cells_in_zones(GRID.cells(spark), zones(spark, sf_dir))
    rows = data_values(aggregate_spatial(weeks, held, "sum"), "precip", "rain", "weekly", category_option_combo="default")
    return rows.withColumn("value", F.round("value", 6))


# -- grids whose steps are no binary fractions ------------------------------

TENTH = GridSpec(0.1, 0.1, 10, -0.5, 0.1, 10)
TWENTIETH = GridSpec(30.05, 0.05, 10, 9.95, -0.05, 10)


def _tenth_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rain cube with coordinates as a file has them: decimal texts read as numbers."""
    return precip_cube(spark, sf_dir).select(
        "t",
        F.format_string("%.1f", F.col("y") / 10.0 - 0.5).cast("double").alias("y"),
        F.format_string("%.1f", (F.col("x") + 1) / 10.0).cast("double").alias("x"),
        "precip",
    )


def _tenth_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squares of the nations, shrunk to the grid of tenths."""
    ring = F.transform(
        F.col("rings")[0],
        lambda p: F.struct((p["x"] / 10 + 0.1).alias("x"), (p["y"] / 10 - 0.5).alias("y")),
    )
    return zones(spark, sf_dir).withColumn("rings", F.array(ring))


@query(
    with_views("daily", "zones", "assigned")
    + """SELECT zone_id, DATE_TRUNC('month', t) AS t, ROUND(SUM(precip), 6) AS precip
         FROM daily JOIN assigned USING (x, y) GROUP BY 1, 2"""
)
def tenth_degree_zone_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by zone first and then by month, on cells a tenth wide: zones stay apart and no cell is lost."""
    held = cells_in_zones(TENTH.cells(spark), _tenth_zones(spark, sf_dir), 0.1, 0.1)
    daily = aggregate_spatial(_tenth_cube(spark, sf_dir), held, "sum")
    monthly = aggregate_temporal_period(daily, "month", "sum")
    return monthly.withColumn("precip", F.round("precip", 6))


@query(
    with_views("daily", "zones", "assigned")
    + """SELECT zone_id, DATE_TRUNC('month', t) AS t, CAST(COUNT(v) AS DOUBLE) AS "count", ROUND(SUM(v), 6) AS "sum", ROUND(AVG(v), 6) AS mean,
                ROUND(MIN(v), 6) AS "min", ROUND(MAX(v), 6) AS "max", ROUND(MEDIAN(v), 6) AS median, ROUND(STDDEV_POP(v), 5) AS std
         FROM (SELECT zone_id, t, precip AS v FROM daily JOIN assigned USING (x, y)) GROUP BY 1, 2"""
)
def tenth_degree_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven statistics per zone and month on cells a tenth wide."""
    names = ("count", "sum", "mean", "min", "max", "median", "std")
    held = cells_in_zones(TENTH.cells(spark), _tenth_zones(spark, sf_dir), 0.1, 0.1)
    cube = _tenth_cube(spark, sf_dir).withColumn("t", F.date_trunc("month", "t").cast("timestamp_ntz"))
    stats = zonal_statistics(cube, held, "precip", names)
    return stats.withColumns({name: F.round(name, 5 if name == "std" else 6) for name in names})


@query(
    with_views("daily", "zones", "assigned")
    + "SELECT zone_id, ROUND(MAX(p), 6) AS precip FROM (SELECT zone_id, t, SUM(precip) AS p FROM daily JOIN assigned USING (x, y) GROUP BY 1, 2) GROUP BY 1"
)
def zone_maxima_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wettest day of every zone: time is reduced and zones are kept."""
    held = cells_in_zones(GRID.cells(spark), zones(spark, sf_dir))
    daily = aggregate_spatial(precip_cube(spark, sf_dir), held, "sum")
    return reduce_dimension(daily, "t", "max").withColumn("precip", F.round("precip", 6))


@query(
    with_views("hourly")
    + """, days AS (SELECT DATE_TRUNC('day', t) AS t, y, x, SUM(t2m) AS t2m FROM hourly GROUP BY 1, 2, 3),
         spine AS (SELECT UNNEST(GENERATE_SERIES((SELECT MIN(t) FROM days), (SELECT MAX(t) FROM days), INTERVAL 1 DAY)) AS t)
         SELECT s.t, c.iy, c.ix, ROUND(t2m, 6) AS t2m
         FROM spine s CROSS JOIN (SELECT a.r AS ix, b.r AS iy FROM RANGE(10) a(r), RANGE(10) b(r)) c
         LEFT JOIN days d ON d.t = s.t AND d.y = c.iy AND d.x = c.ix"""
)
def twentieth_degree_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days made dense on cells a twentieth wide, rows from north to south; stored coordinates are decimal texts."""
    cube = hourly_cube(spark, sf_dir).groupBy(F.date_trunc("day", "t").cast("timestamp_ntz").alias("t"), "y", "x")
    cube = cube.agg(F.sum("t2m").alias("t2m")).select(
        "t",
        F.format_string("%.2f", F.lit(9.95) - F.col("y") * 0.05).cast("double").alias("y"),
        F.format_string("%.2f", F.lit(30.05) + F.col("x") * 0.05).cast("double").alias("x"),
        "t2m",
    )
    dense = densify(cube, "daily", TWENTIETH.cells(spark))
    iy, ix = TWENTIETH.iy(F.col("y")).alias("iy"), TWENTIETH.ix(F.col("x")).alias("ix")
    return dense.select("t", iy, ix, F.round("t2m", 6).alias("t2m"))
