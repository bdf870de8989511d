"""Queries over boxes, exact shares of cells and weighted regridding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.cubes import MERCATOR_X, MERCATOR_Y, rounded
from checks.registry import query
from checks.views import GRID, precip_cube, table, with_views, zones
from gridtide.operators.areas import covered_shares
from gridtide.operators.boxes import meeting_boxes
from gridtide.operators.combine import merge_cubes
from gridtide.operators.regrid import reproject, resample_cube_spatial
from gridtide.operators.zones import aggregate_spatial, cells_in_zones, zonal_statistics
from gridtide.sources.features import rings_of
from gridtide.sources.geometry_text import geometry_of_text, text_of_geometry
from gridtide.sources.grid import GridSpec
from gridtide.sources.sinks import zones_to_table

TENTHS = GridSpec(0.1, 0.1, 10, 0.1, 0.1, 10)

# -- boxes that meet --------------------------------------------------------

ASKED_SQL = """asked AS (
  SELECT c_custkey AS request_id, CASE WHEN c_custkey % 97 <> 0 THEN c_custkey * 7 % 360 - 180.0 END AS xmin, c_custkey * 11 % 180 - 90.0 AS ymin,
         c_custkey * 7 % 360 - 180.0 + CASE WHEN c_custkey % 50 = 0 THEN 120.0 ELSE c_custkey % 13 / 4.0 END AS xmax,
         c_custkey * 11 % 180 - 90.0 + c_custkey % 7 / 2.0 AS ymax FROM customer)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box per customer, some of them very wide, some without an edge."""
    c = F.col("c_custkey")
    x, y = (c * 7 % 360 - 180).cast("double"), (c * 11 % 180 - 90).cast("double")
    wide = F.when(c % 50 == 0, 120.0).otherwise(c % 13 / 4.0)
    return table(spark, sf_dir, "customer").select(
        c.alias("request_id"), F.when(c % 97 != 0, x).alias("xmin"), y.alias("ymin"), (x + wide).alias("xmax"), (y + c % 7 / 2.0).alias("ymax")
    )


@query(
    f"""WITH {ASKED_SQL}, declared AS (
         SELECT CAST(n_nationkey AS VARCHAR) AS dataset_id, n_nationkey * 10 - 120.0 AS x0, n_nationkey * 5 - 60.0 AS y0,
                CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 10 - 100.0 END AS x1, n_nationkey * 5 - 50.0 AS y1 FROM nation)
       SELECT dataset_id, request_id FROM asked JOIN declared ON xmin <= x1 AND xmax >= x0 AND ymin <= y1 AND ymax >= y0
       UNION ALL SELECT dataset_id, NULL FROM declared WHERE x1 IS NULL
       UNION ALL SELECT NULL, request_id FROM asked WHERE xmin IS NULL"""
)
def datasets_of_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which datasets each request meets, without naming one; what has no usable box comes out alone."""
    n = F.col("n_nationkey")
    low = [(n * k - o).cast("double") for k, o in ((10, 120), (5, 60))]
    right = F.when(n % 5 != 0, (n * 10 - 100).cast("double"))
    declared = table(spark, sf_dir, "nation").select(
        n.cast("string").alias("dataset_id"), low[0].alias("xmin"), low[1].alias("ymin"), right.alias("xmax"), (n * 5 - 50).cast("double").alias("ymax")
    )
    return meeting_boxes(declared, _asked(spark, sf_dir), "dataset_id", "request_id")


@query(
    f"""WITH {ASKED_SQL}, served AS (
         SELECT s_suppkey, s_suppkey * 13 % 360 - 180.0 AS x0, s_suppkey * 5 % 180 - 90.0 AS y0, s_suppkey * 13 % 360 - 180.0 + s_suppkey % 9 AS x1,
                s_suppkey * 5 % 180 - 90.0 + CASE WHEN s_suppkey % 40 = 0 THEN 60.0 ELSE s_suppkey % 4 END AS y1 FROM supplier)
       SELECT s_suppkey, request_id FROM asked JOIN served ON xmin <= x1 AND xmax >= x0 AND ymin <= y1 AND ymax >= y0
       UNION ALL SELECT NULL, request_id FROM asked WHERE xmin IS NULL"""
)
def meeting_service_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of suppliers and customers that meet, many of both and of very different sizes."""
    s = F.col("s_suppkey")
    x, y = (s * 13 % 360 - 180).cast("double"), (s * 5 % 180 - 90).cast("double")
    high = F.when(s % 40 == 0, 60.0).otherwise((s % 4).cast("double"))
    served = table(spark, sf_dir, "supplier").select("s_suppkey", x.alias("xmin"), y.alias("ymin"), (x + s % 9).alias("xmax"), (y + high).alias("ymax"))
    return meeting_boxes(served, _asked(spark, sf_dir), "s_suppkey", "request_id")


# -- exact shares of cells --------------------------------------------------


def _sql_triangle(a: str, b: str, c: str, d: str, s: str) -> str:
    """Area of the part of the box a..b, c..d below the line x + y = s."""
    terms = [f"{sign} POWER(GREATEST({s} - {x} - {y}, 0), 2)" for sign, x, y in (("", a, c), ("-", b, c), ("-", a, d), ("+", b, d))]
    return f"({' '.join(terms)}) / 2"


SHARES_SQL = f"""frames AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS zone_id, n_nationkey % 5 * 1.9 - 1.0037 AS x0, FLOOR(n_nationkey / 5.0) * 1.7 - 0.9041 AS y0 FROM nation),
cells AS (SELECT a.r AS x, b.r AS y FROM RANGE(10) a(r), RANGE(10) b(r)),
boxes AS (SELECT zone_id, x, y, x0, y0, GREATEST(x - 0.5, x0) AS a, x + 0.5 AS b, GREATEST(y - 0.5, y0) AS c, y + 0.5 AS d
          FROM frames, cells WHERE x + 0.5 > x0 AND y + 0.5 > y0 AND x - 0.5 < x0 + 4 AND y - 0.5 < y0 + 4),
shares AS (SELECT zone_id, x, y, w FROM (
  SELECT zone_id, x, y, {_sql_triangle('a', 'b', 'c', 'd', '(x0 + y0 + 4)')}
         - GREATEST(0, LEAST(x + 0.5, x0 + 1.5) - GREATEST(x - 0.5, x0 + 0.5)) * GREATEST(0, LEAST(y + 0.5, y0 + 1.5) - GREATEST(y - 0.5, y0 + 0.5)) AS w
  FROM boxes) WHERE w > 1e-9)"""


def holed_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle per nation with a square hole, some of them partly beyond the grid; the hole runs the same way round as the outline."""
    n = F.col("n_nationkey")
    x0, y0 = n % 5 * 1.9 - 1.0037, F.floor(n / 5.0) * 1.7 - 0.9041

    def ring(*corners: tuple[float, float]) -> Column:
        return F.array(*[F.struct((x0 + a).alias("x"), (y0 + b).alias("y")) for a, b in corners])

    outer, hole = ring((0, 0), (4, 0), (0, 4)), ring((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5))
    return table(spark, sf_dir, "nation").select(n.cast("string").alias("id"), F.array(outer, hole).alias("rings"))


@query(f"WITH {SHARES_SQL} SELECT zone_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, ROUND(w, 9) AS weight FROM shares")
def exact_zone_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of every cell that a triangle with a hole covers."""
    shares = covered_shares(holed_triangles(spark, sf_dir), GRID)
    return shares.filter("weight > 1e-9").select("zone_id", "x", "y", F.round("weight", 9).alias("weight"))


@query(
    with_views("daily")
    + f""", {SHARES_SQL}, placed AS (SELECT zone_id, DATE_TRUNC('month', t) AS t, precip AS v, w FROM daily JOIN shares USING (x, y)),
         grouped AS (SELECT zone_id, t, v, SUM(w) AS w FROM placed GROUP BY 1, 2, 3),
         run AS (SELECT zone_id, t, v, w, SUM(w) OVER (PARTITION BY zone_id, t ORDER BY v) AS upto, SUM(w) OVER (PARTITION BY zone_id, t) AS total,
                        LEAD(v) OVER (PARTITION BY zone_id, t ORDER BY v) AS above FROM grouped),
         middle AS (SELECT zone_id, t, CASE WHEN ABS(upto - total / 2) <= 1e-9 * total AND above IS NOT NULL THEN (v + above) / 2 ELSE v END AS median
                    FROM run WHERE upto >= total / 2 - 1e-9 * total AND upto - w < total / 2 - 1e-9 * total)
         SELECT zone_id, t, ROUND(SUM(w), 3) AS "count", ROUND(SUM(v * w), 3) AS "sum", ROUND(SUM(v * w) / SUM(w), 3) AS mean,
                ROUND(ANY_VALUE(median), 3) AS median
         FROM placed JOIN middle USING (zone_id, t) GROUP BY 1, 2"""
)
def exactly_weighted_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly statistics of triangles, median included, where a cell counts by its covered share."""
    shares = covered_shares(holed_triangles(spark, sf_dir), GRID).filter("weight > 1e-9")
    cube = precip_cube(spark, sf_dir).withColumn("t", F.date_trunc("month", "t").cast("timestamp_ntz"))
    names = ("count", "sum", "mean", "median")
    stats = zonal_statistics(cube, shares, "precip", names, grid=GRID)
    return stats.withColumns({name: F.round(name, 3) for name in names})


# -- regridding by weights --------------------------------------------------

COARSE = GridSpec(0.25, 1.5, 7, 9.1, -1.3, 8)

OVERLAPS_SQL = """cols AS (SELECT 0.25 + r * 1.5 AS tx, x, LEAST(x + 0.5, 0.25 + r * 1.5 + 0.75) - GREATEST(x - 0.5, 0.25 + r * 1.5 - 0.75) AS wx
             FROM RANGE(7) t(r), RANGE(10) s(x)),
     rws AS (SELECT 9.1 - r * 1.3 AS ty, y, LEAST(y + 0.5, 9.1 - r * 1.3 + 0.65) - GREATEST(y - 0.5, 9.1 - r * 1.3 - 0.65) AS wy
             FROM RANGE(8) t(r), RANGE(10) s(y))"""


def _gappy_sql(value: str = "precip") -> str:
    return f"gappy AS (SELECT t, y, x, CASE WHEN (x + y) % 7 <> 0 THEN {value} END AS v FROM daily)"


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rain cube with missing values in every seventh diagonal."""
    return precip_cube(spark, sf_dir).withColumn("precip", F.when((F.col("x") + F.col("y")) % 7 != 0, F.col("precip")))


@query(
    with_views("daily")
    + f""", {_gappy_sql()}, {OVERLAPS_SQL}
         SELECT t, ROUND(ty, 6) AS y, ROUND(tx, 6) AS x, ROUND(SUM(v * wx * wy) / SUM(CASE WHEN v IS NOT NULL THEN wx * wy END), 6) AS precip
         FROM gappy JOIN cols USING (x) JOIN rws USING (y) WHERE wx > 1e-9 AND wy > 1e-9 GROUP BY 1, 2, 3"""
)
def area_means_on_other_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the area of larger cells that run downwards; missing cells do not count."""
    moved = resample_cube_spatial(_gappy(spark, sf_dir), COARSE, "average", source=GRID)
    return rounded(moved, "y", "x", "precip")


@query(
    with_views("daily")
    + f""", {_gappy_sql()}, {OVERLAPS_SQL}
         SELECT t, ROUND(ty, 6) AS y, ROUND(tx, 6) AS x, ROUND(SUM(v * wx * wy), 6) AS precip
         FROM gappy JOIN cols USING (x) JOIN rws USING (y) WHERE wx > 1e-9 AND wy > 1e-9 GROUP BY 1, 2, 3"""
)
def kept_totals_on_other_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts split by area, so that totals are kept."""
    moved = resample_cube_spatial(_gappy(spark, sf_dir), COARSE, "sum", source=GRID)
    return rounded(moved, "y", "x", "precip")


def _sql_neighbours(name: str, target: str, place: str, count: int, source: str) -> str:
    place = f"CAST({place} AS DOUBLE)"
    held = f"LEAST(GREATEST({place}, 0.0), 9.0)"
    return f"""{name} AS (SELECT {target} AS t{source}, CAST(FLOOR({held}) + k AS BIGINT) AS {source},
        CASE k WHEN 0 THEN 1 - ({held} - FLOOR({held})) ELSE {held} - FLOOR({held}) END AS w{source}
      FROM RANGE({count}) t(r), RANGE(2) n(k) {{box}} WHERE {place} > -0.5 - 1e-9 AND {place} < 9.5 + 1e-9)"""


@query(
    with_views("daily")
    + f""", {_gappy_sql()}, {_sql_neighbours("cols", "0.21 + r * 0.7013", "(0.21 + r * 0.7013)", 13, "x").format(box="")},
         {_sql_neighbours("rws", "8.33 - r * 1.8713", "(8.33 - r * 1.8713)", 5, "y").format(box="")}
         SELECT t, ROUND(ty, 6) AS y, ROUND(tx, 6) AS x, ROUND(SUM(v * wx * wy) / SUM(CASE WHEN v IS NOT NULL THEN wx * wy END), 4) AS precip
         FROM gappy JOIN cols USING (x) JOIN rws USING (y) WHERE wx > 1e-9 AND wy > 1e-9 GROUP BY 1, 2, 3"""
)
def bilinear_on_other_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear values on a finer axis in x and a coarser, downward one in y."""
    target = GridSpec(0.21, 0.7013, 13, 8.33, -1.8713, 5)
    moved = resample_cube_spatial(_gappy(spark, sf_dir), target, "bilinear", source=GRID)
    return rounded(rounded(moved, "y", "x"), "precip", digits=4)


_BACK_X = "DEGREES((x0 + (x1 - x0) / 10 * (r + 0.5)) / 6378137.0)"
_BACK_Y = "DEGREES(2 * ATAN(EXP((y0 + (y1 - y0) / 10 * (r + 0.5)) / 6378137.0)) - PI() / 2)"


@query(
    with_views("daily")
    + f""", {_gappy_sql()}, box AS (SELECT {MERCATOR_X.format('-0.5')} AS x0, {MERCATOR_X.format('9.5')} AS x1,
                           {MERCATOR_Y.format('-0.5')} AS y0, {MERCATOR_Y.format('9.5')} AS y1),
         {_sql_neighbours("cols", "x0 + (x1 - x0) / 10 * (r + 0.5)", _BACK_X, 10, "x").format(box=", box")},
         {_sql_neighbours("rws", "y0 + (y1 - y0) / 10 * (r + 0.5)", _BACK_Y, 10, "y").format(box=", box")}
         SELECT t, ROUND(ty, 3) AS y, ROUND(tx, 3) AS x, ROUND(SUM(v * wx * wy) / SUM(CASE WHEN v IS NOT NULL THEN wx * wy END), 6) AS precip
         FROM gappy JOIN cols USING (x) JOIN rws USING (y) WHERE wx > 1e-9 AND wy > 1e-9 GROUP BY 1, 2, 3"""
)
def bilinear_mercator_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degree grid on a regular Mercator grid, from the four cells around each projected centre."""
    moved = reproject(_gappy(spark, sf_dir), "EPSG:4326", "EPSG:3857", source_grid=GRID, method="bilinear")
    return rounded(rounded(moved, "y", "x", digits=3), "precip")


# -- cells whose coordinates differ in their last bits ------------------------


@query(
    with_views("daily")
    + """, b AS (SELECT o_orderdate AS t, CAST(FLOOR(o_custkey / 10.0) AS BIGINT) % 10 AS y, o_custkey % 10 AS x, COUNT(*) AS orders FROM orders GROUP BY 1, 2, 3)
         SELECT t, y AS iy, x AS ix, ROUND(precip, 6) AS precip, orders FROM daily FULL JOIN b USING (t, y, x)"""
)
def merged_tenths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments on coordinates read as decimal texts and orders on computed ones, as one cube on cells a tenth wide."""
    left = precip_cube(spark, sf_dir).select(
        "t", *[F.format_string("%.1f", (F.col(a) + 1) / 10.0).cast("double").alias(a) for a in ("y", "x")], "precip"
    )
    key = F.col("o_custkey")
    y, x = F.floor(key / 10.0).cast("bigint") % 10, key % 10
    ordered = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("t"), ((y + 1) * F.lit(0.1)).alias("y"), ((x + 1) * F.lit(0.1)).alias("x"))
    merged = merge_cubes(left, ordered.agg(F.count("*").alias("orders")), grid=TENTHS)
    return merged.select("t", TENTHS.iy(F.col("y")).alias("iy"), TENTHS.ix(F.col("x")).alias("ix"), F.round("precip", 6).alias("precip"), "orders")


@query(
    with_views("daily", "zones", "assigned")
    + """SELECT zone_id, CASE WHEN CAST(zone_id AS BIGINT) % 3 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind,
                CAST(CASE WHEN CAST(zone_id AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS parts, ANY_VALUE(x0) AS west, ANY_VALUE(y1) AS north,
                ROUND(SUM(precip), 6) AS precip
         FROM daily JOIN assigned USING (x, y) JOIN zones USING (zone_id) GROUP BY 1"""
)
def zones_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones whose geometry went through text, every third as two polygons: the sums of their cells beside their outline."""
    shapes = zones(spark, sf_dir).select("id", "geometry")
    far = F.transform(F.col("geometry.coordinates")[0], lambda ring: F.transform(ring, lambda p: F.array(p[0] + 100, p[1] - 100)))
    several = F.struct(F.lit("MultiPolygon").alias("type"), F.concat("geometry.coordinates", F.array(far)).alias("coordinates"))
    shaped = F.when(F.col("id").cast("int") % 3 == 0, several).otherwise(F.struct(F.lit("Polygon").alias("type"), F.col("geometry.coordinates").alias("coordinates")))
    written = shapes.select("id", text_of_geometry(shaped).alias("geometry"))
    read = written.select("id", geometry_of_text(F.col("geometry")).alias("g"))
    held = cells_in_zones(GRID.cells(spark), read.select("id", rings_of(F.col("g.coordinates")).alias("rings")))
    sums = aggregate_spatial(precip_cube(spark, sf_dir).drop("t"), held, "sum")
    ring = F.col("geometry.coordinates")[0][0]
    return zones_to_table(sums, written).select(
        "zone_id",
        F.col("geometry.type").alias("kind"),
        F.size("geometry.coordinates").cast("bigint").alias("parts"),
        F.array_min(F.transform(ring, lambda p: p[0])).alias("west"),
        F.array_max(F.transform(ring, lambda p: p[1])).alias("north"),
        F.round("precip", 6).alias("precip"),
    )
