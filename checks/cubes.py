"""Queries over cubes: reading, selecting, converting, aggregating, combining, regridding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import query
from checks.views import (
    GRID,
    band_cube,
    daily_cube,
    daily_rows,
    daily_times,
    hourly_cube,
    hourly_times,
    on_grid,
    precip_cube,
    table,
    with_views,
    zones,
)
from gridtide.functions.frequency import bin_start
from gridtide.functions.reducers import divide
from gridtide.operators import select
from gridtide.operators.catalog import cut_collection
from gridtide.operators.combine import append_periods, densify, find_gaps, merge_cubes
from gridtide.operators.elementwise import (
    apply,
    clamp_min,
    kelvin_to_celsius,
    linear_convert,
    metres_to_mm,
    rename_labels,
    run_transforms,
)
from gridtide.operators.reduce import (
    axis_summary,
    build_overviews,
    coarsen,
    coverage,
    read_overview,
    reduce_bands,
    reduce_dimension,
    reduce_spatial,
    update_overviews,
)
from gridtide.operators.regrid import reproject, resample_cube_spatial
from gridtide.operators.resample import aggregate_temporal_period, drop_incomplete_edges, resample
from gridtide.registry import Recipes, process_by_name, register_process, register_transform
from gridtide.session import scratch_path
from gridtide.sources.cube import (
    mask_nodata,
    normalise_axes,
    read_cube,
    read_many,
    select_variable,
    write_cube,
)
from gridtide.sources.features import read_features, read_observations
from gridtide.sources.grid import GridSpec, grid_shape
from gridtide.sources.sinks import save_result, write_csv, write_geojson, write_parquet, zones_to_table

R = 6


def rounded(df: DataFrame, *names: str, digits: int = R) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def time(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# -- sources and sinks -----------------------------------------------------


@query(
    with_views("daily")
    + """SELECT t, y, x, ROUND(precip, 6) AS precip, ROUND(price, 2) AS price FROM daily
         WHERE t >= TIMESTAMP '1997-03-01' AND t < TIMESTAMP '1997-07-01' AND x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 8"""
)
def stored_cube_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily cube written in its storage layout, then opened for four months and a box."""
    path = scratch_path(spark, "cube")
    write_cube(daily_cube(spark, sf_dir), path, dataset_id="rain", iso_step="P1D")
    part = read_cube(spark, path, "1997-03", "1997-06", (2, 1, 6, 8))
    part = part.select("t", "y", "x", "precip", "price")
    return rounded(rounded(part, "precip"), "price", digits=2)


@query(
    with_views("daily")
    + """SELECT t, y, x, ROUND(precip, 6) AS precip, ROUND(price, 2) AS price FROM daily
         WHERE t >= TIMESTAMP '1998-05-01' AND t < TIMESTAMP '1998-09-01' AND x BETWEEN 3 AND 4 AND y BETWEEN 5 AND 6"""
)
def tiled_cube_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily cube laid out by tiles of two by two cells along a Z-shaped curve, then opened for four months and a small box."""
    path = scratch_path(spark, "tiled-cube")
    write_cube(daily_cube(spark, sf_dir), path, dataset_id="rain", iso_step="P1D", tile=(2.0, 2.0))
    part = read_cube(spark, path, "1998-05", "1998-08", (3, 5, 4, 6)).select("t", "y", "x", "precip", "price")
    return rounded(rounded(part, "precip"), "price", digits=2)


@query(
    with_views("daily")
    + """SELECT t, y, x, ROUND(precip, 6) AS precip FROM daily"""
)
def several_files_one_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores of one dataset and one of a dataset with a longer name, opened as one cube."""
    cube = precip_cube(spark, sf_dir)
    early, late, other = (scratch_path(spark, name) for name in ("early", "late", "other"))
    write_cube(select.filter_temporal(cube, None, "1998"), early, dataset_id="rain")
    write_cube(select.filter_temporal(cube, "1998", None), late, dataset_id="rain")
    write_cube(cube, other, dataset_id="rain_modified")
    return rounded(read_many(spark, [early, late, other], "rain").select("t", "y", "x", "precip"), "precip")


@query(
    with_views("daily")
    + """SELECT EXTRACT(year FROM t) AS year, COUNT(*) AS n, ROUND(SUM(precip), 6) AS precip
         FROM daily GROUP BY 1"""
)
def replaced_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One year of a stored cube is written wrong, then replaced bucket by bucket; the rest stays."""
    path = scratch_path(spark, "buckets")
    cube = precip_cube(spark, sf_dir)
    broken = cube.withColumn("precip", F.when(F.year("t") == 1999, F.lit(0.0)).otherwise(F.col("precip")))
    write_cube(broken, path, dataset_id="rain", iso_step="P1Y")
    bad = spark.read.parquet(path).filter(F.year("t") == 1999).select("time_bucket").distinct()
    stored = spark.read.parquet(path)
    touched = stored.join(bad, "time_bucket", "left_semi").select("t", "y", "x")
    write_cube(cube.join(touched, ["t", "y", "x"], "left_semi"), path, "replace_buckets", "rain", "P1Y")
    per_year = read_cube(spark, path).groupBy(F.year("t").cast("bigint").alias("year"))
    return rounded(per_year.agg(F.count("*").alias("n"), F.sum("precip").alias("precip")), "precip")


@query(
    """SELECT ts AS t, CAST(user_id % 10 AS DOUBLE) AS x, CAST(event_id % 7 AS DOUBLE) AS y,
              ROUND(value, 6) AS value FROM events"""
)
def canonical_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with valid_time, lon and lat gets the canonical axis names."""
    raw = table(spark, sf_dir, "events").select(
        F.col("ts").alias("valid_time"),
        (F.col("user_id") % 10).cast("double").alias("lon"),
        (F.col("event_id") % 7).cast("double").alias("lat"),
        "value",
    )
    return rounded(normalise_axes(raw), "value")


@query(with_views("daily") + "SELECT t, y, x, ROUND(tax, 6) AS tax FROM daily")
def one_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select_variable(daily_cube(spark, sf_dir), "tax"), "tax")


@query(
    """SELECT l_shipdate AS t, CAST(FLOOR(l_suppkey / 10.0) AS BIGINT) % 10 AS y, l_suppkey % 10 AS x,
              COUNT(*) AS n, COUNT(NULLIF(l_quantity, 50)) AS known, SUM(NULLIF(l_quantity, 50)) AS precip
       FROM lineitem GROUP BY 1, 2, 3"""
)
def nodata_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value 50 stands for missing and NaN comes with it; sums then skip both."""
    rows = daily_rows(spark, sf_dir).select("t", "y", "x", "precip")
    masked = mask_nodata(rows, ["precip"], 50.0)
    return masked.groupBy("t", "y", "x").agg(
        F.count("*").alias("n"), F.count("precip").alias("known"), F.sum("precip").alias("precip")
    )


@query(
    with_views("zones")
    + "SELECT zone_id AS id, name, CAST(1 AS BIGINT) AS n_rings, 5 * CAST(1 AS BIGINT) AS n_points, x0, y0, x1, y1 FROM zones"
)
def features_from_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones written as GeoJSON features, one per line, and read back as polygons."""
    path = scratch_path(spark, "zones")
    write_geojson(zones(spark, sf_dir).select("id", "name", "geometry"), path)
    read = read_features(spark, path, lines=True)
    ring = F.col("rings")[0]
    return read.select(
        "id",
        "name",
        F.size("rings").cast("bigint").alias("n_rings"),
        F.size(ring).cast("bigint").alias("n_points"),
        F.array_min(ring["x"]).alias("x0"),
        F.array_min(ring["y"]).alias("y0"),
        F.array_max(ring["x"]).alias("x1"),
        F.array_max(ring["y"]).alias("y1"),
    )


@query(
    """SELECT CAST(event_id AS INTEGER) AS id, CAST(user_id AS INTEGER) AS stn_id, DATE_TRUNC('second', ts) AS datetime,
              value, CAST(user_id % 90 AS DOUBLE) AS lat, CAST(event_id % 180 AS DOUBLE) AS long FROM events"""
)
def station_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as CSV with quoted ISO times, written and read back."""
    path = scratch_path(spark, "stations")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("stn_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"),
        "value",
        (F.col("user_id") % 90).cast("double").alias("lat"),
        (F.col("event_id") % 180).cast("double").alias("long"),
    )
    write_csv(rows, path)
    return read_observations(spark, path)


@query(
    with_views("daily")
    + "SELECT STRFTIME(t, '%Y-%m-%d') AS day, CAST(y AS VARCHAR) AS y, CAST(x AS VARCHAR) AS x, ROUND(precip, 2) AS precip FROM daily"
)
def flat_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube as CSV; columns left over from array libraries are not written."""
    path = scratch_path(spark, "csv")
    cube = precip_cube(spark, sf_dir).withColumns(
        {"spatial_ref": F.lit(0), "index": F.monotonically_increasing_id(), "level_0": F.lit(1)}
    )
    save_result(cube, path, "csv")
    read = spark.read.option("header", "true").csv(path)
    return read.select(
        F.substring("t", 1, 10).alias("day"),
        *[c for c in read.columns if c not in ("t", "precip")],
        F.round(F.col("precip").cast("double"), 2).alias("precip"),
    )


ZONE_SUMS_SQL = with_views("daily", "zones", "assigned")


@query(
    ZONE_SUMS_SQL
    + """SELECT zone_id, t, ROUND(SUM(precip), 6) AS precip, 'Polygon' AS kind, CAST(5 AS BIGINT) AS points
         FROM daily JOIN assigned USING (x, y) GROUP BY 1, 2"""
)
def zonal_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zonal sums as Parquet with the geometry of their zones."""
    path = scratch_path(spark, "zonal")
    features = zones(spark, sf_dir)
    write_parquet(zones_to_table(_zone_sums(spark, sf_dir), features), path)
    return spark.read.parquet(path).select(
        "zone_id",
        "t",
        "precip",
        F.col("geometry.type").alias("kind"),
        F.size(F.col("geometry.coordinates")[0][0]).cast("bigint").alias("points"),
    )


@query(
    ZONE_SUMS_SQL
    + """SELECT zone_id, STRFTIME(t, '%Y-%m-%d') AS day, ROUND(SUM(precip), 6) AS precip, 'Polygon' AS kind
         FROM daily JOIN assigned USING (x, y) GROUP BY 1, 2"""
)
def zonal_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zonal sums as GeoJSON, which also an unknown vector format falls back to."""
    path = scratch_path(spark, "geojson")
    save_result(zones_to_table(_zone_sums(spark, sf_dir), zones(spark, sf_dir)), path, "shapefile")
    lines = spark.read.text(path)
    return lines.select(
        F.get_json_object("value", "$.properties.zone_id").alias("zone_id"),
        F.substring(F.get_json_object("value", "$.properties.t"), 1, 10).alias("day"),
        F.round(F.get_json_object("value", "$.properties.precip").cast("double"), 6).alias("precip"),
        F.get_json_object("value", "$.geometry.type").alias("kind"),
    )


def _zone_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridtide.operators.zones import aggregate_spatial, cells_in_zones

    held = cells_in_zones(GRID.cells(spark), zones(spark, sf_dir))
    return rounded(aggregate_spatial(precip_cube(spark, sf_dir), held, "sum"), "precip")


# -- selection -------------------------------------------------------------


@query(
    with_views("daily")
    + "SELECT t, y, x, ROUND(precip, 6) AS precip FROM daily WHERE t >= TIMESTAMP '1996-02-01' AND t < TIMESTAMP '1999-04-01'"
)
def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive slice whose end is a partial date and covers the whole month."""
    return rounded(select.slice_time(precip_cube(spark, sf_dir), "1996-02-01T00:00:00Z", "1999-03"), "precip")


@query(
    with_views("daily")
    + "SELECT t, y, x, ROUND(precip, 6) AS precip FROM daily WHERE t >= TIMESTAMP '1996-02-01' AND t < TIMESTAMP '1999-03-01'"
)
def time_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.filter_temporal(precip_cube(spark, sf_dir), "1996-02", "1999-03"), "precip")


@query(
    with_views("daily")
    + "SELECT t, y, x, ROUND(precip, 6) AS precip FROM daily WHERE x BETWEEN 1 AND 4.5 AND y BETWEEN 2 AND 8"
)
def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    extent = {"West": 1.0, "EAST": 4.5, "south": 2.0, "north": 8.0}
    return rounded(select.filter_bbox(precip_cube(spark, sf_dir), extent), "precip")


@query(with_views("daily") + "SELECT t, y, x, ROUND(price, 2) AS price, ROUND(tax, 6) AS tax FROM daily")
def band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = select.filter_bands(daily_cube(spark, sf_dir), ["price", "no_such_band", "tax"])
    return rounded(rounded(kept, "tax"), "price", digits=2)


@query(
    with_views("daily")
    + """SELECT t, y, x, 'precip' AS band, ROUND(precip, 2) AS value FROM daily
         UNION ALL SELECT t, y, x, 'price', ROUND(price, 2) FROM daily
         UNION ALL SELECT t, y, x, 'tax', ROUND(tax, 2) FROM daily"""
)
def stacked_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.stack_bands(daily_cube(spark, sf_dir)), "value", digits=2)


@query(
    with_views("daily")
    + """SELECT t, y, x, band, value FROM (
           SELECT t, y, x, 'precip' AS band, ROUND(precip, 2) AS value FROM daily
           UNION ALL SELECT t, y, x, 'price', ROUND(price, 2) FROM daily)
         WHERE t >= TIMESTAMP '1997-01-01' AND t < TIMESTAMP '1999-01-01' AND x BETWEEN 0 AND 4"""
)
def collection_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time, then box, then bands, then stacking: the order in which a collection is loaded."""
    cube = daily_cube(spark, sf_dir)
    cut = cut_collection(cube, {"west": 0, "east": 4}, ["1997", "1998"], ["precip", "price"])
    return rounded(cut, "value", digits=2)


@query(
    with_views("daily")
    + "SELECT t, y, x, ROUND(precip, 6) AS precip FROM daily WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4"
)
def extent_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose area touches the box: half a cell more than the centres inside."""
    return rounded(select.clip_to_extent(precip_cube(spark, sf_dir), (2.5, 1.4, 5.9, 3.6), 1.0, 1.0), "precip")


@query(
    with_views("daily")
    + """SELECT t, y, x, ROUND(precip, 6) AS precip FROM daily
         WHERE t = (SELECT t FROM (SELECT DISTINCT t FROM daily) ORDER BY t LIMIT 1 OFFSET 99)"""
)
def hundredth_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.snapshot(precip_cube(spark, sf_dir), 99), "precip")


@query(
    with_views("daily")
    + """SELECT t, ROUND(AVG(precip), 6) AS precip FROM daily
         WHERE t IN (SELECT DISTINCT t FROM daily ORDER BY t LIMIT 10) GROUP BY 1"""
)
def first_ten_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial mean of the first ten steps."""
    return rounded(reduce_spatial(select.first_steps(precip_cube(spark, sf_dir), 10), "mean"), "precip")


@query(
    with_views("daily")
    + "SELECT t, y, x, ROUND(precip, 6) AS precip FROM daily WHERE STRFTIME(t, '%G-W%V') = '1998-W53' OR STRFTIME(t, '%Y-%m') = '2000-02'"
)
def single_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ISO week and one month, each picked by its period text."""
    cube = precip_cube(spark, sf_dir)
    week = select.select_period(cube, "1998-W53", "weekly")
    month = select.select_period(cube, "2000-02", "monthly")
    return rounded(append_periods(week, month), "precip")


NEAREST_SERIES_SQL = (
    with_views("daily")
    + """SELECT t, y, x, ROUND(precip, 6) AS precip FROM daily
         WHERE x = (SELECT x FROM (SELECT DISTINCT x FROM daily) ORDER BY ABS(x - 6.5), x LIMIT 1)
           AND y = (SELECT y FROM (SELECT DISTINCT y FROM daily)
                    ORDER BY ABS(y - (SELECT AVG(y) FROM (SELECT DISTINCT y FROM daily))), y LIMIT 1)"""
)


@query(NEAREST_SERIES_SQL)
def nearest_cell_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of the cell nearest to a place; the row is the one nearest to the centre of the grid."""
    return rounded(select.nearest_point(precip_cube(spark, sf_dir), x=6.5), "precip")


@query(NEAREST_SERIES_SQL)
def nearest_cell_series_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the grid known: series of the cell nearest to a place; the row is the one nearest to the centre of the grid."""
    return rounded(select.nearest_point(precip_cube(spark, sf_dir), x=6.5, grid=GRID), "precip")


NEAREST_CELLS_SQL = (
    with_views("daily")
    + """, places AS (SELECT s_suppkey AS point_id, (s_suppkey * 37 % 1300) / 100.0 - 1.5 AS px,
                        (s_suppkey * 53 % 1300) / 100.0 - 1.5 AS py FROM supplier),
         xs AS (SELECT point_id, px, (SELECT x FROM (SELECT DISTINCT x FROM daily) d ORDER BY ABS(x - px), x LIMIT 1) AS x FROM places),
         ys AS (SELECT point_id, (SELECT y FROM (SELECT DISTINCT y FROM daily) d ORDER BY ABS(y - py), y LIMIT 1) AS y FROM places)
         SELECT point_id, COUNT(*) AS steps, ROUND(SUM(precip), 6) AS precip
         FROM xs JOIN ys USING (point_id) JOIN daily USING (x, y) GROUP BY 1"""
)


@query(NEAREST_CELLS_SQL)
def nearest_cells_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total of the nearest cell for a place per supplier."""
    key = F.col("s_suppkey")
    places = table(spark, sf_dir, "supplier").select(
        key.alias("point_id"),
        (key * 37 % 1300 / 100.0 - 1.5).alias("px"),
        (key * 53 % 1300 / 100.0 - 1.5).alias("py"),
    )
    series = select.nearest_points(precip_cube(spark, sf_dir), places, cells=daily_rows(spark, sf_dir))
    totals = series.groupBy("point_id").agg(F.count("*").alias("steps"), F.sum("precip").alias("precip"))
    return rounded(totals, "precip")


@query(NEAREST_CELLS_SQL)
def nearest_cells_of_suppliers_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the grid known: total of the nearest cell for a place per supplier."""
    key = F.col("s_suppkey")
    places = table(spark, sf_dir, "supplier").select(
        key.alias("point_id"),
        (key * 37 % 1300 / 100.0 - 1.5).alias("px"),
        (key * 53 % 1300 / 100.0 - 1.5).alias("py"),
    )
    series = select.nearest_points(precip_cube(spark, sf_dir), places, grid=GRID)
    totals = series.groupBy("point_id").agg(F.count("*").alias("steps"), F.sum("precip").alias("precip"))
    return rounded(totals, "precip")


@query(
    """WITH declared AS (SELECT CAST(n_nationkey AS VARCHAR) AS dataset_id, n_nationkey * 10 - 120.0 AS x0,
              n_nationkey * 10 - 100.0 AS x1, n_nationkey * 5 - 60.0 AS y0, n_nationkey * 5 - 50.0 AS y1,
              n_nationkey % 5 <> 0 AS ok FROM nation),
            asked AS (SELECT c_custkey AS request_id, CAST(c_nationkey AS VARCHAR) AS dataset_id,
              c_custkey % 360 - 180.0 AS xmin, c_custkey % 360 - 100.0 AS xmax,
              c_custkey % 180 - 90.0 AS ymin, c_custkey % 180 - 60.0 AS ymax FROM customer)
       SELECT request_id, dataset_id, xmin, ymin, xmax, ymax, why IS NULL AS covered, why AS rejected_on
       FROM (SELECT *, CASE WHEN NOT ok THEN NULL WHEN ymin > y1 OR ymax < y0 THEN 'latitude'
                            WHEN xmin > x1 OR xmax < x0 THEN 'longitude' END AS why
             FROM asked JOIN declared USING (dataset_id))"""
)
def extent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes asked by customers against the box their nation's dataset declares."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    box = F.array(*[e.cast("double") for e in (n * 10 - 120, n * 5 - 60, n * 10 - 100, n * 5 - 50)])
    short = F.slice(box, 1, 3)
    declared = nation.select(n.cast("string").alias("dataset_id"), F.when(n % 5 != 0, box).otherwise(short).alias("bbox"))
    asked = customer.select(
        c.alias("request_id"),
        F.col("c_nationkey").cast("string").alias("dataset_id"),
        (c % 360 - 180.0).alias("xmin"),
        (c % 180 - 90.0).alias("ymin"),
        (c % 360 - 100.0).alias("xmax"),
        (c % 180 - 60.0).alias("ymax"),
    )
    return select.covers_extent(declared, asked)


FEATURE_PREDICATE = (
    "(c_acctbal BETWEEN 1000 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')) "
    "OR (c_name LIKE 'Customer%7' AND NOT c_nationkey < 20) OR (c_name ILIKE '%CUSTOMER%99%' AND c_acctbal IS NOT NULL)"
)


@query(f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE {FEATURE_PREDICATE}")
def feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.filter_features(table(spark, sf_dir, "customer"), FEATURE_PREDICATE)


# -- element-wise ----------------------------------------------------------


@query(with_views("hourly") + "SELECT t, y, x, ROUND(t2m * 1.8 + 32, 6) AS t2m FROM hourly")
def linear_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linear_convert(hourly_cube(spark, sf_dir), "t2m", 1.8, 32.0, "degF"), "t2m")


@query(with_views("hourly") + "SELECT t, y, x, ROUND(t2m - 273.15, 6) AS t2m FROM hourly")
def celsius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kelvin_to_celsius(hourly_cube(spark, sf_dir), "t2m"), "t2m")


@query(with_views("daily") + "SELECT t, y, x, ROUND(precip * 1000, 3) AS precip FROM daily")
def millimetres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metres_to_mm(precip_cube(spark, sf_dir), "precip"), "precip", digits=3)


@query(
    with_views("hourly")
    + "SELECT t, y, x, ROUND(GREATEST((t2m - 273.15) * 2 + 1, -540), 6) AS t2m FROM hourly"
)
def declared_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three declared transforms in order: by name, with parameters, and one of the user's own."""
    register_transform("floor_at", lambda cube, template, lo: clamp_min(cube, template["variable"], lo))
    template = {
        "id": "temperature",
        "variable": "t2m",
        "transforms": [
            "kelvin_to_celsius",
            {"function": "linear_convert", "params": {"scale": 2.0, "offset": 1.0, "units": "x"}},
            {"function": "floor_at", "params": {"lo": -540.0}},
        ],
    }
    return rounded(run_transforms(hourly_cube(spark, sf_dir), template), "t2m")


@query(with_views("daily") + "SELECT t, y, x, ROUND(price / 1000000, 9) AS price FROM daily")
def values_in_millions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = select_variable(daily_cube(spark, sf_dir), "price")
    return rounded(apply(cube, divide(1_000_000)), "price", digits=9)


@query(with_views("hourly") + "SELECT t, y, x, ROUND(GREATEST(t2m, 50), 6) AS t2m FROM hourly")
def clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clamp_min(hourly_cube(spark, sf_dir), "t2m", 50.0), "t2m")


@query(
    with_views("bands")
    + """SELECT t, y, x, 'band_' || CAST(DENSE_RANK() OVER (ORDER BY band) AS VARCHAR) AS band, ROUND(value, 6) AS value
         FROM bands"""
)
def renamed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band labels replaced by position."""
    return rounded(rename_labels(band_cube(spark, sf_dir), "band", [f"band_{i}" for i in range(1, 6)]), "value")


# -- aggregation in time ---------------------------------------------------


@query(
    with_views("daily")
    + """SELECT TIME_BUCKET(INTERVAL '10 days', t, TIMESTAMP '1995-01-02') AS t, y, x, ROUND(SUM(precip), 6) AS precip,
                ROUND(SUM(price), 2) AS price, ROUND(SUM(tax), 6) AS tax
         FROM daily WHERE t < (SELECT TIME_BUCKET(INTERVAL '10 days', MAX(t), TIMESTAMP '1995-01-02') FROM daily) GROUP BY 1, 2, 3"""
)
def ten_day_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-day bins from the first day of the data; the last one lacks days and is left out."""
    cube = daily_cube(spark, sf_dir)
    out = resample(cube, "10D", "sum", "1995-01-01", "2001-12-31", "daily", daily_times(spark, sf_dir))
    return rounded(rounded(out, "precip", "tax"), "price", digits=2)


@query(
    with_views("daily")
    + """SELECT DATE_TRUNC('week', t) AS t, y, x, ROUND(AVG(precip), 6) AS precip FROM daily
         WHERE t >= TIMESTAMP '1996-01-01' AND t < TIMESTAMP '2000-01-03' GROUP BY 1, 2, 3"""
)
def weekly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monday weeks; the request starts in the middle of one, which is dropped."""
    cube = precip_cube(spark, sf_dir)
    times = daily_times(spark, sf_dir)
    return rounded(resample(cube, "W-MON", "mean", "1995-12-28", "1999-12-31", "daily", times), "precip")


@query(
    with_views("daily")
    + """SELECT DATE_TRUNC('month', t) AS t, y, x, ROUND(SUM(precip), 6) AS precip FROM daily
         WHERE t >= TIMESTAMP '1995-02-01' AND t < TIMESTAMP '2001-11-01' GROUP BY 1, 2, 3"""
)
def monthly_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole months only: the data starts on 2 January 1995 and ends on 4 November 2001."""
    cube = precip_cube(spark, sf_dir)
    times = daily_times(spark, sf_dir)
    return rounded(resample(cube, "MS", "sum", "1995-01-01", "2001-12-31", "daily", times), "precip")


@query(
    with_views("daily")
    + """SELECT DATE_TRUNC('quarter', t) AS t, y, x, ROUND(MAX(precip), 6) AS precip FROM daily
         WHERE t >= TIMESTAMP '1995-04-01' AND t < TIMESTAMP '2001-10-01' GROUP BY 1, 2, 3"""
)
def quarterly_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = precip_cube(spark, sf_dir)
    times = daily_times(spark, sf_dir)
    return rounded(resample(cube, "QS", "max", "1995-01-01", "2001-12-31", "daily", times), "precip")


@query(
    with_views("daily")
    + """SELECT DATE_TRUNC('year', t) AS t, y, x, ROUND(MIN(precip), 6) AS precip FROM daily
         WHERE t >= TIMESTAMP '1996-01-01' AND t < TIMESTAMP '2001-01-01' GROUP BY 1, 2, 3"""
)
def yearly_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = precip_cube(spark, sf_dir)
    times = daily_times(spark, sf_dir)
    return rounded(resample(cube, "YS", "min", "1995-01-01", "2001-12-31", "daily", times), "precip")


@query(
    with_views("daily")
    + """SELECT TIME_BUCKET(INTERVAL '2 months', t, TIMESTAMP '1995-01-01') AS t, y, x, ROUND(SUM(precip), 6) AS precip FROM daily
         WHERE t >= TIMESTAMP '1995-03-01'
           AND t < (SELECT TIME_BUCKET(INTERVAL '2 months', MAX(t) + INTERVAL 1 DAY, TIMESTAMP '1995-01-01') FROM daily) GROUP BY 1, 2, 3"""
)
def two_month_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of two months, counted from the month of the first day."""
    cube, times = precip_cube(spark, sf_dir), daily_times(spark, sf_dir)
    return rounded(resample(cube, "2MS", "sum", "1995-01-01", "2001-12-31", "daily", times), "precip")


@query(
    with_views("daily")
    + """SELECT TIME_BUCKET(INTERVAL '14 days', t, TIMESTAMP '1995-01-02') AS t, y, x, ROUND(MAX(precip), 6) AS precip FROM daily
         WHERE t < (SELECT TIME_BUCKET(INTERVAL '14 days', MAX(t) + INTERVAL 1 DAY, TIMESTAMP '1995-01-02') FROM daily) GROUP BY 1, 2, 3"""
)
def fortnight_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of two weeks from the first Monday of the data."""
    cube, times = precip_cube(spark, sf_dir), daily_times(spark, sf_dir)
    return rounded(resample(cube, "2W-MON", "max", "1995-01-01", "2001-12-31", "daily", times), "precip")


@query(
    with_views("hourly")
    + """SELECT DATE_TRUNC('day', t) AS t, y, x, ROUND(AVG(t2m), 9) AS t2m FROM hourly GROUP BY 1, 2, 3"""
)
def hourly_to_daily_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = hourly_cube(spark, sf_dir)
    times = hourly_times(spark, sf_dir)
    # rounded late enough that means of up to 64 two-decimal values are never halves
    return rounded(resample(cube, "1D", "mean", "2024-01-01", "2024-01-31", "hourly", times), "t2m", digits=9)


@query(
    with_views("hourly")
    + """SELECT TIME_BUCKET(INTERVAL '7 hours', t, TIMESTAMP '2024-01-01') AS t, y, x, ROUND(MAX(t2m), 6) AS t2m
         FROM hourly WHERE t < TIME_BUCKET(INTERVAL '7 hours', TIMESTAMP '2024-01-30 23:00', TIMESTAMP '2024-01-01')
         GROUP BY 1, 2, 3"""
)
def seven_hour_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-hour bins do not divide a day, so they run on from the first midnight."""
    cube = hourly_cube(spark, sf_dir)
    times = hourly_times(spark, sf_dir)
    return rounded(resample(cube, "7h", "max", "2024-01-01", "2024-01-31", "hourly", times), "t2m")


@query(
    """SELECT o_orderkey, TIME_BUCKET(INTERVAL '10 days', o_orderdate, TIMESTAMP '1990-01-03') AS ten_days,
              DATE_TRUNC('week', o_orderdate) AS week_mon, DATE_TRUNC('week', o_orderdate + INTERVAL 1 DAY) - INTERVAL 1 DAY AS week_sun,
              DATE_TRUNC('month', o_orderdate) AS month, DATE_TRUNC('quarter', o_orderdate) AS quarter,
              DATE_TRUNC('year', o_orderdate) AS year, DATE_TRUNC('hour', o_orderdate) AS hour FROM orders"""
)
def bin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        bin_start(t, "10D", time("1990-01-03 15:00:00")).alias("ten_days"),
        bin_start(t, "W-MON").alias("week_mon"),
        bin_start(t, "W").alias("week_sun"),
        bin_start(t, "MS").alias("month"),
        bin_start(t, "QS").alias("quarter"),
        bin_start(t, "YS").alias("year"),
        bin_start(t, "h").alias("hour"),
    )


@query(
    with_views("hourly")
    + """SELECT DATE_TRUNC('week', t) AS t, y, x, ROUND(MIN(t2m), 6) AS t2m FROM hourly
         WHERE t < TIMESTAMP '2024-01-29' GROUP BY 1, 2, 3"""
)
def complete_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of the hourly cube, built first and then freed of incomplete edges; the last week lacks days."""
    weeks = aggregate_temporal_period(hourly_cube(spark, sf_dir), "week", "min")
    return rounded(drop_incomplete_edges(weeks, hourly_times(spark, sf_dir), "hourly", "W-MON"), "t2m")


@query(
    with_views("daily")
    + "SELECT DATE_TRUNC('month', t) AS t, y, x, ROUND(SUM(precip), 6) AS precip FROM daily GROUP BY 1, 2, 3"
)
def calendar_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate_temporal_period(precip_cube(spark, sf_dir), "month", "sum"), "precip")


@query(
    with_views("daily")
    + """SELECT DATE_TRUNC('quarter', t + INTERVAL 1 MONTH) - INTERVAL 1 MONTH AS t, y, x, ROUND(AVG(precip), 6) AS precip
         FROM (SELECT DATE_TRUNC('month', t) AS t, y, x, precip FROM daily) GROUP BY 1, 2, 3"""
)
def calendar_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate_temporal_period(precip_cube(spark, sf_dir), "season", "mean"), "precip")


@query(
    with_views("daily")
    + "SELECT DATE_TRUNC('year', t) AS t, y, x, COUNT(precip) AS precip FROM daily GROUP BY 1, 2, 3"
)
def calendar_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_temporal_period(precip_cube(spark, sf_dir), "year", "count")


# -- reducing --------------------------------------------------------------


@query(with_views("daily") + "SELECT y, x, ROUND(MAX(price) / 1000000, 9) AS price FROM daily GROUP BY 1, 2")
def scaled_time_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, rescale every value, take the maximum over time."""
    cube = select_variable(daily_cube(spark, sf_dir), "price")
    return rounded(reduce_dimension(apply(cube, divide(1_000_000)), "t", "max"), "price", digits=9)


@query(
    with_views("daily")
    + "SELECT t, ROUND(AVG(precip), 9) AS precip, ROUND(AVG(tax), 9) AS tax FROM daily GROUP BY 1"
)
def spatial_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = reduce_spatial(select.filter_bands(daily_cube(spark, sf_dir), ["precip", "tax"]), "mean")
    return rounded(means, "precip", "tax", digits=9)


@query(with_views("bands") + "SELECT t, y, x, ROUND(MAX(value), 6) AS value FROM bands GROUP BY 1, 2, 3")
def band_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_bands(band_cube(spark, sf_dir), "max"), "value")


@query(with_views("daily") + "SELECT t, x, ROUND(STDDEV_POP(precip), 6) AS precip FROM daily GROUP BY 1, 2")
def column_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_dimension(precip_cube(spark, sf_dir), "y", "std"), "precip")


@query(
    """SELECT CAST(1 AS BIGINT) AS line, COUNT(*) > 0 AS has_data, STRFTIME(MIN(l_shipdate), '%G-W%V') AS "start",
              STRFTIME(MAX(l_shipdate), '%G-W%V') AS "end", CAST(MIN(l_suppkey % 10) AS DOUBLE) AS xmin,
              CAST(MIN(FLOOR(l_suppkey / 10.0) % 10) AS DOUBLE) AS ymin, CAST(MAX(l_suppkey % 10) AS DOUBLE) AS xmax,
              CAST(MAX(FLOOR(l_suppkey / 10.0) % 10) AS DOUBLE) AS ymax
       FROM lineitem
       UNION ALL SELECT -1, FALSE, NULL, NULL, NULL, NULL, NULL, NULL"""
)
def cube_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of all shipments, and of a cube without any row."""
    items = table(spark, sf_dir, "lineitem")
    cube = items.select(F.col("l_shipdate").alias("t"), *on_grid("l_suppkey"), "l_linenumber")
    full = coverage(cube, "weekly").withColumn("line", F.lit(1).cast("bigint"))
    none = coverage(cube.filter(F.col("l_linenumber") < 0), "weekly").withColumn("line", F.lit(-1).cast("bigint"))
    return full.unionByName(none).drop("spatial_wgs84")


@query(
    with_views("daily")
    + """SELECT t, CAST(FLOOR(y / 2.0) AS BIGINT) * 2 + 0.5 AS y, CAST(FLOOR(x / 2.0) AS BIGINT) * 2 + 0.5 AS x,
                ROUND(AVG(precip), 6) AS precip FROM daily GROUP BY 1, 2, 3"""
)
def half_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    means, _ = coarsen(precip_cube(spark, sf_dir), GRID)
    return rounded(means, "precip")


@query(
    with_views("daily")
    + """, one AS (SELECT t, CAST(FLOOR(y / 2.0) AS BIGINT) AS y, CAST(FLOOR(x / 2.0) AS BIGINT) AS x, AVG(precip) AS precip
                 FROM daily GROUP BY 1, 2, 3)
         SELECT t, CAST(FLOOR(y / 2.0) AS BIGINT) * 4 + 1.5 AS y, CAST(FLOOR(x / 2.0) AS BIGINT) * 4 + 1.5 AS x,
                ROUND(AVG(precip), 6) AS precip FROM one WHERE x < 4 AND y < 4 GROUP BY 1, 2, 3"""
)
def second_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level two is built from level one; five blocks per axis leave an odd one, which is trimmed."""
    levels = build_overviews(precip_cube(spark, sf_dir), GRID, scratch_path(spark, "overviews"), levels=2)
    return rounded(spark.read.parquet(levels[-1][0]), "precip")


@query(
    with_views("daily")
    + """, one AS (SELECT t, CAST(FLOOR(y / 2.0) AS BIGINT) AS y, CAST(FLOOR(x / 2.0) AS BIGINT) AS x, AVG(precip) AS precip
                 FROM daily GROUP BY 1, 2, 3)
         SELECT 1 AS level, t, y * 2 + 0.5 AS y, x * 2 + 0.5 AS x, ROUND(precip, 6) AS precip FROM one
         UNION ALL SELECT 2, t, CAST(FLOOR(y / 2.0) AS BIGINT) * 4 + 1.5 AS y, CAST(FLOOR(x / 2.0) AS BIGINT) * 4 + 1.5 AS x,
                ROUND(AVG(precip), 6) AS precip FROM one WHERE x < 4 AND y < 4 GROUP BY 1, 2, 3, 4"""
)
def overviews_after_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both levels after values were rewritten for two months and two years were appended: only their buckets go up again."""
    cube, path = precip_cube(spark, sf_dir), scratch_path(spark, "kept-overviews")
    early, wrong = F.col("t") < "2000-01-01", F.col("t").between("1997-03-01", "1997-04-30")
    before = cube.filter(early).withColumn("precip", F.when(wrong, -1.0).otherwise(F.col("precip")))
    update_overviews(before, GRID, path, before.select("t"), levels=2)
    levels = update_overviews(cube, GRID, path, cube.filter(~early | wrong).select("t"), levels=2)
    read = [read_overview(spark, at).select(F.lit(k).alias("level"), "t", "y", "x", "precip") for k, (at, _) in enumerate(levels, 1)]
    return rounded(read[0].union(read[1]), "precip")


@query(
    """WITH axes AS (SELECT DISTINCT 't' AS axis, EPOCH(l_shipdate) AS v FROM lineitem
                     UNION SELECT DISTINCT 'x', CAST(l_suppkey % 10 AS DOUBLE) FROM lineitem
                     UNION SELECT DISTINCT 'y', FLOOR(l_suppkey / 10.0) % 10 FROM lineitem),
            gaps AS (SELECT axis, v, LEAD(v) OVER (PARTITION BY axis ORDER BY v) - v AS gap FROM axes)
       SELECT axis, CASE WHEN axis = 't' THEN 'temporal' ELSE 'spatial' END AS "type", COUNT(*) AS "size",
              MIN(v) AS low, MAX(v) AS high,
              CASE WHEN axis = 'x' THEN ROUND(MEDIAN(gap), 8) WHEN axis = 'y' THEN ROUND(-MEDIAN(gap), 8) END AS step,
              CASE WHEN axis = 't' THEN 'P1D' END AS iso_step,
              CASE WHEN axis = 't' THEN (SELECT MIN(l_shipdate) FROM lineitem) END AS "start",
              CASE WHEN axis = 't' THEN (SELECT MAX(l_shipdate) FROM lineitem) END AS "end"
       FROM gaps GROUP BY axis"""
)
def axis_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent, size and step per axis; the y axis is declared to run downwards."""
    return axis_summary(daily_rows(spark, sf_dir), "P1D", descending=("y",))


# -- combining -------------------------------------------------------------


@query(
    with_views("daily")
    + """, b AS (SELECT o_orderdate AS t, CAST(FLOOR(o_custkey / 10.0) AS BIGINT) % 10 AS y, o_custkey % 10 AS x,
                      SUM(o_totalprice) AS price, COUNT(*) AS orders FROM orders GROUP BY 1, 2, 3)
         SELECT t, y, x, ROUND(precip, 6) AS precip, ROUND(tax, 6) AS tax, b.orders,
                ROUND(CASE WHEN daily.price IS NOT NULL AND b.price IS NOT NULL THEN GREATEST(daily.price, b.price)
                      ELSE COALESCE(daily.price, b.price) END, 2) AS price
         FROM daily FULL JOIN b USING (t, y, x)"""
)
def merged_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments and orders as one cube; where both have a price the larger one is taken."""
    orders = table(spark, sf_dir, "orders")
    y = (F.floor(F.col("o_custkey") / 10.0).cast("bigint") % 10).alias("y")
    ordered = orders.groupBy(F.col("o_orderdate").alias("t"), y, (F.col("o_custkey") % 10).alias("x")).agg(
        F.sum("o_totalprice").alias("price"), F.count("*").alias("orders")
    )
    merged = merge_cubes(daily_cube(spark, sf_dir), ordered, F.greatest)
    return rounded(rounded(merged, "precip", "tax"), "price", digits=2)


OTHER_GRID_SQL = (
    with_views("daily")
    + """, cols AS (SELECT r AS i, 0.21 + r * 0.7 AS tx,
                  (SELECT x FROM (SELECT DISTINCT x FROM daily) ORDER BY ABS(x - (0.21 + r * 0.7)), x LIMIT 1) AS x FROM RANGE(13) t(r)),
         rws AS (SELECT r AS j, 8.33 - r * 1.87 AS ty,
                  (SELECT y FROM (SELECT DISTINCT y FROM daily) ORDER BY ABS(y - (8.33 - r * 1.87)), y LIMIT 1) AS y FROM RANGE(5) t(r))
         SELECT t, ROUND(ty, 6) AS y, ROUND(tx, 6) AS x, ROUND(precip, 6) AS precip
         FROM daily JOIN cols USING (x) JOIN rws USING (y)"""
)


@query(OTHER_GRID_SQL)
def other_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube on a finer axis in x and a coarser, downward one in y."""
    target = GridSpec(0.21, 0.7, 13, 8.33, -1.87, 5)
    moved = resample_cube_spatial(precip_cube(spark, sf_dir), target, cells=daily_rows(spark, sf_dir))
    return rounded(moved, "y", "x", "precip")


@query(OTHER_GRID_SQL)
def other_grid_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the grid known: the cube on a finer axis in x and a coarser, downward one in y."""
    target = GridSpec(0.21, 0.7, 13, 8.33, -1.87, 5)
    moved = resample_cube_spatial(precip_cube(spark, sf_dir), target, source=GRID)
    return rounded(moved, "y", "x", "precip")


@query(
    with_views("daily")
    + """, days AS (SELECT UNNEST(GENERATE_SERIES((SELECT MIN(t) FROM daily), (SELECT MAX(t) FROM daily), INTERVAL 1 DAY)) AS t),
         cells AS (SELECT DISTINCT y, x FROM daily)
         SELECT t, y, x, ROUND(precip, 6) AS precip FROM days CROSS JOIN cells LEFT JOIN daily USING (t, y, x)"""
)
def dense_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell on every day; days without a value show as missing."""
    span = daily_times(spark, sf_dir).agg(F.struct(F.min("t").alias("a"), F.max("t").alias("b"))).scalar()
    cells = daily_rows(spark, sf_dir).select("y", "x").distinct()
    return rounded(densify(precip_cube(spark, sf_dir), "daily", cells, span["a"], span["b"]), "precip")


@query(with_views("daily") + "SELECT t, y, x, ROUND(precip, 6) AS precip FROM daily")
def appended_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = precip_cube(spark, sf_dir)
    both = append_periods(select.filter_temporal(cube, None, "1998-05"), select.filter_temporal(cube, "1998-05", None))
    return rounded(both, "precip")


@query(
    """WITH b AS (SELECT l_suppkey, MIN(l_shipdate) AS a, MAX(l_shipdate) AS z FROM lineitem GROUP BY 1),
            spine AS (SELECT l_suppkey, UNNEST(GENERATE_SERIES(a, z, INTERVAL 1 DAY)) AS t FROM b)
       SELECT CAST(l_suppkey AS VARCHAR) AS dataset_id, t, STRFTIME(t, '%Y-%m-%d') AS period_id
       FROM spine WHERE (l_suppkey, t) NOT IN (SELECT (l_suppkey, l_shipdate) FROM lineitem)"""
)
def missing_days_per_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without a shipment between the first and last of each supplier."""
    items = table(spark, sf_dir, "lineitem")
    cube = items.select(F.col("l_suppkey").cast("string").alias("dataset_id"), F.col("l_shipdate").alias("t"))
    return find_gaps(cube, "daily", by=["dataset_id"])


# -- grids and coordinate systems ------------------------------------------

MERCATOR_X = "6378137.0 * RADIANS({0})"
MERCATOR_Y = "6378137.0 * LN(TAN(RADIANS({0}) / 2 + PI() / 4))"


@query(
    f"""SELECT c_custkey, ROUND({MERCATOR_X.format('lon')}, 3) AS mx, ROUND({MERCATOR_Y.format('lat')}, 3) AS my,
               ROUND(lon, 6) AS utm_lon, ROUND(lat, 6) AS utm_lat
        FROM (SELECT c_custkey, 12.0 + (c_custkey % 600) / 100.0 AS lon, -60 + (c_custkey % 12000) / 100.0 AS lat FROM customer)"""
)
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in Mercator, and through a UTM zone and back."""
    from gridtide.functions.crs import transform_point

    key = F.col("c_custkey")
    places = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.struct(
            (F.lit(12.0) + key % 600 / 100.0).alias("x"), (F.lit(-60) + key % 12000 / 100.0).cast("double").alias("y")
        ).alias("p"),
    )
    mercator = transform_point(F.col("p"), "EPSG:4326", "EPSG:3857")
    zone = transform_point(F.col("p"), "EPSG:4326", "EPSG:25833")
    moved = places.select("c_custkey", mercator.alias("m"), transform_point(zone, "EPSG:25833", "EPSG:4326").alias("u"))
    return moved.select(
        "c_custkey",
        F.round("m.x", 3).alias("mx"),
        F.round("m.y", 3).alias("my"),
        F.round("u.x", 6).alias("utm_lon"),
        F.round("u.y", 6).alias("utm_lat"),
    )


@query(
    with_views("daily")
    + f""", box AS (SELECT {MERCATOR_X.format('-0.5')} AS x0, {MERCATOR_X.format('9.5')} AS x1,
                           {MERCATOR_Y.format('-0.5')} AS y0, {MERCATOR_Y.format('9.5')} AS y1),
         cols AS (SELECT x0 + (x1 - x0) / 10 * (r + 0.5) AS tx,
                         CAST(ROUND(DEGREES((x0 + (x1 - x0) / 10 * (r + 0.5)) / 6378137.0)) AS BIGINT) AS x FROM box, RANGE(10) t(r)),
         rws AS (SELECT y0 + (y1 - y0) / 10 * (r + 0.5) AS ty,
                        CAST(ROUND(DEGREES(2 * ATAN(EXP((y0 + (y1 - y0) / 10 * (r + 0.5)) / 6378137.0)) - PI() / 2)) AS BIGINT) AS y
                 FROM box, RANGE(10) t(r))
         SELECT t, ROUND(ty, 3) AS y, ROUND(tx, 3) AS x, ROUND(precip, 6) AS precip
         FROM daily JOIN cols USING (x) JOIN rws USING (y)"""
)
def mercator_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degree grid on a regular Mercator grid with as many cells."""
    moved = reproject(precip_cube(spark, sf_dir), "EPSG:4326", "EPSG:3857", source_grid=GRID)
    return rounded(rounded(moved, "y", "x", digits=3), "precip")


@query(
    """SELECT c_custkey, CAST(GREATEST(1, CEIL(ROUND((c_custkey % 77) / 10.0 / 0.25, 6))) AS BIGINT) AS nx,
              CAST(GREATEST(1, CEIL(ROUND((c_custkey % 31) / 10.0 / 0.25, 6))) AS BIGINT) AS ny FROM customer"""
)
def grids_for_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells per axis of a quarter-degree grid around a box per customer."""
    wide, high = F.col("c_custkey") % 77 / 10.0, F.col("c_custkey") % 31 / 10.0
    nx, ny = grid_shape(F.lit(0.0), F.lit(0.0), wide, high, 0.25)
    return table(spark, sf_dir, "customer").select("c_custkey", nx.alias("nx"), ny.alias("ny"))


# -- extension points ------------------------------------------------------


@query(with_views("daily") + "SELECT y, x, ROUND(SUM(price) / 1000, 5) AS price FROM daily WHERE t >= TIMESTAMP '1998-01-01' GROUP BY 1, 2")
def stored_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named chain with a parameter that calls a second one and built-in processes."""
    recipes = Recipes()
    recipes.store("thousands", lambda r, data: r.run("divide", data=data, y=1000))
    recipes.store(
        "total_since",
        lambda r, data, start: r.run(
            "reduce_dimension", cube=r.run("thousands", data=select.slice_time(data, start)), dimension="t", reducer_name="sum"
        ),
    )
    cube = select_variable(daily_cube(spark, sf_dir), "price")
    return rounded(recipes.run("total_since", {"data": cube, "start": "1998"}), "price", digits=5)


@query(with_views("hourly") + "SELECT t, ROUND(MAX(t2m) - MIN(t2m), 6) AS t2m FROM hourly GROUP BY 1")
def custom_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A process of the user's own that reduces with a function instead of a name."""
    register_process("spatial_range", lambda data: reduce_spatial(data, lambda v: F.max(v) - F.min(v)))
    return rounded(process_by_name("spatial_range")(data=hourly_cube(spark, sf_dir)), "t2m")
