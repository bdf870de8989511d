import datetime as dt
import json
import statistics

import pytest
from pyspark.sql import functions as F

from gridtide.errors import GridError
from gridtide.functions.crs import normalise_crs, transform_xy
from gridtide.operators import zones as z
from gridtide.operators.combine import densify
from gridtide.operators.reduce import build_overviews, coarsen, reduce_dimension
from gridtide.operators.regrid import reproject, resample_cube_spatial
from gridtide.operators.resample import aggregate_temporal_period
from gridtide.session import scratch_path
from gridtide.sources.features import read_features, read_observations
from gridtide.sources.grid import GridSpec, grid_for_bbox
from gridtide.sources.sinks import csv_table, geojson_lines, save_result, zones_to_table

SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]
FAR = [[10, 0], [12, 0], [12, 2], [10, 2], [10, 0]]


@pytest.fixture
def features(spark, tmp_path):
    def feature(name, geometry, **extra):
        return {"type": "Feature", "properties": {"id": name, "name": name.upper()}, "geometry": geometry, **extra}

    document = {
        "type": "FeatureCollection",
        "features": [
            feature("holed", {"type": "Polygon", "coordinates": [SQUARE, HOLE]}),
            feature("multi", {"type": "MultiPolygon", "coordinates": [[HOLE], [FAR]]}, id="m1"),
            feature("triangle", {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [0, 4], [0, 0]]]}),
        ],
    }
    path = tmp_path / "zones.geojson"
    path.write_text(json.dumps(document, indent=1))
    return read_features(spark, str(path))


@pytest.fixture
def grid(spark):
    return grid_for_bbox((0, 0, 13, 5), 1.0)


def test_features(features):
    rows = {r["id"]: r for r in features.collect()}
    assert set(rows) == {"holed", "m1", "triangle"} and rows["m1"]["name"] == "MULTI"
    assert len(rows["holed"]["rings"]) == 2 and rows["m1"]["geometry"]["type"] == "MultiPolygon"


def test_cells(spark, features, grid):
    def cells(**options):
        pairs = z.cells_in_zones(grid.cells(spark), features, 1.0, 1.0, **options).collect()
        found = {}
        for r in pairs:
            found.setdefault(r["zone_id"], set()).add((r["x"], r["y"]))
        return found

    ring = {(x + 0.5, y + 0.5) for x in range(4) for y in range(4)} - {(x + 0.5, y + 0.5) for x in (1, 2) for y in (1, 2)}
    for tile in (1, 3, 16):
        found = cells(tile_cells=tile)
        assert found["holed"] == ring
        assert found["m1"] == {(x + 0.5, y + 0.5) for x in (1, 2) for y in (1, 2)} | {(x + 0.5, y + 0.5) for x in (10, 11) for y in (0, 1)}
        assert found["triangle"] == {(x + 0.5, y + 0.5) for x in range(4) for y in range(4) if x + y + 1 < 4}
    touched = cells(all_touched=True)
    assert touched["m1"] >= {(0.5, 0.5), (3.5, 3.5), (9.5, 2.5)} and (5.5, 0.5) not in touched["m1"]


def test_random_polygons_against_brute_force(spark, grid):
    import math
    import random

    rng = random.Random(5)
    shapes = {}
    for i in range(12):
        cx, cy, n = rng.uniform(0, 13), rng.uniform(0, 5), rng.randint(3, 9)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        shapes[str(i)] = [(cx + rng.uniform(0.5, 4) * math.cos(a), cy + rng.uniform(0.5, 4) * math.sin(a)) for a in turns]
    table = spark.createDataFrame([(k, [v]) for k, v in shapes.items()], "id string, rings array<array<struct<x:double,y:double>>>")

    def inside(px, py, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    centres = [(x + 0.5, y + 0.5) for x in range(13) for y in range(5)]
    expected = {(k, x, y) for k, ring in shapes.items() for x, y in centres if inside(x, y, ring)}
    got = z.cells_in_zones(grid.cells(spark), table, 1.0, 1.0, tile_cells=2).collect()
    assert {(r["zone_id"], r["x"], r["y"]) for r in got} == expected


def test_weights(spark, features, grid):
    shares = {(r["zone_id"], r["x"], r["y"]): r["weight"] for r in z.cell_weights(grid.cells(spark), features, 1.0, 1.0, k=4).collect()}
    assert shares[("holed", 0.5, 0.5)] == 1.0 and ("holed", 1.5, 1.5) not in shares
    assert 0.3 < shares[("triangle", 1.5, 2.5)] < 0.7


def test_median_of_skewed_and_tiny_groups(spark):
    import random

    rng = random.Random(1)
    groups = {"big": [rng.gauss(0, 1) for _ in range(30_000)], "same": [7.0] * 5000 + [8.0], "two": [1.0, 2.0], "one": [3.0]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("none", None), ("two", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r["median"] for r in z.exact_median(table, ["g"], "v").collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}


@pytest.fixture
def small(spark):
    day = dt.datetime(2026, 1, 1)
    rows = [(day, 0.0, 0.0, 1.0), (day, 0.0, 1.0, -9.0), (day, 1.0, 0.0, 3.0), (day, 1.0, 1.0, None)]
    held = [("a", 0.0, 0.0), ("a", 1.0, 0.0), ("a", 0.0, 1.0), ("b", 1.0, 1.0)]
    cube = spark.createDataFrame(rows, "t timestamp_ntz, y double, x double, v double")
    return cube, spark.createDataFrame(held, "zone_id string, x double, y double")


def test_statistics(small):
    cube, held = small
    row = {r["zone_id"]: r for r in z.zonal_statistics(cube, held, "v", z.ZONAL_STATS, nodata=-9).collect()}
    a = row["a"]
    assert (a["count"], a["sum"], a["mean"], a["min"], a["max"], a["median"], a["std"]) == (2.0, 4.0, 2.0, 1.0, 3.0, 2.0, 1.0)
    assert row["b"]["count"] == 0.0 and row["b"]["mean"] is None and row["b"]["median"] is None
    kept = z.zonal_statistics(cube, held, "v", nodata=-9, include_nodata=True).filter("zone_id = 'a'").first()
    assert round(kept["mean"], 6) == round(-5 / 3, 6)
    with pytest.raises(GridError, match="Unknown statistics"):
        z.zonal_statistics(cube, held, "v", ["mode"])
    halves = z.zonal_statistics(cube, held.withColumn("weight", F.lit(0.5)), "v", ["median"]).collect()
    assert {r["zone_id"]: r["median"] for r in halves} == {"a": 1.0, "b": None}


def test_month_table_and_import_rows(spark):
    rows = [("a", dt.datetime(2026, 1, 1), 1.26), ("a", dt.datetime(2026, 2, 1), 2.0), ("b", dt.datetime(2026, 2, 1), None)]
    zonal = spark.createDataFrame(rows, "zone_id string, t timestamp_ntz, v double")
    names = spark.createDataFrame([("a", "Zulu"), ("b", "Alpha")], "id string, name string")
    found = [tuple(r) for r in z.pivot_zones(zonal, "v", ["2026-01", "2026-02"], names).collect()]
    assert found == [("Alpha", "b", "n/a", "n/a"), ("Zulu", "a", "1.3", "2.0")]
    out = z.data_values(zonal, "v", "RAIN", "monthly")
    assert out.columns == ["data_element", "org_unit", "period", "value"] and out.count() == 2
    with pytest.raises(GridError):
        z.data_values(zonal, "v", "RAIN", "yearly")


def test_sinks(spark, features):
    zonal = spark.createDataFrame([("holed", 1.5), ("m1", None)], "zone_id string, v double")
    table = zones_to_table(zonal, features)
    parsed = [json.loads(r["value"]) for r in geojson_lines(table).collect()]
    by_id = {f["properties"]["zone_id"]: f for f in parsed}
    assert by_id["holed"]["geometry"]["coordinates"][1] == [[float(v) for v in p] for p in HOLE]
    assert by_id["m1"]["geometry"]["type"] == "MultiPolygon" and by_id["m1"]["properties"]["v"] is None
    assert csv_table(table.withColumn("level_1", F.lit(1))).columns == ["zone_id", "v"]
    path = scratch_path(spark, "out")
    assert save_result(table, path + "a", "unheard-of") == "GEOJSON"
    assert save_result(table, path + "b", "Parquet") == "PARQUET" and "geometry" in spark.read.parquet(path + "b").columns
    again = read_features(spark, path + "a", id_property="zone_id", lines=True)
    assert {r["id"] for r in again.collect()} == {"holed", "m1"}
    with pytest.raises(GridError, match="Known formats: CSV, PARQUET"):
        save_result(zonal, path + "c", "png")


def test_observations(spark, tmp_path):
    path = tmp_path / "obs.csv"
    path.write_text('id,stn_id,datetime,value,lat,long\n1,35,"2001-10-30T14:24:55Z",89.9,45,-75\n')
    row = read_observations(spark, str(path)).first()
    assert (row["datetime"], row["value"], row["long"]) == (dt.datetime(2001, 10, 30, 14, 24, 55), 89.9, -75.0)


def test_overviews(spark):
    day = dt.datetime(2026, 1, 1)
    rows = [(day, float(y), float(x), float(x)) for y in range(5) for x in range(5) if (x, y) != (0, 0)]
    cube = spark.createDataFrame(rows, "t timestamp_ntz, y double, x double, v double")
    grid = GridSpec(0.0, 1.0, 5, 0.0, 1.0, 5)
    means, coarse = coarsen(cube, grid)
    values = {(r["x"], r["y"]): r["v"] for r in means.collect()}
    assert coarse.shape == (2, 2) and len(values) == 4
    assert round(values[(0.5, 0.5)], 6) == round(2 / 3, 6) and values[(2.5, 0.5)] == 2.5
    levels = build_overviews(cube, grid, scratch_path(spark, "levels"), levels=2)
    assert [g.shape for _, g in levels] == [(2, 2), (1, 1)] and spark.read.parquet(levels[1][0]).count() == 1


@pytest.mark.parametrize("code", ["EPSG:3857", "EPSG:32633", "EPSG:32733", "EPSG:25833"])
def test_there_and_back(spark, code):
    lat = -33.3 if code == "EPSG:32733" else 59.1
    x, y = transform_xy(F.lit(12.5), F.lit(lat), "EPSG:4326", code)
    bx, by = transform_xy(x, y, code, "EPSG:4326")
    row = spark.range(1).select(bx.alias("x"), by.alias("y"), x.alias("e")).first()
    assert abs(row["x"] - 12.5) < 1e-9 and abs(row["y"] - lat) < 1e-9


def test_central_meridian_and_other_systems(spark):
    x, y = transform_xy(F.lit(15.0), F.lit(0.0), "EPSG:4326", "EPSG:32633")
    row = spark.range(1).select(F.round(x, 6).alias("x"), F.round(y, 6).alias("y")).first()
    assert (row["x"], row["y"]) == (500000.0, 0.0)
    for code in ("EPSG:2154", "EPSG:32661", "EPSG:25840"):
        with pytest.raises(GridError, match="Unsupported CRS"):
            normalise_crs(code)


def test_regrid(spark):
    rows = [(dt.datetime(2026, 1, 1), float(y), float(x), 10.0 * y + x) for y in range(50, 60) for x in range(10, 20)]
    cube = spark.createDataFrame(rows, "t timestamp_ntz, y double, x double, v double")
    assert reproject(cube, "EPSG:4326", "epsg:4326") is cube
    moved = reproject(cube, "EPSG:4326", "EPSG:32633")
    assert 0 < moved.count() <= 100 and moved.agg(F.min("v"), F.max("v")).first()[0] >= 510.0
    near = resample_cube_spatial(cube, GridSpec(10.2, 1.0, 3, 50.0, 4.0, 2))
    assert sorted(r["v"] for r in near.collect()) == [510.0, 511.0, 512.0, 550.0, 551.0, 552.0] or near.count() == 6
    with pytest.raises(GridError):
        resample_cube_spatial(cube, GridSpec(0, 1, 1, 0, 1, 1), "cubic")


def test_cells_of_a_fractional_grid_are_not_lost(spark):
    grid = GridSpec(0.1, 0.1, 10, 0.0, 1.0, 1)
    day = dt.datetime(2026, 1, 1)
    # coordinates as a file has them, from decimal texts
    cube = spark.createDataFrame([(day, 0.0, float(f"{(n + 1) / 10:.1f}"), 1.0) for n in range(10)], "t timestamp_ntz, y double, x double, v double")
    ring = [(0.0, -1.0), (2.0, -1.0), (2.0, 1.0), (0.0, 1.0)]
    zone = spark.createDataFrame([("a", [ring])], "id string, rings array<array<struct<x:double,y:double>>>")
    held = z.cells_in_zones(grid.cells(spark), zone, 0.1, 1.0)
    assert z.aggregate_spatial(cube, held, "sum").first()["v"] == 10.0
    assert z.zonal_statistics(cube, held, "v", ["count"]).first()["count"] == 10.0
    assert z.zonal_statistics(cube, held.select("zone_id", F.col("x") + 0.0, "y").toDF("zone_id", "x", "y"), "v", ["sum"], grid=grid).first()["sum"] == 10.0
    assert densify(cube, "daily", grid.cells(spark)).filter("v IS NULL").count() == 0
    plain = spark.createDataFrame([(0.1 * (n + 1), 0.0) for n in range(10)], "x double, y double")
    assert z.aggregate_spatial(cube, z.cells_in_zones(plain, zone, 0.1, 1.0), "sum").first()["v"] == 10.0


def test_zones_stay_apart_in_later_steps(spark):
    day = dt.datetime(2026, 1, 1)
    rows = [(zone, day + dt.timedelta(days=n), float(v)) for zone, v in ((1, 1), (2, 10)) for n in range(31)]
    cube = spark.createDataFrame(rows, "zone_id int, t timestamp_ntz, v double")
    month = aggregate_temporal_period(cube, "month", "sum")
    assert {r["zone_id"]: r["v"] for r in month.collect()} == {1: 31.0, 2: 310.0}
    assert {r["zone_id"]: r["v"] for r in reduce_dimension(cube, "t", "max").collect()} == {1: 1.0, 2: 10.0}
    with pytest.raises(GridError, match="station"):
        aggregate_temporal_period(cube.withColumn("station", F.lit("s")), "month", "sum")


def test_statistics_scan_the_cube_twice_at_most(spark, small, tmp_path):
    cube, held = small
    cube.write.parquet(f"{tmp_path}/cube")
    stats = z.zonal_statistics(spark.read.parquet(f"{tmp_path}/cube"), held, "v", z.ZONAL_STATS)
    plan = stats._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") <= 4  # base and counted values, base once more for the median


def star(k, n, cx, cy, size):
    """An outline of many points around a centre, with bays."""
    import math

    angles = [2 * math.pi * i / n for i in range(n)]
    return [{"x": cx + size * (0.7 + 0.3 * math.sin(k * a)) * math.cos(a), "y": cy + size * (0.7 + 0.3 * math.sin(k * a)) * math.sin(a)} for a in angles]


@pytest.mark.parametrize("all_touched", [False, True])
def test_a_cover_gives_the_same_cells_as_its_tiles(spark, all_touched):
    hole = [{"x": x, "y": y} for x, y in ((-20.0, -20.0), (20.3, -20.0), (20.3, 19.1))]
    rows = [("a", [star(5, 300, 3.3, -7.7, 90.0), hole]), ("b", [star(3, 40, 60.0, 60.0, 30.0), star(4, 50, -70.0, -60.0, 20.0)]), ("c", [star(2, 9, 0.0, 0.0, 3.0)])]
    zones = spark.createDataFrame(rows, "id string, rings array<array<struct<x:double,y:double>>>")
    cells = GridSpec(-99.5, 1.0, 200, -99.5, 1.0, 200).cells(spark).select("x", "y")
    tiles = z.zone_tiles(zones, 4.0, 4.0, margin_x=0.5 * all_touched, margin_y=0.5 * all_touched)
    placed = cells.withColumns({"tx": F.floor(F.col("x") / 4).cast("bigint"), "ty": F.floor(F.col("y") / 4).cast("bigint")}).join(tiles, ["tx", "ty"])
    hit = z.inside_rings(F.col("x"), F.col("y"), F.col("edges"))
    if all_touched:
        hit = hit | z.touches_cell(F.col("x"), F.col("y"), 0.5, 0.5, F.col("edges"))
    want = {tuple(r) for r in placed.filter(hit).select("zone_id", "x", "y").collect()}
    got = z.cells_in_zones(cells, zones, all_touched=all_touched, tile_cells=4).select("zone_id", "x", "y").collect()
    assert len(got) == len(want) > 10000 and {tuple(r) for r in got} == want


def test_only_cells_along_a_long_outline_are_tested(spark):
    zones = spark.createDataFrame([("a", [star(7, 20000, 0.0, 0.0, 480.0)])], "id string, rings array<array<struct<x:double,y:double>>>")
    cover = z.zone_cover(zones, 16.0, 16.0).groupBy("whole").agg(F.count("*").alias("tiles"), F.sum(F.size("edges")).alias("edges"))
    found = {r.whole: (r.tiles, r.edges) for r in cover.collect()}
    assert found[True][1] == 0 and found[False][0] < 0.6 * found[True][0]
    flat = z.zone_tiles(zones, 16.0, 16.0).agg(F.sum(F.size("edges"))).first()[0]
    assert found[False][1] < 0.5 * flat
