import random

import pytest
from pyspark.sql import functions as F

from gridtide.errors import GridError
from gridtide.operators import boxes
from gridtide.operators.areas import covered_shares
from gridtide.operators.boxes import meeting_boxes
from gridtide.operators.medians import weighted_median
from gridtide.operators.regrid import reproject, resample_cube_spatial
from gridtide.operators.zones import zonal_statistics
from gridtide.sources.geometry_text import geometry_of_text, text_of_geometry
from gridtide.sources.grid import GridSpec

BOX = "xmin double, ymin double, xmax double, ymax double"
RINGS = "id string, rings array<array<struct<x:double,y:double>>>"


def pairs_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def brute_pairs(left, right):
    def usable(b):
        return None not in b and b[0] <= b[2] and b[1] <= b[3]

    out = [(i, None) for i, *b in left if not usable(b)] + [(None, j) for j, *b in right if not usable(b)]
    for i, *a in left:
        for j, *b in right:
            if usable(a) and usable(b) and a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]:
                out.append((i, j))
    return sorted(out, key=repr)


def test_boxes_of_all_sizes_meet_once(spark):
    rng = random.Random(8)

    def boxes(n):
        for i in range(n):
            x, y = rng.uniform(-180, 180), rng.uniform(-90, 90)
            w, h = (rng.choice([0, 0.001, 0.3, 2, 30, 400]) for _ in range(2))
            yield i, x, y, x + w, y + h

    left, right = list(boxes(120)), list(boxes(150))
    left += [(900, 0.0, 0.0, 1.0, 1.0), (901, None, 0.0, 1.0, 1.0), (902, 5.0, 5.0, 1.0, 9.0)]
    right += [(900, 1.0, 1.0, 2.0, 2.0), (901, -1.0, -1.0, 0.0, 0.0), (902, 1.0, 1.0, 1.0, 1.0), (903, 3.0, 3.0, 3.0, None)]
    a, b = spark.createDataFrame(left, f"a long, {BOX}"), spark.createDataFrame(right, f"b long, {BOX}")
    met = meeting_boxes(a, b, "a", "b")
    assert pairs_of(met) == brute_pairs(left, right)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pairs_of(meeting_boxes(a.limit(0), b, "a", "b")) == [(None, 903)]


def test_tiled_boxes_stay_few_and_out_of_the_driver(spark):
    sizes = [0.0, 0.3, 0.9, 1.5, 3.0, 7.0, 15.0, 31.0]
    rows = [(8 * i + j, 50.0 * i, 50.0 * j, 50.0 * i + w, 50.0 * j + h) for i, w in enumerate(sizes) for j, h in enumerate(sizes)]
    a, b = spark.createDataFrame(rows, f"a long, {BOX}"), spark.createDataFrame(rows, f"b long, {BOX}")
    met = meeting_boxes(a, b, "a", "b")
    assert pairs_of(met) == brute_pairs(rows, rows)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    # a box goes to tiles of its own level and of coarser ones: half of the pairs of sizes on each axis, on one or two tiles
    levelled = boxes._levelled(a.withColumnRenamed("a", "__l"), "l")
    levels = [(r[0], r[1]) for r in levelled.select("__lx", "__ly").distinct().collect()]
    copies = boxes._tiled(levelled, "l", levels)
    kinds = copies.groupBy("__l").agg(F.countDistinct("__kx", "__ky").alias("n")).agg(F.sum("n")).first()[0]
    assert kinds == sum(range(1, 9)) ** 2


def grid(nx=6, ny=5):
    return GridSpec(0.5, 1.0, nx, 0.5, 1.0, ny)


def zone(*rings):
    return [("z", [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings])]


def shares_of(spark, zones, spec):
    rows = covered_shares(spark.createDataFrame(zones, RINGS), spec).collect()
    assert len({(r.zone_id, r.x, r.y) for r in rows}) == len(rows)
    return {(r.x, r.y): r.weight for r in rows}


def area(ring):
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]))) / 2


def test_shares_of_a_rectangle_are_products(spark):
    got = shares_of(spark, zone([(0.25, 0.5), (3.75, 0.5), (3.75, 2.0), (0.25, 2.0)]), grid())
    wide, high = {0.5: 0.75, 1.5: 1.0, 2.5: 1.0, 3.5: 0.75}, {0.5: 0.5, 1.5: 1.0}
    assert got == pytest.approx({(x, y): a * b for x, a in wide.items() for y, b in high.items()}, abs=1e-12)


@pytest.mark.parametrize("turned", [False, True])
def test_shares_add_up_to_the_area_whichever_way_rings_run(spark, turned):
    outer = [(0.1, 0.2), (5.9, 0.7), (4.2, 4.8), (2.0, 2.2), (0.4, 4.9)]
    hole = [(3.1, 1.4), (4.3, 1.6), (3.9, 2.7)]
    island = [(3.5, 1.7), (3.9, 1.8), (3.8, 2.2)]
    rings = [r[::-1] if turned and k != 1 else r for k, r in enumerate((outer, hole, island))]
    for spec in (grid(), GridSpec(0.05, 0.1, 60, 4.95, -0.1, 50), GridSpec(3.0, 6.0, 1, 2.5, 5.0, 1)):
        got = shares_of(spark, zone(*rings), spec)
        cell = abs(spec.dx * spec.dy)
        assert sum(got.values()) * cell == pytest.approx(area(outer) - area(hole) + area(island), abs=1e-9)
        assert all(0 < w <= 1 for w in got.values())


def test_shares_beyond_the_grid_are_cut_off(spark):
    big = zone([(-50, -40), (70, -40), (70, 90), (-50, 90)], [(2, 1), (3, 1), (3, 2), (2, 2)])
    got = shares_of(spark, big, grid())
    assert len(got) == 29 and set(got.values()) == {1.0} and (2.5, 1.5) not in got
    assert shares_of(spark, zone([(8, 1), (9, 1), (9, 3)]), grid()) == {}
    assert shares_of(spark, zone([(-3, 1), (-2, 1), (-2, 3)]), grid()) == {}
    assert shares_of(spark, [("z", None), ("y", [])], grid()) == {}


def test_shares_equal_dense_sampling(spark):
    rng = random.Random(3)
    outline = [(3 + 2.7 * r * c, 2.5 + 2.4 * r * s) for r, c, s in ((rng.uniform(0.4, 1), *direction(k, 40)) for k in range(40))]
    got = shares_of(spark, zone(outline), grid())
    n, hits = 60, {}
    for cx in range(6):
        for cy in range(5):
            inside = sum(within(cx + (i + 0.5) / n, cy + (j + 0.5) / n, outline) for i in range(n) for j in range(n))
            hits[cx + 0.5, cy + 0.5] = inside / n / n
    assert all(abs(got.get(k, 0.0) - v) < 0.02 for k, v in hits.items())
    assert sum(got.values()) == pytest.approx(area(outline), abs=1e-9)


def direction(k, n):
    import math

    return math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)


def within(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def brute_median(values):
    values = sorted((v, w) for v, w in values if v is not None and w)
    half, upto = sum(w for _, w in values) / 2, 0
    for k, (v, w) in enumerate(values):
        upto += w
        if upto > half:
            return v
        if upto == half:
            above = [x for x, _ in values[k + 1 :] if x > v]
            return (v + above[0]) / 2 if above else v


def test_weighted_median_on_ties_and_zero_weights(spark):
    rng = random.Random(1)
    groups = {
        "same": [(3.0, 1.0)] * 4, "even": [(1.0, 1.0), (2.0, 1.0), (5.0, 1.0), (9.0, 1.0)], "zero": [(1.0, 0.0), (7.0, 0.25), (9.0, None)],
        "heavy": [(1.0, 0.25), (2.0, 8.0), (3.0, 0.25)], "half": [(1.0, 2.0), (4.0, 1.0), (6.0, 1.0)],
        "many": [(float(rng.randrange(3000)), rng.choice([0.25, 0.5, 1.0])) for _ in range(4000)],
        None: [(1.0, 1.0), (None, 5.0), (3.0, 1.0)],
    }
    rows = [(k, v, w) for k, g in groups.items() for v, w in g] + [("none", None, 1.0)]
    frame = spark.createDataFrame(rows, "k string, v double, w double")
    got = {r.k: r.median for r in weighted_median(frame, ["k"], "v", "w").collect()}
    assert got == {k: brute_median(g) for k, g in groups.items()}
    whole = weighted_median(frame.drop("k"), [], "v", "w").collect()
    assert whole[0].median == brute_median([r[1:] for r in rows])


def test_zonal_median_of_partly_covered_cells(spark):
    cube = spark.createDataFrame([(0.5, 0.5, 1.0), (0.5, 1.5, 2.0), (0.5, 2.5, 9.0), (1.5, 0.5, None)], "y double, x double, v double")
    shares = spark.createDataFrame([("z", 0.5, 0.5, 0.25), ("z", 1.5, 0.5, 0.25), ("z", 2.5, 0.5, 1.0), ("w", 0.5, 1.5, 1.0)], "zone_id string, x double, y double, weight double")
    got = {r.zone_id: (r.median, r["count"]) for r in zonal_statistics(cube, shares, "v", ("median", "count")).collect()}
    assert got == {"z": (9.0, 1.5), "w": (None, 0.0)}


def linear_cube(spark, spec, a, b, c, hole=None):
    cells = spec.cells(spark).select("y", "x").withColumn("v", F.col("x") * a + F.col("y") * b + c)
    return cells if hole is None else cells.withColumn("v", F.when((F.col("x") != hole[0]) | (F.col("y") != hole[1]), F.col("v")))


def test_sums_keep_the_total_and_means_the_constant(spark):
    source, target = GridSpec(0.5, 1.0, 8, 0.5, 1.0, 6), GridSpec(0.85, 1.7, 5, 5.6, -0.8, 8)
    cube = linear_cube(spark, source, 2.0, 1.0, 3.0)
    summed = resample_cube_spatial(cube, target, "sum", source=source)
    assert summed.agg(F.sum("v")).first()[0] == pytest.approx(cube.agg(F.sum("v")).first()[0], rel=1e-12)
    same = resample_cube_spatial(linear_cube(spark, source, 0.0, 0.0, 4.0, hole=(3.5, 2.5)), target, "average", source=source)
    assert {round(r.v, 9) for r in same.collect()} == {4.0}


def test_bilinear_reproduces_a_linear_field(spark):
    source, target = GridSpec(0.0, 1.0, 8, 5.0, -1.0, 6), GridSpec(0.3, 0.45, 12, 0.2, 0.9, 5)
    got = resample_cube_spatial(linear_cube(spark, source, 2.0, -3.0, 1.0), target, "bilinear", source=source).collect()
    assert len(got) == 60 and all(r.v == pytest.approx(2 * r.x - 3 * r.y + 1, abs=1e-9) for r in got)
    beyond = resample_cube_spatial(linear_cube(spark, source, 1.0, 0.0, 0.0), GridSpec(-0.4, 20.0, 2, 2.0, 1.0, 1), "bilinear", source=source)
    assert [(r.x, r.v) for r in beyond.collect()] == [(-0.4, 0.0)]


def test_missing_cells_do_not_count(spark):
    source, target = GridSpec(0.5, 1.0, 2, 0.5, 1.0, 1), GridSpec(1.0, 2.0, 1, 0.5, 1.0, 1)
    rows = [(0.5, 0.5, 4.0), (0.5, 1.5, None)]
    cube = spark.createDataFrame(rows, "y double, x double, v double")
    for method in ("average", "sum", "bilinear"):
        assert [r.v for r in resample_cube_spatial(cube, target, method, source=source).collect()] == [4.0]
    none = spark.createDataFrame([(0.5, 0.5, None), (0.5, 1.5, None)], "y double, x double, v double")
    assert [r.v for r in resample_cube_spatial(none, target, "average", source=source).collect()] == [None]
    with pytest.raises(GridError, match="Unsupported method"):
        resample_cube_spatial(cube, target, "cubic", source=source)


def test_bilinear_reprojection_of_a_constant_and_of_longitude(spark):
    source = GridSpec(0.5, 1.0, 10, 40.5, 1.0, 8)
    cube = linear_cube(spark, source, 1.0, 0.0, 0.0)
    got = reproject(cube, "EPSG:4326", "EPSG:3857", source_grid=source, method="bilinear").collect()
    assert len(got) == 80
    import math

    for r in got:
        degrees = math.degrees(r.x / 6378137.0)
        assert r.v == pytest.approx(min(max(degrees, 0.5), 9.5), abs=1e-9)


SQUARE = [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]]
HOLED = [SQUARE[0], [[0.5, 0.5], [1.0, 0.5], [1.0, 1.0]]]
TEXTS = [
    ("POLYGON ((0 0, 2 0, 2 2, 0 0))", ("Polygon", [SQUARE])),
    ("  polygon((0 0,2 0,2 2,0 0),\n( .5 0.5 , 1 5e-1, 1. 1))", ("Polygon", [HOLED])),
    ("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0)), ((0 0, 2 0, 2 2, 0 0), (0.5 0.5, 1 0.5, 1 1)))", ("MultiPolygon", [SQUARE, HOLED])),
    ("SRID=4326;POLYGON Z ((0 0 9, 2 0 9, 2 2 9, 0 0 9))", ("Polygon", [SQUARE])),
    ("POLYGON EMPTY", ("Polygon", [])),
    ("MULTIPOLYGON EMPTY ", ("MultiPolygon", [])),
] + [(bad, None) for bad in (
    None, "", "POINT (1 2)", "POLYGON", "POLYGON (0 0, 2 0, 2 2)", "POLYGON ((0 0, 2 0))", "POLYGON ((0 0, 2 0, 2 x))", "POLYGON ((0 0, 2 0, 2 2)",
    "POLYGON ((0 0, 2 0, 2 2)) x", "POLYGON ((0, 2, 2))", "POLYGON (((0 0, 2 0, 2 2)))", "MULTIPOLYGON ((0 0, 2 0, 2 2))", "POLYGON ((0 0, 2 0, 2 NaN))",
    "POLYGON ((0 0, 2 0, 2 2),)", "POLYGON (()", "POLYGON ((0 0, 1 1, 2 2), EMPTY)", "POLYGON EMPTY ((0 0))",
)]


def test_geometry_texts_are_read_level_by_level(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(TEXTS)], "k int, text string")
    got = {r.k: r.g and (r.g.type, r.g.coordinates) for r in rows.select("k", geometry_of_text(F.col("text")).alias("g")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(TEXTS)}


def test_geometries_survive_their_text(spark):
    ring = [[k / 7.0, -k * 1e-9] for k in range(60000)]
    shapes = [("Polygon", [SQUARE]), ("Polygon", [HOLED]), ("MultiPolygon", [SQUARE, HOLED]), ("MultiPolygon", []), ("Polygon", [[ring]]), None]
    kind = "struct<type:string,coordinates:array<array<array<array<double>>>>>"
    frame = spark.createDataFrame([(k, s) for k, s in enumerate(shapes)], f"k int, g {kind}")
    back = frame.select("k", geometry_of_text(text_of_geometry(F.col("g"))).alias("g")).collect()
    assert {r.k: r.g and (r.g.type, r.g.coordinates) for r in back} == dict(enumerate(shapes))
