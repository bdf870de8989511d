import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridtide.errors import GridError, NotFoundError
from gridtide.functions.reducers import divide
from gridtide.operators import select
from gridtide.operators.combine import densify, find_gaps, merge_cubes
from gridtide.operators.elementwise import apply, clamp_min, kelvin_to_celsius, metres_to_mm, rename_labels, run_transforms
from gridtide.operators.reduce import axis_summary, build_overviews, coverage, overview_levels, read_overview, update_overviews, variable_summary
from gridtide.registry import Recipes, process_by_name, register_process, register_transform
from gridtide.session import scratch_path
from gridtide.sources.cube import mask_nodata, normalise_axes, read_cube, read_many, select_variable, tile_order, write_cube
from gridtide.sources.grid import GridSpec, grid_for_bbox, infer_grid


@pytest.fixture
def february(cube_of):
    return cube_of("2024-02-01", 24, range(29), "precip")


@pytest.mark.parametrize(
    "start, end, n",
    [("2024-02-01", "2024-02-10", 10), ("2024-02", "2024-02", 29), (None, "2024-02-10T00:00:00Z", 10), ("2024-02-28", None, 2), ("2025", None, 0)],
)
def test_inclusive_slice(february, start, end, n):
    assert select.slice_time(february, start, end).count() == n


def test_half_open_interval(february):
    assert select.filter_temporal(february, "2024-02-01", "2024-02-10").count() == 9


def test_cube_without_time_is_left_alone(spark):
    table = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert select.slice_time(table, "2024", "2025").count() == 1


def test_bad_dates(february):
    for text in ("2024-02-30", "yesterday", "24-1-1"):
        with pytest.raises(GridError):
            select.slice_time(february, text)


@pytest.fixture
def grid_cube(spark):
    rows = [(dt.datetime(2026, 1, 1), float(y), float(x), float(10 * y + x), 1.0) for y in range(4) for x in range(4)]
    return spark.createDataFrame(rows, "t timestamp_ntz, y double, x double, a double, b double")


def test_box_needs_both_sides_of_an_axis(grid_cube):
    assert select.filter_bbox(grid_cube, {"WEST": 1, "east": 2, "north": 0}).count() == 8
    assert select.filter_bbox(grid_cube, west=1, east=2, south=3, north=3).count() == 2
    assert select.clip_to_extent(grid_cube, (1.4, 1.6, 1.45, 1.7), 1.0, 1.0).count() == 1


def test_bands(grid_cube):
    assert select.filter_bands(grid_cube, ["b", "zz"]).columns == ["t", "y", "x", "b"]
    assert select.filter_bands(grid_cube, []).columns == grid_cube.columns
    with pytest.raises(NotFoundError, match="Available"):
        select.filter_bands(grid_cube, ["zz"])
    assert select.stack_bands(grid_cube).count() == 32
    assert select.stack_bands(grid_cube.drop("b")).columns == ["t", "y", "x", "a"]


def test_steps(february):
    assert select.first_steps(february, 5).count() == 5
    assert select.snapshot(february, 3).first()["precip"] == 3.0
    assert select.snapshot(february, 29).isEmpty()
    assert select.select_period(february, "2024-W06", "weekly").count() == 7
    with pytest.raises(GridError):
        select.select_period(february, "2024-W60", "weekly")


def test_nearest(spark, grid_cube):
    row = select.nearest_point(grid_cube, 1.5, 9.0).first()
    assert (row["x"], row["y"]) == (1.0, 3.0)
    row = select.nearest_point(grid_cube).first()
    assert (row["x"], row["y"]) == (1.0, 1.0)
    uneven = spark.createDataFrame([(v,) for v in (0.0, 0.1, 5.0, 50.0)], "x double")
    places = spark.createDataFrame([(v,) for v in (-9.0, 0.05, 0.06, 2.55, 2.56, 27.5, 27.6, 99.0)], "px double")
    found = select.nearest_on_axis(places, "px", uneven, "x", "at").orderBy("px").collect()
    assert [r["at"] for r in found] == [0.0, 0.0, 0.1, 0.1, 5.0, 5.0, 50.0, 50.0]


def test_axis_names(spark):
    one = spark.createDataFrame([(dt.datetime(2026, 1, 1), 1.0, 2.0, 3.0)], "valid_time timestamp, longitude double, latitude double, v double")
    named = normalise_axes(one)
    assert named.columns == ["t", "x", "y", "v"]
    assert named.schema["t"].dataType.typeName() == "timestamp_ntz"
    for bad in ("when timestamp, x double, y double", "time timestamp, lon double, latitude double"):
        with pytest.raises(GridError):
            normalise_axes(spark.createDataFrame([], bad))


def test_missing_values(spark):
    rows = [(5.0,), (-99999.0,), (12.0,), (float("nan"),), (None,)]
    values = mask_nodata(spark.createDataFrame(rows, "pop double"), ["pop"], -99999).collect()
    assert [r["pop"] for r in values] == [5.0, None, 12.0, None, None]


def test_units(cube_of):
    warm = kelvin_to_celsius(cube_of("2026-01-01", 1, [273.15, None, 300.0]), "value")
    assert [r["value"] if r["value"] is None else round(r["value"], 6) for r in warm.collect()] == [0.0, None, 26.85]
    assert warm.schema["value"].metadata["units"] == "degC"
    noted = cube_of("2026-01-01", 1, [0.001]).withMetadata("value", {"units": "m", "long_name": "Rain"})
    assert metres_to_mm(noted, "value").schema["value"].metadata == {"units": "mm", "long_name": "Rain"}
    assert variable_summary(metres_to_mm(noted, "value")).first()["long_name"] == "Rain"


def test_clamp_keeps_missing(cube_of):
    assert [r["value"] for r in clamp_min(cube_of("2026-01-01", 1, [-1, None, 2]), "value", 0).collect()] == [0.0, None, 2.0]


def test_transform_errors(cube_of):
    cube = cube_of("2026-01-01", 1, [1])
    template = lambda *entries: {"id": "d", "variable": "value", "transforms": list(entries)}
    assert run_transforms(cube, {"id": "d"}) is cube
    for entry, text in (
        ({"params": {}}, "no 'function'"),
        (7, "must be a name or a mapping"),
        ("no_such", "does not exist"),
        ("gridtide.errors.Nothing", "does not exist"),
        ("no.such.module.fn", "cannot be imported"),
        ("gridtide.schema.AXES", "not callable"),
    ):
        with pytest.raises(GridError, match=text):
            run_transforms(cube, template(entry))
    register_transform("plus", lambda c, t, amount: apply(c, lambda v: v + amount))
    assert run_transforms(cube, template({"function": "plus", "params": {"amount": 2}})).first()["value"] == 3.0


def test_labels(spark):
    cube = spark.createDataFrame([("b", 1.0), ("a", 2.0)], "band string, value double")
    by_order = {r["band"]: r["value"] for r in rename_labels(cube, "band", ["one", "two"]).collect()}
    assert by_order == {"two": 1.0, "one": 2.0}
    by_name = {r["band"]: r["value"] for r in rename_labels(cube, "band", ["x", "y"], ["b", "a"]).collect()}
    assert by_name == {"x": 1.0, "y": 2.0}
    with pytest.raises(GridError):
        rename_labels(cube, "band", ["x"], ["b", "a"])


def test_layout_and_pruning(spark, february):
    path = scratch_path(spark, "cube")
    write_cube(february, path, dataset_id="rain", iso_step="PT1H")
    part = read_cube(spark, path, "2024-02-10", "2024-02-11", dataset_id="rain")
    assert part.count() == 2
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "time_bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert read_cube(spark, path, "2024-02-10").count() == 29
    more = scratch_path(spark, "more")
    write_cube(february, more, dataset_id="rain_modified")
    assert read_many(spark, [path, more], "rain").count() == 29
    with pytest.raises(GridError):
        write_cube(february, path, mode="merge", dataset_id="rain")
    with pytest.raises(GridError):
        select_variable(february, "snow")


def test_merge_needs_a_rule(grid_cube):
    with pytest.raises(GridError, match="overlap"):
        merge_cubes(grid_cube, grid_cube)
    summed = merge_cubes(grid_cube.select("t", "y", "x", "a"), grid_cube.select("t", "y", "x", "a"), lambda l, r: l + r)
    assert summed.agg({"a": "sum"}).first()[0] == 2 * grid_cube.agg({"a": "sum"}).first()[0]
    assert merge_cubes(grid_cube.select("t", "y", "x", "a"), grid_cube.select("t", "y", "x", "b")).columns[-2:] == ["a", "b"]


def test_merging_matches_cells_whose_coordinates_differ_in_the_last_bit(spark):
    left = spark.createDataFrame([(0.3, 0.1, 1.0), (0.6, 0.1, 2.0)], "y double, x double, a double")
    right = spark.createDataFrame([(0.1 * 3, 0.1, 5.0), (0.1 * 6, 0.1, 6.0), (0.7, 0.1, 7.0)], "y double, x double, b double")
    for grid in (None, GridSpec(0.1, 0.1, 10, 0.1, 0.1, 10)):
        got = sorted(tuple(r) for r in merge_cubes(left, right, grid=grid).select("y", "x", "a", "b").collect())
        assert got == [(0.3, 0.1, 1.0, 5.0), (0.6, 0.1, 2.0, 6.0), (0.7, 0.1, None, 7.0)]


def test_gaps_and_dense(cube_of):
    cube = cube_of("2026-01-01", 24, [1, None, 3]).filter("value is not null")
    assert [r["period_id"] for r in find_gaps(cube, "daily").collect()] == ["2026-01-02"]
    assert [r["value"] for r in densify(cube, "daily").orderBy("t").collect()] == [1.0, None, 3.0]


def test_coverage(spark, cube_of):
    empty = cube_of("2026-01-01", 24, [1]).limit(0)
    row = coverage(empty, "daily").first()
    assert row["has_data"] is False and row["start"] is None and row["xmin"] is None
    rows = [(dt.datetime(2026, 1, 1), y, x, 1.0) for x in (100000.0, 200000.0) for y in (6500000.0, 6600000.0)]
    utm = spark.createDataFrame(rows, "t timestamp_ntz, y double, x double, temperature double")
    box = coverage(utm, "daily", "EPSG:25833").first()["spatial_wgs84"]
    assert 7 < box["xmin"] < 10 and 8 < box["xmax"] < 12 and 58 < box["ymin"] < box["ymax"] < 62
    assert coverage(utm, "daily").first()["spatial_wgs84"] is None


def test_axes(grid_cube):
    rows = {r["axis"]: r for r in axis_summary(grid_cube, "P1D", descending=("y",)).collect()}
    assert (rows["x"]["step"], rows["y"]["step"], rows["t"]["iso_step"]) == (1.0, -1.0, "P1D")


def test_grids(grid_cube):
    assert grid_for_bbox((30, -2, 31, -1)).shape == (20, 20)
    assert grid_for_bbox((30, -2, 30, -2)).shape == (1, 1)
    assert infer_grid(grid_cube).shape == (4, 4)
    assert overview_levels(GridSpec(0, 1, 2048, 0, 1, 2048)) == 0
    assert overview_levels(GridSpec(0, 1, 4096, 0, 1, 2048)) == 3
    assert overview_levels(GridSpec(0, 1, 3_000_000, 0, 1, 2)) == 8


def test_recipes(cube_of):
    cube = cube_of("2026-01-01", 1, [2_000_000.0])
    recipes = Recipes()
    recipes.store("millions", lambda r, data: r.run("divide", data=data, y=1_000_000))
    assert recipes.run("millions", {"data": cube}).first()["value"] == 2.0
    with pytest.raises(GridError, match="built-in"):
        recipes.store("divide", lambda r, data: data)
    recipes.store("loop", lambda r, data: r.run("loop", data=data))
    with pytest.raises(GridError, match="calls itself"):
        recipes.run("loop", {"data": cube})
    with pytest.raises(NotFoundError):
        recipes.run("nothing")
    register_process("half", lambda data: apply(data, divide(2)))
    assert process_by_name("half")(cube).first()["value"] == 1_000_000.0


def test_an_append_touches_only_its_own_overview_buckets(spark):
    grid, path = GridSpec(0.0, 1.0, 8, 0.0, 1.0, 6), scratch_path(spark, "levels")
    rows = [(dt.datetime(2025, 1, 1) + dt.timedelta(days=d), float(y), float(x), float(d * x + y)) for d in range(0, 200, 2) for y in range(6) for x in range(8)]
    cube = spark.createDataFrame(rows, "t timestamp_ntz, y double, x double, v double")
    old, rewritten = F.col("t") < "2025-06-01", F.col("t") == "2025-02-10"
    before = cube.filter(old).withColumn("v", F.when(rewritten, 0.0).otherwise(F.col("v")))
    update_overviews(before, grid, path, before.select("t"), levels=2)

    def files_of(level):
        read = spark.read.parquet(f"{path}/level_{level}").select("time_bucket", "_metadata.file_path")
        return {(r["time_bucket"], r["file_path"]) for r in read.distinct().collect()}

    was = [files_of(1), files_of(2)]
    levels = update_overviews(cube, grid, path, cube.filter(~old | rewritten).select("t"), levels=2)
    for k in (0, 1):
        now = files_of(k + 1)
        kept, gone = was[k] & now, was[k] - now
        assert {b for b, _ in kept} and len({b for b, _ in gone}) <= 2
        assert {b for b, _ in gone} == {b for b, _ in was[k]} & {b for b, _ in now - was[k]}
    built = build_overviews(cube, grid, scratch_path(spark, "full"), levels=2)
    for (kept_path, kept_grid), (full_path, full_grid) in zip(levels, built):
        assert kept_grid == full_grid
        columns = ["t", "y", "x", "v"]
        got, want = (sorted(tuple(r) for r in df.select(columns).collect()) for df in (read_overview(spark, kept_path), spark.read.parquet(full_path)))
        assert got == want
    assert update_overviews(cube, grid, path, cube.limit(0).select("t"), levels=2) == levels


def test_tiles_follow_a_z_shaped_curve(spark):
    cells = spark.createDataFrame([(float(x), float(y)) for y in (-1, 0, 1, 2) for x in (-1, 0, 1, 2)], "x double, y double")
    order = [(r.x, r.y) for r in cells.orderBy(tile_order((1.0, 1.0))).collect()]
    assert order[0] == (-1.0, -1.0) and order[-1] == (2.0, 2.0)
    near = [(r.x, r.y) for r in cells.filter("x >= 0 AND y >= 0 AND x < 2 AND y < 2").orderBy(tile_order((1.0, 1.0))).collect()]
    assert near == [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)]


def test_a_small_box_reads_few_row_groups_of_a_tiled_store(spark):
    import glob

    import pyarrow.parquet as pq

    cube = spark.range(200 * 200 * 20).selectExpr(
        "CAST(DATE'2026-01-01' + CAST(id % 20 AS INT) AS timestamp_ntz) AS t", "CAST(id DIV 4000 AS DOUBLE) AS y",
        "CAST(id DIV 20 % 200 AS DOUBLE) AS x", "id * 0.5 AS v",
    )
    box = (90.0, 130.0, 109.0, 149.0)  # one in a hundred cells
    shares, found = {}, {}
    for name, tile in (("tiled", (8.0, 8.0)), ("plain", None)):
        path = scratch_path(spark, name)
        write_cube(cube, path, dataset_id="rain", tile=tile, row_group_bytes=64 * 1024)
        groups = met = 0
        for file in glob.glob(f"{path}/**/*.parquet", recursive=True):
            data = pq.ParquetFile(file)
            names = [data.schema_arrow.names.index(a) for a in ("x", "y")]
            for g in range(data.metadata.num_row_groups):
                x, y = (data.metadata.row_group(g).column(c).statistics for c in names)
                groups += 1
                met += x.min <= box[2] and x.max >= box[0] and y.min <= box[3] and y.max >= box[1]
        shares[name] = met / groups
        found[name] = sorted(tuple(r) for r in read_cube(spark, path, bbox=box).select("t", "y", "x", "v").collect())
        if tile:
            assert groups > 50
    assert shares["tiled"] < 0.1
    assert found["tiled"] == found["plain"] and len(found["tiled"]) == 400 * 20
