"""Polygons over a grid: which cells a zone holds, and statistics per zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.errors import GridError
from gridtide.functions.periods import period_id
from gridtide.functions.reducers import Reducer, reducer
from gridtide.operators.medians import weighted_median
from gridtide.schema import folded_columns, key_columns
from gridtide.session import scratch_path
from gridtide.sources.grid import GridSpec, numbered_cells

# Statistics that may be asked for, and the default.
ZONAL_STATS = ("count", "sum", "mean", "min", "max", "median", "std")
DEFAULT_STATS = ("mean",)

# Fixed value: temporal resolutions of exported values.
EXPORT_PERIODS = ("daily", "weekly", "monthly")

# Cells per side of a join tile: small enough that a tile holds few cell/zone pairs,
# large enough that a zone does not fall into many tiles.
TILE_CELLS = 16

# Halvings from the quads a zone is first laid out on to the tiles that are joined.
COVER_LEVELS = 3

# Rank error bound of the sketch that brackets a median is one part in this many.
SKETCH_ACCURACY = 10_000


def edges_of(rings: Column) -> Column:
    """Edges of all rings as ``array<struct<x1,y1,x2,y2>>``; an open ring is closed."""

    def ring_edges(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(
            ring,
            following,
            lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")),
        )

    return F.flatten(F.transform(rings, ring_edges))


def inside_rings(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule: whether a ray to the east crosses an odd number of edges. Holes need no extra care."""

    def crosses(e: Column) -> Column:
        spans = (e.y1 > y) != (e.y2 > y)
        return spans & (x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1)

    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != F.coalesce(F.when(e.y1 != e.y2, crosses(e)), F.lit(False)))


def _edges_that_matter(edges: Column, tx: Column, ty: Column, tile_x: float, tile_y: float, margin_x: float, margin_y: float) -> Column:
    """Edges of the row band of a tile that do not lie wholly to the west of it, which a ray to the east may meet."""
    return F.filter(
        edges,
        lambda e: (F.greatest(e.y1, e.y2) >= ty * tile_y - margin_y)
        & (F.least(e.y1, e.y2) <= (ty + 1) * tile_y + margin_y)
        & (F.greatest(e.x1, e.x2) >= tx * tile_x - margin_x),
    )


def touches_cell(x: Column, y: Column, half_x: float, half_y: float, edges: Column) -> Column:
    """Whether any edge meets the closed rectangle of a cell."""

    def meets(e: Column) -> Column:
        boxes = (
            (F.greatest(e.x1, e.x2) >= x - half_x)
            & (F.least(e.x1, e.x2) <= x + half_x)
            & (F.greatest(e.y1, e.y2) >= y - half_y)
            & (F.least(e.y1, e.y2) <= y + half_y)
        )
        dx, dy = e.x2 - e.x1, e.y2 - e.y1
        distance = F.abs(dx * (y - e.y1) - dy * (x - e.x1))
        return boxes & (distance <= half_x * F.abs(dy) + half_y * F.abs(dx))

    return F.exists(edges, meets)


def zone_tiles(
    zones: DataFrame, tile_x: float, tile_y: float, zone: str = "id", margin_x: float = 0.0, margin_y: float = 0.0
) -> DataFrame:
    """Each zone once per tile its box meets, with only the edges that can matter there.

    A cell's ray runs east, so a tile needs the edges of its own band of rows that do not lie
    wholly to the west. Cutting by row first keeps a large outline from being copied whole into
    every tile.
    """

    def outer(pick, first: str, second: str, agg) -> Column:
        return agg(F.transform("edges", lambda e: pick(e[first], e[second])))

    def tile(value: Column, size: float) -> Column:
        return F.floor(value / F.lit(size)).cast("bigint")

    boxed = zones.select(F.col(zone).alias("zone_id"), edges_of(F.col("rings")).alias("edges")).select(
        "zone_id",
        "edges",
        (outer(F.least, "x1", "x2", F.array_min) - margin_x).alias("x_low"),
        (outer(F.greatest, "x1", "x2", F.array_max) + margin_x).alias("x_high"),
        (outer(F.least, "y1", "y2", F.array_min) - margin_y).alias("y_low"),
        (outer(F.greatest, "y1", "y2", F.array_max) + margin_y).alias("y_high"),
    )
    rows = boxed.select(
        "zone_id",
        "edges",
        "x_low",
        "x_high",
        F.explode(F.sequence(tile(F.col("y_low"), tile_y), tile(F.col("y_high"), tile_y))).alias("ty"),
    ).withColumn(
        "edges",
        F.filter(
            "edges",
            lambda e: (F.greatest(e.y1, e.y2) >= F.col("ty") * tile_y - margin_y)
            & (F.least(e.y1, e.y2) <= (F.col("ty") + 1) * tile_y + margin_y),
        ),
    )
    tiles = rows.select(
        "zone_id",
        "edges",
        "ty",
        F.explode(F.sequence(tile(F.col("x_low"), tile_x), tile(F.col("x_high"), tile_x))).alias("tx"),
    ).withColumn(
        "edges", F.filter("edges", lambda e: F.greatest(e.x1, e.x2) >= F.col("tx") * tile_x - margin_x)
    )
    return tiles.filter(F.size("edges") > 0)


def zone_cover(
    zones: DataFrame,
    tile_x: float,
    tile_y: float,
    zone: str = "id",
    margin_x: float = 0.0,
    margin_y: float = 0.0,
    levels: int = COVER_LEVELS,
) -> DataFrame:
    """``zone_id, tx, ty, whole, edges``: the tiles of each zone; those wholly inside have no edges.

    A zone is laid out on quads of ``2 ** levels`` tiles a side first. A quad that no edge touches is inside or outside as
    a whole, by one test of its centre; only the others are cut in four and hand their edges down, each
    quarter those that matter to it. So edges are copied and tested along the outline alone, not over the area.
    """
    scale = 2**levels
    quads = zone_tiles(zones, tile_x * scale, tile_y * scale, zone, margin_x, margin_y).withColumn("whole", F.lit(False))
    none = F.slice("edges", 1, 0)
    for level in range(levels, -1, -1):
        size_x, size_y = tile_x * 2**level, tile_y * 2**level
        x, y = (F.col("tx") + 0.5) * size_x, (F.col("ty") + 0.5) * size_y
        touched = touches_cell(x, y, size_x / 2 + margin_x, size_y / 2 + margin_y, F.col("edges"))
        judged = quads.withColumn("touched", ~F.col("whole") & touched)
        judged = judged.filter(F.col("whole") | F.col("touched") | inside_rings(x, y, F.col("edges")))
        quads = judged.select("zone_id", "tx", "ty", (~F.col("touched")).alias("whole"), F.when(F.col("touched"), F.col("edges")).otherwise(none).alias("edges"))
        if level:
            quarters = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (0, 1) for i in (0, 1)])
            split = quads.select("zone_id", "whole", "edges", "tx", "ty", F.inline(quarters))
            split = split.select("zone_id", "whole", "edges", (F.col("tx") * 2 + F.col("i")).alias("tx"), (F.col("ty") * 2 + F.col("j")).alias("ty"))
            left = _edges_that_matter(F.col("edges"), F.col("tx"), F.col("ty"), size_x / 2, size_y / 2, margin_x, margin_y)
            quads = split.withColumn("edges", left).filter(F.col("whole") | (F.size("edges") > 0))
    return quads


def cells_in_zones(
    cells: DataFrame,
    zones: DataFrame,
    dx: float = 1.0,
    dy: float = 1.0,
    all_touched: bool = False,
    zone: str = "id",
    tile_cells: int = TILE_CELLS,
) -> DataFrame:
    """Pairs ``zone_id, x, y`` of every cell whose centre a zone holds; holes are respected.

    ``cells`` has one row per grid cell, so this runs once per grid and not once per time step.
    With ``all_touched`` a cell also counts if its area meets the outline. The join is on the tile
    of both sides, never of every cell with every zone; only cells of tiles that an edge touches are tested.
    """
    half_x, half_y = abs(dx) / 2, abs(dy) / 2
    tile_x, tile_y = abs(dx) * tile_cells, abs(dy) * tile_cells
    margin_x, margin_y = (half_x, half_y) if all_touched else (0.0, 0.0)
    tiles = zone_cover(zones, tile_x, tile_y, zone, margin_x, margin_y)
    x, y, edges = F.col("x").cast("double"), F.col("y").cast("double"), F.col("edges")
    tiled = cells.withColumns(
        {"tx": F.floor(x / F.lit(tile_x)).cast("bigint"), "ty": F.floor(y / F.lit(tile_y)).cast("bigint")}
    )
    hit = inside_rings(x, y, edges)
    if all_touched:
        hit = hit | touches_cell(x, y, half_x, half_y, edges)
    return tiled.join(tiles, ["tx", "ty"]).filter(F.col("whole") | hit).drop("tx", "ty", "edges", "whole")


def stored_assignment(assignment: DataFrame, path: str | None = None) -> DataFrame:
    """An assignment written to ``path``, or to the scratch folder, and read back.

    It is made once per grid and then has a known size; that of an equi-join with a filter is only guessed.
    """
    spark = assignment.sparkSession
    path = path or scratch_path(spark, "assignment")
    assignment.write.parquet(path)
    return spark.read.parquet(path)


def cell_weights(
    cells: DataFrame, zones: DataFrame, dx: float, dy: float, k: int = 4, zone: str = "id"
) -> DataFrame:
    """Share of each cell that a zone covers, from ``k`` x ``k`` sample points per cell."""
    offsets = [((i + 0.5) / k - 0.5) for i in range(k)]
    points = F.array(
        *[F.struct(F.lit(ox * dx).alias("ox"), F.lit(oy * dy).alias("oy")) for oy in offsets for ox in offsets]
    )
    samples = cells.select("x", "y", F.inline(points)).select(
        F.col("x").alias("cx"),
        F.col("y").alias("cy"),
        (F.col("x") + F.col("ox")).alias("x"),
        (F.col("y") + F.col("oy")).alias("y"),
    )
    held = cells_in_zones(samples, zones, dx, dy, zone=zone)
    shares = held.groupBy("zone_id", "cx", "cy").agg((F.count("*") / F.lit(float(k * k))).alias("weight"))
    return shares.select("zone_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "weight")


def grid_cells(cube: DataFrame) -> DataFrame:
    """Distinct cells of a cube. Where the grid is known, ``GridSpec.cells`` costs no pass over the data."""
    return cube.select("x", "y").distinct()


def aggregate_spatial(
    cube: DataFrame,
    assignment: DataFrame,
    reducer_name: str | Reducer = "mean",
    extra_dims: Sequence[str] = (),
    grid: GridSpec | None = None,
) -> DataFrame:
    """Reduce the cells of every zone per time step. ``assignment`` comes from ``cells_in_zones``.

    Cells are matched by their numbers on ``grid``, see ``numbered_cells``.
    """
    fold = reducer(reducer_name)
    dims, values = folded_columns(cube, extra_dims, drop=("x", "y"))
    keys = ["zone_id", *[k for k in dims if k != "zone_id"]]
    placed, cells = numbered_cells(cube.drop("zone_id"), assignment.select("zone_id", "x", "y"), grid)
    joined = placed.join(cells.drop("x", "y"), ["__iy", "__ix"])
    return joined.groupBy(*keys).agg(*[fold(F.col(v)).alias(v) for v in values])


def bracket(value: str) -> Column:
    """Two values around the median of a group, from a mergeable sketch whose rank error is bounded."""
    slack = 2.0 / SKETCH_ACCURACY
    return F.percentile_approx(value, F.array(F.lit(0.5 - slack), F.lit(0.5 + slack)), SKETCH_ACCURACY)


def exact_median(
    rows: DataFrame, keys: Sequence[str], value: str, around: DataFrame | None = None, out: str = "median"
) -> DataFrame:
    """Exact median per group, without bringing a group together in one task.

    ``around`` has the ``bracket`` of each group and ``total``, its number of values. Values are collapsed to
    distinct ones with counts where they lie. Those below the bracket are then summed up and those above it
    left out, so that only the few in between, two in ``SKETCH_ACCURACY`` of the group, are ranked. The error bound of the
    sketch guarantees that the median is among them; should it ever not be, the query fails.
    """
    keys = list(keys)
    if around is None:
        around = rows.groupBy(*keys).agg(F.count(value).alias("total"), bracket(value).alias("around"))
    known = rows.select(*keys, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    counted = known.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    placed = counted.alias("c").join(around.alias("s"), same).filter(F.col("v") <= F.col("around")[1])
    inside = F.when(F.col("v") >= F.col("around")[0], F.col("v")).alias("v")
    near = placed.select(*[F.col(f"c.{k}").alias(k) for k in keys], inside, "n", "total")
    near = near.groupBy(*keys, "v").agg(F.sum("n").alias("n"), F.first("total").alias("total"))
    last = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()))
    ranked = near.withColumn("last", last).withColumn("first", F.col("last") - F.col("n") + 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("v")))

    found = (at(F.floor((F.col("total") + 1) / 2)) + at(F.floor(F.col("total") / 2) + 1)) / 2
    missed = F.raise_error(F.lit("The sketch of a median missed it"))
    return ranked.groupBy(*keys).agg(F.coalesce(found, missed).alias(out))


def zonal_statistics(
    cube: DataFrame,
    assignment: DataFrame,
    value: str,
    stats: Sequence[str] = DEFAULT_STATS,
    include_nodata: bool = False,
    nodata: float | None = None,
    extra_dims: Sequence[str] = (),
    grid: GridSpec | None = None,
) -> DataFrame:
    """Statistics of one variable per zone and time step; cells are matched by their numbers on ``grid``.

    Nodata is left out unless ``include_nodata``. If ``assignment`` has a ``weight`` (from
    ``covered_shares`` or ``cell_weights``), count, sum, mean, median and std are weighted by the covered share of each cell.
    """
    unknown = [name for name in stats if name not in ZONAL_STATS]
    if unknown:
        raise GridError(f"Unknown statistics {unknown}. Known: {', '.join(ZONAL_STATS)}")
    weighted = "weight" in assignment.columns
    keys = ["zone_id", *key_columns(cube, extra_dims, drop=("x", "y", "zone_id"))]
    v = F.col(value).cast("double")
    if nodata is not None and not include_nodata:
        v = F.when(v != F.lit(float(nodata)), v)
    columns = ["zone_id", "x", "y", *(["weight"] if weighted else [])]
    placed, cells = numbered_cells(cube.drop("zone_id"), assignment.select(*columns), grid)
    rows = placed.join(cells.drop("x", "y"), ["__iy", "__ix"]).select(
        *keys, v.alias("v"), (F.col("weight") if weighted else F.lit(1.0)).alias("w")
    )
    v, w = F.col("v"), F.when(F.col("v").isNotNull(), F.col("w"))
    mean = F.sum(v * w) / F.sum(w)
    folds = {
        "count": F.coalesce(F.sum(w), F.lit(0.0)),
        "sum": F.sum(v * w),
        "mean": mean if weighted else F.avg(v),
        "min": F.min(v),
        "max": F.max(v),
        "std": F.sqrt(F.greatest(F.sum(v * v * w) / F.sum(w) - mean * mean, F.lit(0.0)))
        if weighted
        else F.stddev_pop(v),
    }
    plain = [name for name in stats if name != "median"]
    if "median" not in stats:
        return rows.groupBy(*keys).agg(*[folds[name].alias(name) for name in plain])
    # every group needs a row, also one with only missing values
    base = rows.groupBy(*keys).agg(
        *[folds[name].alias(name) for name in plain],
        F.count("v").alias("total"),
        *([] if weighted else [bracket("v").alias("around")]),
    )
    if weighted:
        median = weighted_median(rows, keys, "v", "w").alias("m")
    else:
        median = exact_median(rows, keys, "v", base.select(*keys, "total", "around")).alias("m")
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    joined = base.alias("b").join(median, same, "left")
    return joined.select(
        *[F.col(f"b.{k}").alias(k) for k in keys], *[F.col("m.median" if s == "median" else f"b.{s}").alias(s) for s in stats]
    )


def attach_statistics(
    zones: DataFrame, statistics: DataFrame, stats: Sequence[str], output_property: str = "zonal_statistics", zone: str = "id"
) -> DataFrame:
    """The zones with their statistics as one struct column."""
    packed = statistics.select(F.col("zone_id").alias(zone), F.struct(*stats).alias(output_property))
    return zones.join(packed, zone, "left")


def pivot_zones(
    zonal: DataFrame, value: str, months: Sequence[str] | None = None, names: DataFrame | None = None
) -> DataFrame:
    """Zone by month table: one decimal, missing as ``n/a``, ordered by zone name.

    Naming the months spares the job that would look them up.
    """
    month = F.date_format("t", "yyyy-MM")
    text = F.when(F.col(value).isNotNull(), F.format_string("%.1f", F.col(value)))
    labelled = zonal.select("zone_id", month.alias("month"), text.alias("text"))
    table = labelled.groupBy("zone_id").pivot("month", list(months) if months is not None else None).agg(
        F.first("text", ignorenulls=True)
    )
    wide = table.select("zone_id", *[F.coalesce(F.col(f"`{c}`"), F.lit("n/a")).alias(c) for c in table.columns[1:]])
    if names is None:
        return wide.orderBy("zone_id")
    named = wide.join(names.select(F.col("id").alias("zone_id"), "name"), "zone_id", "left")
    named = named.withColumn("name", F.coalesce("name", F.col("zone_id").cast("string")))
    return named.select("name", "zone_id", *wide.columns[1:]).orderBy("name")


def data_values(
    zonal: DataFrame,
    value: str,
    data_element: str,
    period_type: str,
    category_option_combo: str | None = None,
    attribute_option_combo: str | None = None,
) -> DataFrame:
    """Zonal values as import rows: data element, org unit, period, value, and the combos that are given."""
    if period_type not in EXPORT_PERIODS:
        raise GridError(f"Unsupported temporal resolution '{period_type}'. Supported: {', '.join(EXPORT_PERIODS)}")
    optional = {"category_option_combo": category_option_combo, "attribute_option_combo": attribute_option_combo}
    return zonal.filter(F.col(value).isNotNull()).select(
        F.lit(data_element).alias("data_element"),
        F.col("zone_id").cast("string").alias("org_unit"),
        period_id("t", period_type).alias("period"),
        F.col(value).alias("value"),
        *[F.lit(text).alias(name) for name, text in optional.items() if text is not None],
    )
