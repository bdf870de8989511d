"""Which boxes of two tables meet: a spatial join on tiles as large as the boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = ("xmin", "ymin", "xmax", "ymax")

# Tile sizes are powers of two between these, so that a point and a box around the world both have a tile.
SMALLEST_LEVEL, LARGEST_LEVEL = -20, 40


def _level(extent: Column) -> Column:
    """Power of two that a box of this extent spans once or twice."""
    level = F.ceil(F.log2(F.greatest(extent, F.lit(2.0**SMALLEST_LEVEL)))).cast("int")
    return F.least(level, F.lit(LARGEST_LEVEL))


def usable_boxes(boxes: DataFrame) -> Column:
    """Whether a row's box can be compared: four numbers, none of them upside down."""
    numbers = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in CORNERS]
    good = (F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax"))
    for number in numbers:
        good = good & number
    return F.coalesce(good, F.lit(False))


def _levelled(boxes: DataFrame, side: str) -> DataFrame:
    x, y = (_level(F.col(f"{a}max").cast("double") - F.col(f"{a}min").cast("double")) for a in ("x", "y"))
    return boxes.withColumns({f"__{side}x": x, f"__{side}y": y})


def _tiled(boxes: DataFrame, side: str, levels: list[tuple[int, int]]) -> DataFrame:
    """Each box once for every tile it lies on, on its own level and on the coarser ones that the other side has.

    ``__kx`` and ``__ky`` are twice the level of the tiles, and one more where the right box is the coarser one, so
    that a pair of boxes has one key on each axis.
    """
    pairs = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in levels])

    def key(axis: str, other: Column) -> Column:
        own = F.col(f"__{side}{axis}")
        if side == "l":
            return F.when(other > own, other * 2 + 1).otherwise(own * 2)
        return F.when(other >= own, other * 2).otherwise(own * 2 + 1)

    keys = F.transform(pairs, lambda p: F.struct(key("x", p["x"]).alias("__kx"), key("y", p["y"]).alias("__ky")))
    rows = boxes.select(f"__{side}", *CORNERS, F.inline(F.array_distinct(keys)))
    for axis in ("x", "y"):
        low, high = (F.floor(F.col(f"{axis}{end}") / _tile_size(axis)).cast("bigint") for end in ("min", "max"))
        rows = rows.withColumn(f"__t{axis}", F.explode(F.sequence(low, high)))
    return rows


def _tile_size(axis: str) -> Column:
    return F.pow(F.lit(2.0), F.shiftright(f"__k{axis}", 1))


def meeting_boxes(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Pairs ``(left_id, right_id)`` of all boxes that meet; touching counts as meeting.

    Both tables have the id and ``xmin``, ``ymin``, ``xmax``, ``ymax``. A box lies on at most two tiles an axis of
    a size near its own, and a pair of sizes uses the tiles of the larger, so boxes of very different sizes do not
    crowd one tile. A pair is kept only on the tile of the lower corner of what both share, which gives each pair
    once. Spark takes the tiled tables for as small as the given ones, hence the hint: neither is to pass through the
    driver. A box with a missing or upside-down coordinate meets everything, as far as anybody can say: it comes out
    once, with a null partner. The number of sizes in use is read first; it is bounded by the number of levels.
    """
    tables = []
    for boxes, key, side in ((left, left_id, "l"), (right, right_id, "r")):
        one = boxes.select(F.col(key).alias(f"__{side}"), *[F.col(c).cast("double").alias(c) for c in CORNERS])
        tables.append(_levelled(one.filter(usable_boxes(one)), side))
    sizes = [t.select(f"__{s}x", f"__{s}y").distinct() for t, s in zip(tables, "lr")]
    found = sizes[0].select(F.lit(0).alias("s"), "*").union(sizes[1].select(F.lit(1).alias("s"), "*")).collect()
    levels = [[(r[1], r[2]) for r in found if r[0] == s] for s in (0, 1)]
    no_box = [
        b.filter(~usable_boxes(b)).select(*(F.col(k).alias(k) if k == key else F.lit(None).cast(t).alias(k) for k, t in kinds))
        for b, key in ((left, left_id), (right, right_id))
        for kinds in [[(left_id, left.schema[left_id].dataType), (right_id, right.schema[right_id].dataType)]]
    ]
    rest = no_box[0].union(no_box[1])
    if not levels[0] or not levels[1]:
        return rest
    a = _tiled(tables[0], "l", levels[1])
    b = _tiled(tables[1], "r", levels[0])
    key = ["__kx", "__ky", "__tx", "__ty"]
    renamed = b.select(*key, "__r", *[F.col(c).alias(f"__{c}") for c in CORNERS])
    here = F.lit(True)
    for axis in ("x", "y"):
        corner = F.greatest(F.col(f"{axis}min"), F.col(f"__{axis}min"))
        overlap = (F.col(f"{axis}min") <= F.col(f"__{axis}max")) & (F.col(f"{axis}max") >= F.col(f"__{axis}min"))
        here = here & overlap & (F.floor(corner / _tile_size(axis)).cast("bigint") == F.col(f"__t{axis}"))
    pairs = a.hint("merge").join(renamed, key).filter(here)
    return pairs.select(F.col("__l").alias(left_id), F.col("__r").alias(right_id)).union(rest)
