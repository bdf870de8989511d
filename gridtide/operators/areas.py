"""How much of each grid cell a polygon covers, exactly.

Edges are cut at the borders of the cells. A piece of an edge covers the part of its own cell to its right,
and all cells of the row further to the right in full; with the sign of its direction these add up to the area
of the polygon in each cell. Only cells that an edge meets are summed up; the cells between them are filled
from the running total of their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.operators.zones import edges_of, inside_rings
from gridtide.sources.grid import AXIS_ORIGIN, AXIS_STEP, GridSpec

# Shares of a cell below this are what is left of sums of floating-point numbers, not area.
LEAST_SHARE = 1e-11


def _signed_edges(zones: DataFrame, grid: GridSpec, zone: str) -> DataFrame:
    """``zone_id, sign, u1, v1, u2, v2``: edges in units of cells, with the sign that makes the area to their right count.

    A ring inside an odd number of other rings is a hole.
    """
    u0, v0 = grid.x0 - grid.dx / 2, grid.y0 - grid.dy / 2

    def scaled(ring: Column) -> Column:
        return F.transform(
            ring,
            lambda p: F.struct(
                ((p.x.cast("double") - u0) / F.lit(grid.dx)).alias("x"), ((p.y.cast("double") - v0) / F.lit(grid.dy)).alias("y")
            ),
        )

    rings = zones.select(F.col(zone).alias("zone_id"), F.transform("rings", scaled).alias("rings"))
    single = rings.select("zone_id", "rings", F.posexplode("rings").alias("at", "ring")).filter(F.size("ring") > 2)
    others = F.filter("rings", lambda r, i: i != F.col("at"))
    middle = [(F.col("ring")[0][c] + F.col("ring")[1][c]) / 2 for c in ("x", "y")]
    single = single.select(
        "zone_id",
        inside_rings(middle[0], middle[1], edges_of(others)).alias("hole"),
        edges_of(F.array("ring")).alias("edges"),
    )
    turn = F.aggregate("edges", F.lit(0.0), lambda s, e: s + (e.x1 * e.y2 - e.x2 * e.y1))
    sign = F.when(turn > 0, -1.0).otherwise(1.0) * F.when(F.col("hole"), -1.0).otherwise(1.0)
    return single.select("zone_id", sign.alias("sign"), F.inline("edges")).toDF("zone_id", "sign", "u1", "v1", "u2", "v2")


def _between(value: Column, low: Column | None, high: Column) -> Column:
    """Value held within a range; without ``low`` it is open downwards."""
    return F.least(value if low is None else F.greatest(value, low), high)


def covered_shares(zones: DataFrame, grid: GridSpec, zone: str = "id") -> DataFrame:
    """``zone_id, x, y, weight``: the share of each cell of ``grid`` that a zone covers, where there is any.

    ``zones`` has ``rings`` as ``cells_in_zones`` takes them; rings must not cross themselves or each other. Holes are
    rings within rings, whichever way they run, open rings are closed, and parts beyond the grid are cut off. A zone
    without rings or beside the grid has no row.
    """
    edges = _signed_edges(zones, grid, zone).filter("v1 <> v2")
    low, high = F.least("v1", "v2"), F.greatest("v1", "v2")
    first = F.greatest(F.floor(low), F.lit(0)).cast("bigint")
    last = F.least(F.floor(high), F.lit(grid.ny - 1)).cast("bigint")
    in_grid = edges.filter((high > 0) & (low < grid.ny) & (F.least("u1", "u2") < grid.nx))
    rows = in_grid.withColumn("iy", F.explode(F.sequence(first, last)))
    va, vb = (_between(F.col(v), F.col("iy").cast("double"), F.col("iy") + 1.0) for v in ("v1", "v2"))
    slope = (F.col("u2") - F.col("u1")) / (F.col("v2") - F.col("v1"))
    ends = [F.col("u1") + (v - F.col("v1")) * slope for v in (va, vb)]
    rows = rows.select("zone_id", "iy", (F.col("sign") * (vb - va)).alias("dv"), *[e.alias(n) for e, n in zip(ends, ("ua", "ub"))])
    rows = rows.filter("dv <> 0")

    def column_of(u: Column) -> Column:
        return F.least(F.greatest(F.floor(u).cast("bigint"), F.lit(-1)), F.lit(grid.nx))

    cut = rows.withColumn("ix", F.explode(F.sequence(column_of(F.least("ua", "ub")), column_of(F.greatest("ua", "ub")))))
    left, right = F.when(F.col("ix") >= 0, F.col("ix").cast("double")).otherwise(F.lit(float("-inf"))), F.col("ix") + 1.0
    uc, ud = (_between(F.col(u), left, right) for u in ("ua", "ub"))
    part = F.when(F.col("ua") == F.col("ub"), F.lit(1.0)).otherwise((ud - uc) / (F.col("ub") - F.col("ua")))
    pieces = cut.filter(F.col("ix") < grid.nx).select("zone_id", "iy", "ix", (F.col("dv") * part).alias("dv"), (right - (uc + ud) / 2).alias("to_right"))
    own = F.when(F.col("ix") >= 0, F.col("dv") * F.col("to_right")).otherwise(0.0)
    met = pieces.groupBy("zone_id", "iy", "ix").agg(F.sum(own).alias("own"), F.sum("dv").alias("beyond"))
    along = Window.partitionBy("zone_id", "iy").orderBy("ix")
    total = F.sum("beyond").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = met.select(
        "zone_id", "iy", "ix", "own", "beyond", total.alias("total"), F.lead("ix", 1, grid.nx).over(along).alias("next")
    )
    filled = F.when(
        (F.abs("total") > LEAST_SHARE) & (F.col("next") > F.col("ix") + 1), F.sequence(F.col("ix") + 1, F.col("next") - 1)
    ).otherwise(F.array().cast("array<bigint>"))
    here = F.struct(F.col("ix"), (F.col("own") + F.col("total") - F.col("beyond")).alias("weight"))
    cells = F.concat(F.array(here), F.transform(filled, lambda i: F.struct(i.alias("ix"), F.col("total").alias("weight"))))
    shares = placed.select("zone_id", "iy", F.inline(cells)).filter((F.col("ix") >= 0) & (F.col("weight") > LEAST_SHARE))
    return shares.select(
        "zone_id",
        grid.x_at(F.col("ix")).alias("x", metadata={AXIS_ORIGIN: grid.x0, AXIS_STEP: grid.dx}),
        grid.y_at(F.col("iy")).alias("y", metadata={AXIS_ORIGIN: grid.y0, AXIS_STEP: grid.dy}),
        F.least("weight", F.lit(1.0)).alias("weight"),
    )
