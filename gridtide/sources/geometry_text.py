"""Polygons written as text: ``POLYGON ((x y, ...), ...)`` and ``MULTIPOLYGON (((...)), ...)``, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two kinds, as the text and as the geometry column have them.
KINDS = {"POLYGON": "Polygon", "MULTIPOLYGON": "MultiPolygon"}
NUMBER = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
HEAD = r"(?i)^\s*(?:SRID=[0-9]+;)?\s*(MULTIPOLYGON|POLYGON)\s*(?:ZM|Z|M)?\s*(EMPTY\s*$|\()"
COORDINATES = "array<array<array<array<double>>>>"


def geometry_of_text(text: Column) -> Column:
    """``struct<type, coordinates>`` of a polygon or of several, holes included, as feature tables have it.

    Commas and parentheses are cut apart level by level, so the length of a text does not matter. Only the first two numbers
    of a point are kept. An empty geometry has no coordinates in it; a text that is malformed or of another kind, and a null,
    give null.
    """
    kind = F.upper(F.regexp_extract(text, HEAD, 1))
    tight = F.regexp_replace(F.regexp_replace(text, r"^[^(]*", ""), r"\s*([(),])\s*", "$1")
    nested = F.when(kind == "POLYGON", F.concat(F.lit("("), tight, F.lit(")"))).otherwise(tight)
    framed = nested.startswith("(((") & nested.endswith(")))")
    inner = F.substring(nested, F.lit(4), F.length(nested) - 6)
    points = F.transform(
        F.split(inner, r"\)\),\(\("),
        lambda polygon: F.transform(
            F.split(polygon, r"\),\("), lambda ring: F.transform(F.split(ring, ","), lambda point: F.split(point, r"\s+"))
        ),
    )

    def is_point(numbers: Column) -> Column:
        return F.size(numbers).between(2, 4) & F.forall(numbers, lambda n: n.rlike(NUMBER))

    sound = F.forall(points, lambda rings: F.forall(rings, lambda ring: (F.size(ring) >= 3) & F.forall(ring, is_point)))
    numbers = F.transform(
        points,
        lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.transform(F.slice(p, 1, 2), lambda n: n.try_cast("double")))),
    )
    named = F.when(kind == "POLYGON", KINDS["POLYGON"]).otherwise(KINDS["MULTIPOLYGON"]).alias("type")
    empty = F.struct(named, F.array().cast(COORDINATES).alias("coordinates"))
    whole = F.struct(named, numbers.alias("coordinates"))
    is_empty = F.upper(F.regexp_extract(text, HEAD, 2)).startswith("EMPTY")
    return F.when(kind == "", F.lit(None)).when(is_empty, empty).when(framed & sound, whole)


def text_of_geometry(geometry: Column) -> Column:
    """The text of a geometry column; null where there is none."""

    def listed(items: Column, write) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(items, write), ", "), F.lit(")"))

    def point(p: Column) -> Column:
        return F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))

    def polygon(rings: Column) -> Column:
        return listed(rings, lambda ring: listed(ring, point))

    coordinates = geometry["coordinates"]
    single = geometry["type"] == KINDS["POLYGON"]
    kind = F.when(single, F.lit("POLYGON ")).otherwise(F.lit("MULTIPOLYGON "))
    body = F.when(single, polygon(F.get(coordinates, F.lit(0)))).otherwise(listed(coordinates, polygon))
    return F.when(coordinates.isNotNull(), F.concat(kind, F.when(F.size(coordinates) == 0, F.lit("EMPTY")).otherwise(body)))
