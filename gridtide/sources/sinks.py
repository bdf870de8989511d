"""Result files: CSV, Parquet and line-delimited GeoJSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.errors import GridError
from gridtide.sources.cube import write_cube
from gridtide.sources.geometry_text import geometry_of_text

# Columns left over from array libraries, dropped from CSV.
ARTEFACT_COLUMNS = ("spatial_ref", "index")
ARTEFACT_PREFIX = "level_"
GEOMETRY_COLUMNS = ("geometry", "rings")


def zones_to_table(zonal: DataFrame, features: DataFrame, zone: str = "zone_id") -> DataFrame:
    """A zonal result with the geometry of its zones: one row per zone and time.

    Features may give their geometry as text, see ``geometry_of_text``.
    """
    written = isinstance(features.schema["geometry"].dataType, T.StringType)
    shape = geometry_of_text(F.col("geometry")) if written else F.col("geometry")
    geometry = features.select(F.col("id").alias(zone), shape.alias("geometry"))
    return zonal.join(geometry, zone, "left")


def csv_table(df: DataFrame) -> DataFrame:
    """Flat columns only: no artefacts and no geometry."""
    drop = [
        name
        for name in df.columns
        if name in ARTEFACT_COLUMNS or name in GEOMETRY_COLUMNS or name.startswith(ARTEFACT_PREFIX)
    ]
    return df.drop(*drop)


def geojson_lines(df: DataFrame) -> DataFrame:
    """One GeoJSON feature per row as text: every other column becomes a property."""
    names = [name for name in df.columns if name not in GEOMETRY_COLUMNS]
    properties = F.struct(*names).alias("properties")
    kind = F.lit("Feature").alias("type")

    def feature(geometry: Column) -> Column:
        return F.to_json(F.struct(kind, properties, geometry.alias("geometry")), {"ignoreNullFields": "false"})

    single = F.struct(F.lit("Polygon").alias("type"), F.col("geometry.coordinates")[0].alias("coordinates"))
    multi = F.struct(F.lit("MultiPolygon").alias("type"), F.col("geometry.coordinates").alias("coordinates"))
    none = F.lit(None).cast("string")
    return df.select(
        F.when(F.col("geometry.coordinates").isNull(), feature(none))
        .when(F.col("geometry.type") == "Polygon", feature(single))
        .otherwise(feature(multi))
        .alias("value")
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    csv_table(df).write.mode(mode).option("header", "true").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_geojson(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    geojson_lines(df).write.mode(mode).text(path)


VECTOR_FORMATS: dict[str, Callable[..., None]] = {
    "GEOJSON": write_geojson,
    "CSV": write_csv,
    "PARQUET": write_parquet,
}
RASTER_FORMATS: dict[str, Callable[..., None]] = {"CSV": write_csv, "PARQUET": write_cube}


def is_vector(df: DataFrame) -> bool:
    """Whether the result has a geometry column."""
    return "geometry" in df.columns and isinstance(df.schema["geometry"].dataType, T.StructType)


def save_result(df: DataFrame, path: str, fmt: str = "PARQUET", **options: object) -> str:
    """Write a result in the named format, any case. Returns the format used.

    A vector result in an unknown format is written as GeoJSON; an unknown raster format raises.
    """
    name = fmt.upper()
    if is_vector(df):
        name = name if name in VECTOR_FORMATS else "GEOJSON"
        VECTOR_FORMATS[name](df, path, **options)
        return name
    if name not in RASTER_FORMATS:
        known = ", ".join(sorted(RASTER_FORMATS))
        raise GridError(f"Unsupported raster format '{fmt}'. Known formats: {known}")
    RASTER_FORMATS[name](df, path, **options)
    return name
