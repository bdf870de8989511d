"""Polygons from GeoJSON and station observations from CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE_TYPE = (
    "struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
)
POLYGON_TYPE = "array<array<array<double>>>"
MULTIPOLYGON_TYPE = "array<array<array<array<double>>>>"

OBSERVATION_SCHEMA = "id int, stn_id int, datetime string, value double, lat double, long double"


def read_features(spark: SparkSession, path: str, id_property: str = "id", lines: bool = False) -> DataFrame:
    """One row per feature: id, name, properties, geometry and its rings.

    A FeatureCollection document is one JSON value; ``lines`` reads one feature per line instead,
    which Spark can split over tasks. The feature id falls back to a property.
    """
    if lines:
        features = spark.read.text(path).select(F.from_json("value", FEATURE_TYPE).alias("f"))
    else:
        document = spark.read.option("multiLine", "true").schema(f"features array<{FEATURE_TYPE}>").json(path)
        features = document.select(F.explode("features").alias("f"))
    return features_table(features.select("f.*"), id_property)


def features_table(parsed: DataFrame, id_property: str = "id") -> DataFrame:
    """Parsed features (id, properties, geometry with raw coordinate text) to the feature table."""
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(text, POLYGON_TYPE))).when(
        kind == "MultiPolygon", F.from_json(text, MULTIPOLYGON_TYPE)
    )
    properties = F.col("properties")
    table = parsed.select(
        F.coalesce(F.col("id"), F.try_element_at(properties, F.lit(id_property))).alias("id"),
        F.try_element_at(properties, F.lit("name")).alias("name"),
        properties.alias("properties"),
        F.struct(kind.alias("type"), polygons.alias("coordinates")).alias("geometry"),
    )
    return table.withColumn("rings", rings_of(F.col("geometry.coordinates")))


def rings_of(polygons: Column) -> Column:
    """All rings of nested polygon coordinates as ``array<array<struct<x,y>>>``, holes included."""
    return F.transform(
        F.flatten(polygons),
        lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))),
    )


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Station readings with ``datetime`` as naive UTC time."""
    rows = spark.read.option("header", "true").schema(OBSERVATION_SCHEMA).csv(path)
    return rows.withColumn("datetime", F.col("datetime").cast("timestamp").cast("timestamp_ntz"))
