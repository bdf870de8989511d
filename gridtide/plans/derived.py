"""Deriving a resampled dataset and recording it, with reuse of what is already stored."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.errors import GridError, NoDataError
from gridtide.functions.crs import WGS84
from gridtide.functions.frequency import parse_frequency
from gridtide.functions.periods import derived_id, normalize_period
from gridtide.operators.catalog import (
    ARTIFACT_SCHEMA,
    CUBE_FORMAT,
    UNPUBLISHED,
    CatalogTable,
    find_existing,
    realise_scope,
)
from gridtide.operators.reduce import coverage
from gridtide.operators.resample import resample
from gridtide.sources import files
from gridtide.sources.cube import read_cube, write_cube


def _scalar(spark: SparkSession, column: Column) -> str:
    value = spark.range(1).select(column).first()[0]
    if value is None:
        raise GridError("A period text cannot be read")
    return value


def artifact_row(
    spark: SparkSession,
    covered: DataFrame,
    *,
    dataset_id: str,
    source_dataset_id: str | None,
    name: str,
    variable: str,
    period_type: str,
    fmt: str,
    path: str,
    start: str,
    end: str | None,
    bbox: tuple[float, float, float, float] | None,
    now: Column,
) -> DataFrame:
    """A catalog record from a one-row coverage table."""
    box_type = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    box = (
        F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(bbox, ("xmin", "ymin", "xmax", "ymax"))])
        if bbox is not None
        else F.lit(None).cast(box_type)
    )
    text = lambda value: F.lit(value).cast("string")
    row = covered.select(
        F.lit(0).cast("bigint").alias("seq"),
        text(uuid.uuid4().hex).alias("artifact_id"),
        text(dataset_id).alias("dataset_id"),
        text(source_dataset_id).alias("source_dataset_id"),
        text(name).alias("dataset_name"),
        text(variable).alias("variable"),
        text(period_type).alias("period_type"),
        text(fmt).alias("format"),
        text(path).alias("path"),
        F.array(text(path)).alias("asset_paths"),
        F.array(text(variable)).alias("variables"),
        F.struct(text(start).alias("start"), text(end).alias("end"), box.alias("bbox")).alias("request_scope"),
        F.struct(
            F.struct("start", "end").alias("temporal"),
            F.struct("xmin", "ymin", "xmax", "ymax").alias("spatial"),
            F.col("spatial_wgs84"),
        ).alias("coverage"),
        now.cast("timestamp_ntz").alias("created_at"),
        F.struct(
            F.lit(UNPUBLISHED).alias("status"),
            text(None).alias("collection_id"),
            F.lit(None).cast("timestamp_ntz").alias("published_at"),
            text(None).alias("catalog_path"),
        ).alias("publication"),
    )
    return spark.createDataFrame(row.collect(), ARTIFACT_SCHEMA)  # one row, fixed so that ids do not change


def materialize_resampled(
    spark: SparkSession,
    catalog: CatalogTable,
    source: DataFrame,
    target_root: str,
    *,
    source_dataset_id: str,
    source_period_type: str,
    variable: str,
    frequency: str,
    method: str,
    start: str,
    end: str | None = None,
    now: Column,
    overwrite: bool = False,
    publish: bool = True,
    crs: str = WGS84,
) -> DataFrame:
    """Resample a stored cube, write the result and record it. Returns the record in force.

    Without ``end`` the range runs to the day of ``now``. A recorded result whose files are gone is not reused.

    A stored result of the same scope is reused. Start and end are brought to the period format of
    the result first, so weekly and monthly results are found again.
    """
    freq = parse_frequency(frequency)
    dataset_id = _scalar(spark, derived_id(F.lit(source_dataset_id), F.lit(frequency), F.lit(method)))
    if end is None:
        end = _scalar(spark, F.date_format(now, "yyyy-MM-dd"))
    scope_start = _scalar(spark, normalize_period(F.lit(start), freq.period_type))
    scope_end = _scalar(spark, normalize_period(F.lit(end), freq.period_type))

    def stored(last: str) -> DataFrame:
        request = spark.createDataFrame(
            [("q", dataset_id, (scope_start, last, None))],
            "request_id string, dataset_id string, "
            "request_scope struct<start:string,end:string,bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>",
        )
        return find_existing(catalog.read(), request, existing()).drop("request_id")

    def existing() -> DataFrame:
        # only the records of this one dataset are looked up
        own = catalog.read().filter(F.col("dataset_id") == dataset_id)
        paths = own.select(F.explode(F.concat(F.array("path"), F.coalesce("asset_paths", F.array().cast("array<string>")))).alias("path"))
        kept = [(r["path"],) for r in paths.filter("path IS NOT NULL").distinct().toLocalIterator() if files.exists(spark, r["path"])]
        return spark.createDataFrame(kept, "path string")

    def in_force(records: DataFrame) -> DataFrame:
        row = records.select("artifact_id", "publication.status").first()
        if publish and row["status"] == UNPUBLISHED:
            catalog.publish([row["artifact_id"]], now)
        return catalog.read().filter(F.col("artifact_id") == row["artifact_id"])

    found = stored(scope_end)
    if not overwrite and not found.isEmpty():
        return in_force(found)

    # a fresh folder per run: the records of earlier runs stay readable until the catalog moves on
    path = f"{target_root.rstrip('/')}/{dataset_id}/{uuid.uuid4().hex}"
    derived = resample(source, frequency, method, start, end, source_period_type)
    step = {"hourly": "PT1H", "daily": "P1D", "weekly": "P1W", "monthly": "P1M", "yearly": "P1Y"}[freq.period_type]
    write_cube(derived, path, dataset_id=dataset_id, iso_step=step)
    if not files.child_names(spark, path):
        raise NoDataError("The source does not contain any complete target period")
    written = read_cube(spark, path)
    covered = coverage(written, freq.period_type, crs)
    reached = covered.select("end").first()
    found = stored(reached["end"])
    if not overwrite and not found.isEmpty():
        return in_force(found)
    record = artifact_row(
        spark,
        covered,
        dataset_id=dataset_id,
        source_dataset_id=source_dataset_id,
        name=dataset_id,
        variable=variable,
        period_type=freq.period_type,
        fmt=CUBE_FORMAT,
        path=path,
        start=scope_start,
        end=reached["end"],
        bbox=None,
        now=now,
    )
    catalog.upsert(record, overwrite, existing().union(spark.createDataFrame([(path,)], "path string")))
    return in_force(catalog.read().filter(F.col("path") == path))
