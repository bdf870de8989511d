"""The catalog: one row per stored result, with scope, coverage, versions and publication.

Column layout of an artifact table::

    seq bigint, artifact_id, dataset_id, source_dataset_id, dataset_name, variable, period_type, format,
    path string, asset_paths array<string>, variables array<string>,
    request_scope struct<start, end, bbox struct<xmin,ymin,xmax,ymax>>,
    coverage struct<temporal struct<start,end>, spatial struct<..>, spatial_wgs84 struct<..>>,
    created_at timestamp_ntz, publication struct<status, collection_id, published_at, catalog_path>

``seq`` is the position of the record, which decides ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.errors import GridError, NotFoundError
from gridtide.functions.periods import period_start
from gridtide.operators.select import filter_bands, filter_bbox, slice_time, stack_bands
from gridtide.sources import files
from gridtide.sources.cube import cut_by_bucket, read_cube

BOX_TYPE = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
SPAN_TYPE = "struct<start:string,end:string>"
SCOPE_TYPE = f"struct<start:string,end:string,bbox:{BOX_TYPE}>"
COVERAGE_TYPE = f"struct<temporal:{SPAN_TYPE},spatial:{BOX_TYPE},spatial_wgs84:{BOX_TYPE}>"
PUBLICATION_TYPE = "struct<status:string,collection_id:string,published_at:timestamp_ntz,catalog_path:string>"
ARTIFACT_SCHEMA = (
    "seq bigint, artifact_id string, dataset_id string, source_dataset_id string, dataset_name string, "
    "variable string, period_type string, format string, path string, asset_paths array<string>, "
    f"variables array<string>, request_scope {SCOPE_TYPE}, coverage {COVERAGE_TYPE}, "
    f"created_at timestamp_ntz, publication {PUBLICATION_TYPE}"
)

# States of a publication, and the storage formats.
PUBLISHED, UNPUBLISHED = "published", "unpublished"
LEDGER_FORMAT, CUBE_FORMAT, FLAT_FORMAT = "ledger", "parquet", "csv"
ARRAY_FORMATS = (LEDGER_FORMAT, CUBE_FORMAT)

# Keywords every discovery record carries after dataset and variable.
KEYWORDS = ("zarr", "stac")


def materialized(artifacts: DataFrame, existing_paths: DataFrame) -> DataFrame:
    """Records whose path and asset paths all exist; a record without any path is dropped."""
    paths = F.array_compact(
        F.concat(F.array("path"), F.coalesce(F.col("asset_paths"), F.array().cast("array<string>")))
    )
    wanted = artifacts.select("artifact_id", F.explode(paths).alias("path"))
    broken = wanted.join(existing_paths.select("path"), "path", "left_anti").select("artifact_id")
    return artifacts.filter(F.size(paths) > 0).join(broken, "artifact_id", "left_anti").select(*artifacts.columns)


def latest_per_dataset(artifacts: DataFrame) -> DataFrame:
    """Newest record of every dataset; of equally new ones the first.

    The filter sits right on ``row_number``, so Spark keeps one row per dataset already before the
    shuffle and a dataset with very many records causes no skew.
    """
    newest = Window.partitionBy("dataset_id").orderBy(F.col("created_at").desc(), F.col("seq").asc())
    ranked = artifacts.withColumn("__rank", F.row_number().over(newest))
    return ranked.filter(F.col("__rank") == 1).drop("__rank")


def latest_published(artifacts: DataFrame) -> DataFrame:
    """Newest record per dataset, if it is published and holds a cube.

    An unpublished newest version hides the dataset, also if an older one was published.
    """
    return latest_per_dataset(artifacts).filter(
        (F.col("publication.status") == PUBLISHED) & F.col("format").isin(*ARRAY_FORMATS)
    )


def version_history(artifacts: DataFrame) -> DataFrame:
    """All versions with their number, 1 for the newest of a dataset.

    The number is the count of the dataset's versions on later days plus the rank within the day,
    so no task has to order all versions of one dataset.
    """
    dated = artifacts.withColumn("__day", F.to_date("created_at"))
    per_day = dated.groupBy("dataset_id", "__day").agg(F.count("*").alias("n"))
    later = Window.partitionBy("dataset_id").orderBy(F.col("__day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_day.select("dataset_id", "__day", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("newer"))
    within = Window.partitionBy("dataset_id", "__day").orderBy(F.col("created_at").desc(), F.col("seq").asc())
    ranked = dated.withColumn("__rank", F.row_number().over(within))
    return ranked.join(offsets, ["dataset_id", "__day"]).select(
        "dataset_id",
        (F.col("newer") + F.col("__rank")).alias("version"),
        "created_at",
        "format",
        "coverage",
        "request_scope",
        "seq",
    )


def dataset_versions(artifacts: DataFrame, dataset_ids: Sequence[str] | None = None) -> DataFrame:
    """The versions of the named datasets, or of all, as one nested list per dataset, newest first.

    A list is one row, so this is for catalogs with a moderate number of versions; ``version_history`` has
    a row per version instead.
    """
    picked = artifacts if dataset_ids is None else artifacts.filter(F.col("dataset_id").isin(list(dataset_ids)))
    entry = F.struct("created_at", (-F.col("seq")).alias("order"), "format", "coverage", "request_scope")
    lists = picked.groupBy("dataset_id").agg(F.sort_array(F.collect_list(entry), asc=False).alias("versions"))
    return lists.withColumn("versions", F.transform("versions", lambda v: v.dropFields("order")))


def list_ingestions(artifacts: DataFrame) -> DataFrame:
    """All records, newest first; equally new ones stay in record order."""
    return artifacts.orderBy(F.col("created_at").desc(), F.col("seq").asc())


def list_datasets(artifacts: DataFrame) -> DataFrame:
    """The newest record of every dataset, by dataset id."""
    return latest_per_dataset(artifacts).orderBy("dataset_id")


def coverage_matches(coverage: Column, scope: Column) -> Column:
    """Whether a record covers its scope exactly: same start, and same end unless the scope is open."""
    temporal = coverage["temporal"]
    starts = temporal["start"].eqNullSafe(scope["start"])
    return starts & (scope["end"].isNull() | temporal["end"].eqNullSafe(scope["end"]))


def scope_accepts(coverage: Column, scope: Column) -> Column:
    """Whether freshly written data fits its request: same start, and no further than the requested end."""
    temporal = coverage["temporal"]
    starts = temporal["start"].eqNullSafe(scope["start"])
    return starts & (scope["end"].isNull() | (temporal["end"] <= scope["end"]))


def realise_scope(artifacts: DataFrame) -> DataFrame:
    """Records that fit their request, with the scope end set to the end that was reached."""
    fits = artifacts.filter(scope_accepts(F.col("coverage"), F.col("request_scope")))
    return fits.withColumn("request_scope", F.col("request_scope").withField("end", F.col("coverage.temporal.end")))


def matching_records(
    artifacts: DataFrame, requests: DataFrame, existing_paths: DataFrame | None = None
) -> DataFrame:
    """Every record that could serve a request, pair by pair: same dataset, identical scope, exact coverage, stored.

    This lists all pairs of a scope; where only the last record counts, ``find_existing`` reduces first.

    ``requests`` has request_id, dataset_id and request_scope; NULL equals NULL in a scope.
    """
    candidates = materialized(artifacts, existing_paths) if existing_paths is not None else artifacts
    usable = candidates.filter(coverage_matches(F.col("coverage"), F.col("request_scope")))
    asked = requests.select("request_id", F.col("dataset_id").alias("__dataset"), F.col("request_scope").alias("__scope"))
    same = (F.col("dataset_id") == F.col("__dataset")) & F.col("request_scope").eqNullSafe(F.col("__scope"))
    return usable.join(asked, same).drop("__dataset", "__scope")


def last_match(matches: DataFrame) -> DataFrame:
    """Of the records that fit a request, the one that was added last."""
    last = Window.partitionBy("request_id").orderBy(F.col("seq").desc())
    ranked = matches.withColumn("__rank", F.row_number().over(last))
    return ranked.filter(F.col("__rank") == 1).drop("__rank")


def last_usable(artifacts: DataFrame, existing_paths: DataFrame | None = None) -> DataFrame:
    """One row per dataset and scope: how many stored records cover the scope, and the last one added.

    Whether a record serves a request depends on dataset and scope alone, so the records of a scope are reduced
    before any request is looked at, however many there are.
    """
    candidates = materialized(artifacts, existing_paths) if existing_paths is not None else artifacts
    usable = candidates.filter(coverage_matches(F.col("coverage"), F.col("request_scope")))
    return usable.groupBy("dataset_id", "request_scope").agg(
        F.count("*").alias("candidates"),
        F.max_by(F.struct(*[F.col(name) for name in artifacts.columns]), "seq").alias("record"),
    )


def requested(usable: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, candidates, record`` of every request that has a usable record; NULL equals NULL in a scope."""
    asked = requests.select("request_id", F.col("dataset_id").alias("__dataset"), F.col("request_scope").alias("__scope"))
    same = (F.col("dataset_id") == F.col("__dataset")) & F.col("request_scope").eqNullSafe(F.col("__scope"))
    return usable.join(asked, same).select("request_id", "candidates", "record")


def find_existing(
    artifacts: DataFrame, requests: DataFrame, existing_paths: DataFrame | None = None
) -> DataFrame:
    """The stored result each request can reuse; requests without one are left out."""
    return requested(last_usable(artifacts, existing_paths), requests).select("record.*", "request_id")


def one_per_scope(new: DataFrame, last: bool) -> DataFrame:
    """Of new records with the same dataset and scope the last, or the first."""
    pick = F.max_by if last else F.min_by
    whole = F.struct(*[F.col(name) for name in new.columns])
    order = F.struct("seq", "artifact_id")
    return new.groupBy("dataset_id", "request_scope").agg(pick(whole, order).alias("r")).select("r.*")


def upsert_artifact(
    artifacts: DataFrame, new: DataFrame, overwrite: bool = False, existing_paths: DataFrame | None = None
) -> DataFrame:
    """The catalog after adding ``new`` records.

    Without ``overwrite`` an existing match is kept and the new record dropped. With it the new
    record takes the place of the match but keeps its id and publication. No match: it is appended.
    Of new records with the same dataset and scope the first is added, or with ``overwrite`` the last.
    With ``existing_paths`` a record whose files are gone is no match.
    """
    new = one_per_scope(new, overwrite)
    requests = new.select(F.col("artifact_id").alias("request_id"), "dataset_id", "request_scope")
    found = find_existing(artifacts, requests, existing_paths).select(
        F.col("request_id").alias("__new"),
        F.col("artifact_id").alias("__old"),
        F.col("seq").alias("__old_seq"),
        F.col("publication").alias("__old_publication"),
    )
    columns = artifacts.columns
    matched = new.join(found, F.col("artifact_id") == F.col("__new"), "left")
    top = artifacts.agg(F.coalesce(F.max("seq"), F.lit(-1))).scalar()
    appended = (
        matched.filter(F.col("__new").isNull())
        .withColumn("seq", top + 1 + F.col("seq"))
        .select(*columns)
    )
    if not overwrite:
        return artifacts.unionByName(appended)
    replaced = (
        matched.filter(F.col("__new").isNotNull())
        .withColumns(
            {"artifact_id": F.col("__old"), "seq": F.col("__old_seq"), "publication": F.col("__old_publication")}
        )
        .select(*columns)
    )
    kept = artifacts.join(found.select(F.col("__old").alias("artifact_id")), "artifact_id", "left_anti")
    return kept.select(*columns).unionByName(replaced).unionByName(appended)


def backfill_scope(artifacts: DataFrame) -> DataFrame:
    """Give records without a scope the one their coverage implies."""
    spatial = F.col("coverage.spatial")
    whole = spatial["xmin"].isNotNull() & spatial["ymin"].isNotNull() & spatial["xmax"].isNotNull() & spatial["ymax"].isNotNull()
    implied = F.struct(
        F.coalesce(F.col("coverage.temporal.start"), F.lit("")).alias("start"),
        F.col("coverage.temporal.end").alias("end"),
        F.when(whole, spatial).alias("bbox"),
    ).cast(SCOPE_TYPE)
    return artifacts.withColumn("request_scope", F.coalesce("request_scope", implied))


def publish(artifacts: DataFrame, artifact_ids: Sequence[str] | Column, now: Column) -> DataFrame:
    """Mark records as published under their dataset id."""
    chosen = artifact_ids if isinstance(artifact_ids, Column) else F.col("artifact_id").isin(list(artifact_ids))
    published = F.struct(
        F.lit(PUBLISHED).alias("status"),
        F.col("dataset_id").alias("collection_id"),
        now.cast("timestamp_ntz").alias("published_at"),
        F.concat(F.lit("collections/"), F.col("dataset_id")).alias("catalog_path"),
    ).cast(PUBLICATION_TYPE)
    return artifacts.withColumn("publication", F.when(chosen, published).otherwise(F.col("publication")))


def with_templates(artifacts: DataFrame, templates: DataFrame) -> DataFrame:
    """Records with the metadata of their dataset's template.

    The period type of the template wins, then that of the record, then ``unknown``.
    """
    known = templates.withColumnsRenamed({"period_type": "template_period_type"})
    joined = artifacts.join(known, "dataset_id", "left")
    return joined.withColumn("period_type", F.coalesce("template_period_type", "period_type", F.lit("unknown")))


def dataset_summary(artifacts: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per dataset, from its newest record and its template."""
    latest = with_templates(latest_per_dataset(artifacts), templates)
    return latest.select(
        "dataset_id",
        F.coalesce("source_dataset_id", "dataset_id").alias("source_dataset_id"),
        "dataset_name",
        "short_name",
        "variable",
        "period_type",
        "units",
        "resolution",
        "source",
        "source_url",
        F.col("coverage").alias("extent"),
        F.col("created_at").alias("last_updated"),
        F.struct("publication.status", "publication.published_at").alias("publication"),
    )


def committed_end(artifacts: DataFrame, periods: DataFrame, append_only: Column | None = None) -> DataFrame:
    """Records with ``current_end``: the newest stored period, or the recorded coverage end.

    ``periods`` has dataset_id and period_id of what the stores hold. A dataset with any malformed
    period, or without stored ones, falls back to its record.
    """
    newest = periods.select("dataset_id", "period_id", period_start("period_id").alias("at")).groupBy("dataset_id").agg(
        F.max_by("period_id", "at").alias("__end"),
        F.bool_or(F.col("at").isNull()).alias("__malformed"),
    )
    append_only = F.col("format") == LEDGER_FORMAT if append_only is None else append_only
    usable = append_only & ~F.coalesce("__malformed", F.lit(True))
    joined = artifacts.join(newest, "dataset_id", "left")
    end = F.coalesce(F.when(usable, F.col("__end")), F.col("coverage.temporal.end"))
    return joined.withColumn("current_end", end).drop("__end", "__malformed")


def collection_metadata(
    artifacts: DataFrame, templates: DataFrame, axes: DataFrame, variables: DataFrame
) -> DataFrame:
    """Discovery record per published dataset.

    ``axes`` and ``variables`` are the summaries of the stored cubes with their dataset_id. The
    longitude/latitude box is preferred, and the time axis takes its extent from the record.
    """
    latest = with_templates(latest_published(artifacts), templates)
    box = F.coalesce("coverage.spatial_wgs84", "coverage.spatial")
    start, end = period_start("coverage.temporal.start"), period_start("coverage.temporal.end")
    render = F.when(
        F.col("display.colormap").isNotNull() & (F.size("display.range") == 2),
        F.struct(
            F.col("dataset_name").alias("title"),
            F.col("display.range").alias("rescale"),
            F.col("display.colormap").alias("colormap_name"),
            F.col("variable").alias("variable"),
            F.col("display.nodata").alias("nodata"),
            F.col("units").alias("units"),
        ),
    )
    keywords = F.array_compact(
        F.array(
            "dataset_id",
            "variable",
            *[F.lit(word) for word in KEYWORDS],
            F.nullif(F.col("source"), F.lit("")),
            F.nullif(F.col("short_name"), F.lit("")),
        )
    )
    # a dataset has three axes and a handful of variables, so these lists stay short
    dimension = F.struct("axis", "type", "size", "low", "high", "step", "iso_step")
    dimensions = axes.groupBy("dataset_id").agg(F.array_sort(F.collect_list(dimension)).alias("dimensions"))
    variable = F.struct(F.col("variable").alias("name"), "dimensions", "long_name", "units")
    bands = variables.groupBy("dataset_id").agg(F.array_sort(F.collect_list(variable)).alias("variables"))
    head = latest.select(
        "dataset_id",
        F.col("dataset_name").alias("title"),
        F.concat(F.lit("Published dataset for "), F.col("dataset_name")).alias("description"),
        box.alias("bbox"),
        F.struct(start.alias("start"), end.alias("end")).alias("interval"),
        keywords.alias("keywords"),
        render.alias("render"),
        F.col("iso_step").alias("declared_step"),
    )
    described = head.join(dimensions, "dataset_id", "left").join(bands, "dataset_id", "left")
    is_time = lambda d: d["type"] == "temporal"
    epoch = lambda t: F.unix_micros(t.cast("timestamp")) / 1e6

    def from_record(d: Column) -> Column:
        return (
            d.withField("low", F.when(is_time(d), epoch(F.col("interval.start"))).otherwise(d["low"]))
            .withField("high", F.when(is_time(d), epoch(F.col("interval.end"))).otherwise(d["high"]))
            .withField("iso_step", F.when(is_time(d), F.coalesce(F.col("declared_step"), d["iso_step"])))
        )

    return described.withColumn("dimensions", F.transform("dimensions", from_record)).drop("declared_step")


def collection_json(collections: DataFrame) -> DataFrame:
    """Discovery records as JSON text."""
    fields = [name for name in collections.columns if name != "dataset_id"]
    return collections.select("dataset_id", F.to_json(F.struct("dataset_id", *fields)).alias("document"))


def load_collection(
    spark: SparkSession,
    artifacts: DataFrame,
    dataset_id: str,
    spatial_extent: dict[str, float | None] | None = None,
    temporal_extent: Sequence[str | None] | None = None,
    bands: Sequence[str] | None = None,
) -> DataFrame:
    """Open the newest published cube of a dataset and cut it by time, box and band, in that order."""
    record = latest_published(artifacts.filter(F.col("dataset_id") == dataset_id)).select(
        F.coalesce(F.col("path"), F.try_element_at("asset_paths", F.lit(1))).alias("path"), "format"
    ).first()
    if record is None:
        raise NotFoundError(f"Collection '{dataset_id}' not found")
    if record["path"] is None:
        raise GridError(f"The newest record of '{dataset_id}' has no readable path")
    start, end = (list(temporal_extent or []) + [None, None])[:2]
    if record["format"] == LEDGER_FORMAT:
        from gridtide.streaming.store import PeriodStore

        cube = PeriodStore(spark, record["path"]).read(start, end)
    else:
        cube = cut_by_bucket(read_cube(spark, record["path"]), start, end)
    return cut_collection(cube, spatial_extent, temporal_extent, bands)


def cut_collection(
    cube: DataFrame,
    spatial_extent: dict[str, float | None] | None = None,
    temporal_extent: Sequence[str | None] | None = None,
    bands: Sequence[str] | None = None,
) -> DataFrame:
    """Cut by time (both ends included), box and band, then stack several bands."""
    if temporal_extent is not None:
        start, end = (list(temporal_extent) + [None, None])[:2]
        cube = slice_time(cube, start, end)
    cube = filter_bbox(cube, spatial_extent)
    return stack_bands(filter_bands(cube, bands))


class CatalogTable:
    """An artifact table on shared storage, rewritten as a new version on every change.

    Spark cannot overwrite a path it reads, so a change writes the next version folder. A version
    counts once its success mark is there, which is the last thing written; a crash in between
    leaves the version before it in force. One writer at a time is assumed.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _versions(self, complete_only: bool) -> list[int]:
        names = [n for n in files.child_names(self.spark, self.path) if n.startswith("version=")]
        if complete_only:
            names = [n for n in names if files.is_complete(self.spark, f"{self.path}/{n}")]
        return sorted(int(n.split("=")[1]) for n in names)

    def read(self) -> DataFrame:
        versions = self._versions(complete_only=True)
        if not versions:
            return self.spark.createDataFrame([], ARTIFACT_SCHEMA)
        return self.spark.read.schema(ARTIFACT_SCHEMA).parquet(f"{self.path}/version={versions[-1]:08d}")

    def replace(self, artifacts: DataFrame) -> DataFrame:
        version = max(self._versions(complete_only=False), default=-1) + 1
        artifacts.write.mode("overwrite").parquet(f"{self.path}/version={version:08d}")
        return self.read()

    def upsert(self, new: DataFrame, overwrite: bool = False, existing_paths: DataFrame | None = None) -> DataFrame:
        return self.replace(upsert_artifact(self.read(), new, overwrite, existing_paths))

    def publish(self, artifact_ids: Sequence[str], now: Column) -> DataFrame:
        return self.replace(publish(self.read(), artifact_ids, now))
