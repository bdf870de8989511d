"""Queries over catalog tables and sync plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import query
from checks.views import (
    NOW,
    artifacts,
    daily_cube,
    now,
    sql_period,
    sql_period_start,
    stored_paths,
    stored_periods,
    sync_requests,
    table,
    templates,
    with_views,
)
from gridtide.operators import catalog as c
from gridtide.operators.reduce import axis_summary, variable_summary
from gridtide.plans.sync import plan_sync
from gridtide.session import scratch_path
from gridtide.sources.cube import mask_nodata, read_cube, write_cube

ARTIFACTS = with_views("artifacts")
LATEST = with_views("artifacts", "latest")
STORED = """, kept AS (
  SELECT * FROM artifacts WHERE (path IS NOT NULL OR asset_path IS NOT NULL)
    AND (path IS NULL OR path IN (SELECT path FROM paths))
    AND (asset_path IS NULL OR asset_path IN (SELECT path FROM paths)))"""


@query(LATEST + "SELECT dataset_id, artifact_id, created_at FROM latest")
def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.latest_per_dataset(artifacts(spark, sf_dir)).select("dataset_id", "artifact_id", "created_at")


@query(
    ARTIFACTS
    + """SELECT dataset_id, artifact_id, created_at, format, cov_end, scope_end,
                ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, seq) AS version FROM artifacts"""
)
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with its number."""
    return c.version_history(artifacts(spark, sf_dir)).select(
        "dataset_id",
        F.col("seq").cast("string").alias("artifact_id"),
        "created_at",
        "format",
        F.col("coverage.temporal.end").alias("cov_end"),
        F.col("request_scope.end").alias("scope_end"),
        F.col("version").cast("bigint").alias("version"),
    )


@query(ARTIFACTS + "SELECT artifact_id, created_at, status FROM artifacts ORDER BY created_at DESC, seq")
def ingestion_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = c.list_ingestions(artifacts(spark, sf_dir))
    return listed.select("artifact_id", "created_at", F.col("publication.status").alias("status"))


@query(LATEST + "SELECT dataset_id, artifact_id, format FROM latest ORDER BY dataset_id")
def dataset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.list_datasets(artifacts(spark, sf_dir)).select("dataset_id", "artifact_id", "format")


@query(with_views("artifacts", "paths") + STORED[0:] + " SELECT artifact_id, dataset_id FROM kept")
def records_with_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose files are all there."""
    stored = c.materialized(artifacts(spark, sf_dir), stored_paths(spark, sf_dir))
    return stored.select("artifact_id", "dataset_id")


@query(LATEST + "SELECT dataset_id, artifact_id FROM latest WHERE status = 'published' AND format IN ('ledger', 'parquet')")
def published_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.latest_published(artifacts(spark, sf_dir)).select("dataset_id", "artifact_id")


MATCH_SQL = with_views("artifacts", "paths") + STORED + """, asked AS (
    SELECT artifact_id AS request_id, dataset_id, scope_start, scope_end, scope_xmin FROM artifacts),
  hits AS (SELECT a.request_id, k.artifact_id, k.seq, k.cov_end FROM kept k JOIN asked a ON k.dataset_id = a.dataset_id
           AND k.scope_start IS NOT DISTINCT FROM a.scope_start AND k.scope_end IS NOT DISTINCT FROM a.scope_end
           AND k.scope_xmin IS NOT DISTINCT FROM a.scope_xmin
           WHERE k.cov_start = k.scope_start AND (k.scope_end IS NULL OR k.cov_end = k.scope_end))
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's scope asked for again."""
    return artifacts(spark, sf_dir).select(F.col("artifact_id").alias("request_id"), "dataset_id", "request_scope")


@query(
    MATCH_SQL
    + "SELECT request_id, artifact_id, cov_end FROM hits QUALIFY ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY seq DESC) = 1"
)
def reusable_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored result each request can reuse."""
    found = c.find_existing(artifacts(spark, sf_dir), requests(spark, sf_dir), stored_paths(spark, sf_dir))
    return found.select("request_id", "artifact_id", F.col("coverage.temporal.end").alias("cov_end"))


@query(MATCH_SQL + "SELECT request_id, COUNT(*) AS candidates, MAX(seq) AS last_seq FROM hits GROUP BY 1")
def last_matching_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records fit a request, and the last one added."""
    usable = c.last_usable(artifacts(spark, sf_dir), stored_paths(spark, sf_dir))
    found = c.requested(usable, requests(spark, sf_dir))
    return found.select("request_id", "candidates", F.col("record.seq").alias("last_seq"))


NEW_SQL = """, new AS (
  SELECT seq, 'n' || artifact_id AS artifact_id, dataset_id, scope_start, scope_end, scope_xmin, 'unpublished' AS status
  FROM latest),
  usable AS (SELECT * FROM artifacts WHERE cov_start = scope_start AND (scope_end IS NULL OR cov_end = scope_end)),
  found AS (SELECT n.artifact_id AS new_id, u.artifact_id AS old_id, u.seq AS old_seq, u.status AS old_status
            FROM new n JOIN usable u ON u.dataset_id = n.dataset_id AND u.scope_start IS NOT DISTINCT FROM n.scope_start
            AND u.scope_end IS NOT DISTINCT FROM n.scope_end AND u.scope_xmin IS NOT DISTINCT FROM n.scope_xmin
            QUALIFY ROW_NUMBER() OVER (PARTITION BY n.artifact_id ORDER BY u.seq DESC) = 1),
  top AS (SELECT MAX(seq) AS m FROM artifacts)
"""


def new_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record of every dataset handed in once more under a new id, unpublished."""
    latest = c.latest_per_dataset(artifacts(spark, sf_dir))
    fresh = F.struct(
        F.lit(c.UNPUBLISHED).alias("status"),
        F.lit(None).cast("string").alias("collection_id"),
        F.lit(None).cast("timestamp_ntz").alias("published_at"),
        F.lit(None).cast("string").alias("catalog_path"),
    )
    return latest.withColumns({"artifact_id": F.concat(F.lit("n"), F.col("artifact_id")), "publication": fresh})


@query(
    LATEST
    + NEW_SQL
    + """SELECT artifact_id, seq, status FROM artifacts
         UNION ALL SELECT artifact_id, m + 1 + seq, status FROM new, top WHERE artifact_id NOT IN (SELECT new_id FROM found)"""
)
def catalog_after_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New records where nothing matches; existing matches are kept."""
    after = c.upsert_artifact(artifacts(spark, sf_dir), new_records(spark, sf_dir))
    return after.select("artifact_id", "seq", F.col("publication.status").alias("status"))


@query(
    LATEST
    + NEW_SQL
    + """SELECT artifact_id, seq, status FROM artifacts WHERE artifact_id NOT IN (SELECT old_id FROM found)
         UNION ALL SELECT old_id, old_seq, old_status FROM found
         UNION ALL SELECT artifact_id, m + 1 + seq, status FROM new, top WHERE artifact_id NOT IN (SELECT new_id FROM found)"""
)
def catalog_after_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match is replaced but keeps its id and publication. The catalog goes through its stored versions."""
    store = c.CatalogTable(spark, scratch_path(spark, "catalog"))
    store.replace(artifacts(spark, sf_dir))
    after = store.upsert(new_records(spark, sf_dir), overwrite=True)
    return after.select("artifact_id", "seq", F.col("publication.status").alias("status"))


@query(
    ARTIFACTS
    + """SELECT artifact_id, cov_end AS scope_end FROM artifacts
         WHERE cov_start = scope_start AND (scope_end IS NULL OR cov_end <= scope_end)"""
)
def accepted_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written data that fits its request, with the end that was reached."""
    fits = c.realise_scope(artifacts(spark, sf_dir))
    return fits.select("artifact_id", F.col("request_scope.end").alias("scope_end"))


@query(
    ARTIFACTS
    + """SELECT artifact_id, CASE WHEN seq % 2 = 0 THEN scope_start ELSE cov_start END AS scope_start,
                CASE WHEN seq % 2 = 0 THEN scope_end ELSE cov_end END AS scope_end,
                CASE WHEN seq % 2 = 0 THEN scope_xmin WHEN xmax IS NOT NULL THEN xmin END AS scope_xmin FROM artifacts"""
)
def backfilled_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other record lost its scope and gets the one its coverage implies."""
    records = artifacts(spark, sf_dir)
    lost = records.withColumn("request_scope", F.when(F.col("seq") % 2 == 0, F.col("request_scope")))
    filled = c.backfill_scope(lost)
    return filled.select(
        "artifact_id",
        F.col("request_scope.start").alias("scope_start"),
        F.col("request_scope.end").alias("scope_end"),
        F.col("request_scope.bbox.xmin").alias("scope_xmin"),
    )


@query(
    ARTIFACTS
    + f"""SELECT artifact_id, CASE WHEN format = 'ledger' THEN 'published' ELSE status END AS status,
                 CASE WHEN format = 'ledger' THEN dataset_id ELSE collection_id END AS collection_id,
                 CASE WHEN format = 'ledger' THEN TIMESTAMP '{NOW}' ELSE published_at END AS published_at FROM artifacts"""
)
def newly_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = c.publish(artifacts(spark, sf_dir), F.col("format") == c.LEDGER_FORMAT, now())
    return records.select(
        "artifact_id", "publication.status", "publication.collection_id", "publication.published_at"
    )


@query(
    with_views("artifacts", "latest", "templates")
    + """SELECT l.dataset_id, COALESCE(l.source_dataset_id, l.dataset_id) AS source_dataset_id, dataset_name, short_name,
                variable, COALESCE(t.period_type, l.period_type, 'unknown') AS period_type, units, source,
                cov_end AS extent_end, created_at AS last_updated, status
         FROM latest l LEFT JOIN templates t USING (dataset_id)"""
)
def dataset_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = c.dataset_summary(artifacts(spark, sf_dir), templates(spark, sf_dir))
    return summary.select(
        "dataset_id",
        "source_dataset_id",
        "dataset_name",
        "short_name",
        "variable",
        "period_type",
        "units",
        "source",
        F.col("extent.temporal.end").alias("extent_end"),
        "last_updated",
        "publication.status",
    )


@query(
    with_views("artifacts", "templates")
    + """SELECT artifact_id, short_name, COALESCE(t.period_type, a.period_type, 'unknown') AS period_type
         FROM artifacts a LEFT JOIN templates t USING (dataset_id)"""
)
def records_with_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = c.with_templates(artifacts(spark, sf_dir), templates(spark, sf_dir))
    return joined.select("artifact_id", "short_name", "period_type")


END_SQL = """, ends AS (
  SELECT dataset_id, ARG_MAX(period_id, starts) AS e, BOOL_OR(starts IS NULL) AS bad FROM (
    SELECT s.dataset_id, s.period_id, CASE LENGTH(s.period_id) WHEN 13 THEN TRY_STRPTIME(s.period_id, '%Y-%m-%dT%H')
      WHEN 10 THEN TRY_STRPTIME(s.period_id, '%Y-%m-%d') WHEN 8 THEN TRY_STRPTIME(s.period_id || '-1', '%G-W%V-%u')
      WHEN 7 THEN TRY_STRPTIME(s.period_id, '%Y-%m') WHEN 4 THEN TRY_STRPTIME(s.period_id, '%Y') END AS starts
    FROM stored_periods s) GROUP BY 1),
  ended AS (SELECT l.*, CASE WHEN l.format = 'ledger' AND NOT bad THEN e ELSE cov_end END AS current_end
            FROM latest l LEFT JOIN ends USING (dataset_id))
"""


@query(with_views("artifacts", "latest", "stored_periods") + END_SQL + "SELECT dataset_id, format, current_end FROM ended")
def current_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest stored period per dataset, or what its record says."""
    latest = c.latest_per_dataset(artifacts(spark, sf_dir))
    return c.committed_end(latest, stored_periods(spark, sf_dir)).select("dataset_id", "format", "current_end")


PT_NOW = sql_period(f"TIMESTAMP '{NOW}'", "period_type")
PLAN_SQL = (
    with_views("artifacts", "latest", "stored_periods", "templates", "requests")
    + END_SQL
    + f""", base AS (
  SELECT e.dataset_id, e.format, e.scope_start AS current_start, e.current_end, t.* EXCLUDE (dataset_id),
         NULLIF(TRIM(r.requested_end), '') AS asked
  FROM ended e JOIN templates t USING (dataset_id) LEFT JOIN requests r USING (dataset_id)),
  resolved AS (SELECT *, CASE WHEN kind = 'static' OR asked = 'soon' THEN NULL WHEN asked IS NOT NULL THEN asked ELSE {PT_NOW} END AS wanted,
    CASE WHEN asked IS NOT NULL THEN 'request' ELSE 'default_today' END AS label,
    {sql_period_start('current_end', 'period_type')} AS here FROM base),
  lagged AS (SELECT *, CASE
      WHEN period_type = 'hourly' AND lag_hours > 0 THEN STRFTIME(TIMESTAMP '{NOW}' - INTERVAL (lag_hours) HOUR, '%Y-%m-%dT%H')
      WHEN period_type = 'daily' AND lag_days > 0 THEN STRFTIME(TIMESTAMP '{NOW}' - INTERVAL (lag_days) DAY, '%Y-%m-%d')
      WHEN period_type = 'monthly' AND lag_days > 0 THEN STRFTIME(TIMESTAMP '{NOW}' - INTERVAL (lag_days) DAY, '%Y-%m')
      WHEN period_type = 'yearly' AND latest_year_offset >= 0 THEN CAST(2001 - latest_year_offset AS VARCHAR)
      ELSE wanted END AS lag FROM resolved),
  offered AS (SELECT *, CASE WHEN policy IS NULL OR policy = 'lagged' THEN lag
      WHEN policy = 'complete_month' THEN {sql_period("(CASE WHEN 21 > COALESCE(complete_after_day, 20) THEN TIMESTAMP '2001-07-31' ELSE TIMESTAMP '2001-06-30' END)", 'period_type')}
      WHEN allow_future THEN wanted
      WHEN latest_year IS NOT NULL THEN CASE WHEN period_type IN ('yearly') THEN CAST(latest_year AS VARCHAR) END
      ELSE lag END AS offer FROM lagged),
  target AS (SELECT *, CASE WHEN kind = 'static' THEN NULL
      WHEN asked = 'soon' THEN 'Invalid ' || period_type || ' period ''soon''; expected ' || CASE period_type WHEN 'hourly' THEN 'YYYY-MM-DDTHH'
        WHEN 'daily' THEN 'YYYY-MM-DD' WHEN 'weekly' THEN 'YYYY-Www' WHEN 'monthly' THEN 'YYYY-MM' ELSE 'YYYY' END || ' or ISO datetime'
      WHEN has_availability AND offer IS NULL THEN 'Availability policy gives no valid period' END AS error,
    CASE WHEN kind = 'static' THEN current_end WHEN NOT has_availability THEN wanted ELSE LEAST(wanted, offer) END AS target_end,
    CASE WHEN kind = 'temporal' THEN CASE period_type WHEN 'hourly' THEN STRFTIME(here + INTERVAL 1 HOUR, '%Y-%m-%dT%H')
      WHEN 'daily' THEN STRFTIME(here + INTERVAL 1 DAY, '%Y-%m-%d') WHEN 'weekly' THEN STRFTIME(here + INTERVAL 7 DAY, '%G-W%V')
      WHEN 'monthly' THEN STRFTIME(here + INTERVAL 1 MONTH, '%Y-%m') ELSE STRFTIME(here + INTERVAL 1 YEAR, '%Y') END END AS upcoming
    FROM offered),
  reasoned AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN kind = 'static' THEN 'static_dataset'
      WHEN kind = 'temporal' THEN CASE WHEN upcoming > target_end THEN 'no_new_period'
           WHEN execution = 'append' AND format = 'ledger' THEN 'new_periods_available_for_append' ELSE 'new_periods_available' END
      WHEN current_end >= target_end THEN 'no_new_release' ELSE 'new_release_available' END AS reason FROM target)
  SELECT dataset_id, kind AS sync_kind, reason, current_start, current_end, error,
    CASE WHEN error IS NULL THEN target_end END AS target_end,
    CASE reason WHEN 'static_dataset' THEN 'not_syncable' WHEN 'no_new_period' THEN 'no_op' WHEN 'no_new_release' THEN 'no_op'
      WHEN 'new_periods_available_for_append' THEN 'append' WHEN 'new_periods_available' THEN 'rematerialize'
      WHEN 'new_release_available' THEN 'rematerialize' END AS action,
    CASE reason WHEN 'static_dataset' THEN 'This dataset is static and is not syncable.'
      WHEN 'no_new_period' THEN 'Data already exists through ' || current_end || '; target ' || target_end || ' does not require a new download.'
      WHEN 'no_new_release' THEN 'Release ' || current_end || ' is already available locally; target ' || target_end || ' does not require a new download.'
      WHEN 'new_release_available' THEN 'A newer release is available: ' || target_end || '. Sync will rematerialize the dataset.'
      WHEN 'new_periods_available_for_append' THEN 'Data exists through ' || current_end || '. Sync will append missing periods ' || upcoming
           || ' through ' || target_end || ' and extend coverage through ' || target_end || '.'
      WHEN 'new_periods_available' THEN 'Data exists through ' || current_end || '. Sync will rematerialize the dataset through ' || target_end || '.'
      END AS message,
    CASE WHEN error IS NOT NULL THEN NULL WHEN kind = 'static' THEN 'current_coverage' ELSE label || CASE WHEN target_end = wanted THEN '' ELSE '_clamped_by_availability' END END AS target_end_source,
    CASE WHEN reason LIKE 'new_periods%' THEN upcoming END AS delta_start,
    CASE WHEN reason LIKE 'new_periods%' THEN target_end END AS delta_end
  FROM reasoned"""
)


@query(PLAN_SQL)
def sync_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every dataset needs to become current."""
    plan = plan_sync(
        artifacts(spark, sf_dir),
        templates(spark, sf_dir),
        stored_periods(spark, sf_dir),
        sync_requests(spark, sf_dir),
        now(),
    )
    fine = F.col("error").isNull()
    return plan.withColumns({name: F.when(fine, F.col(name)) for name in ("target_end", "target_end_source")})


@query(
    with_views("artifacts", "latest", "templates")
    + """, shown AS (SELECT l.*, t.period_type AS pt, t.short_name, t.source, t.dataset_id IS NOT NULL AS known,
             COALESCE(t.period_type, l.period_type) AS p
           FROM latest l LEFT JOIN templates t USING (dataset_id) WHERE status = 'published' AND format IN ('ledger', 'parquet'))
         SELECT dataset_id, dataset_name AS title, xmin, xmax, """
    + sql_period_start("cov_start", "p")
    + ' AS "start", '
    + sql_period_start("cov_end", "p")
    + """ AS "end", CONCAT_WS(',', dataset_id, variable, 'zarr', 'stac', source, short_name) AS keywords,
         CASE WHEN known AND source IS NOT NULL THEN 'blues' END AS colormap,
         CASE WHEN steps IS NOT NULL THEN 3 END AS n_axes, steps AS n_steps,
         CASE WHEN known AND steps IS NOT NULL THEN CASE p WHEN 'hourly' THEN 'PT1H' WHEN 'daily' THEN 'P1D' WHEN 'weekly' THEN 'P1W'
              WHEN 'monthly' THEN 'P1M' ELSE 'P1Y' END END AS step
         FROM shown LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS dataset_id, COUNT(DISTINCT l_shipdate) AS steps
                               FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) USING (dataset_id)"""
)
def collection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery records; the axes of a dataset are those of the shipments of its customer."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    cube = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("dataset_id"),
        F.col("l_shipdate").alias("t"),
        (F.col("l_suppkey") % 10).alias("x"),
        (F.col("l_suppkey") % 7).alias("y"),
    )
    axes = axis_summary(cube, by=["dataset_id"])
    names = artifacts(spark, sf_dir).select("dataset_id", "variable").distinct()
    variables = names.select(
        "dataset_id",
        "variable",
        F.array(F.lit("t"), F.lit("y"), F.lit("x")).alias("dimensions"),
        F.lit(None).cast("string").alias("long_name"),
        F.lit("mm").alias("units"),
    )
    found = c.collection_metadata(artifacts(spark, sf_dir), templates(spark, sf_dir), axes, variables)
    in_time = F.filter("dimensions", lambda d: d["type"] == "temporal")[0]
    return found.select(
        "dataset_id",
        "title",
        "bbox.xmin",
        "bbox.xmax",
        "interval.start",
        "interval.end",
        F.array_join("keywords", ",").alias("keywords"),
        F.col("render.colormap_name").alias("colormap"),
        F.size("dimensions").cast("bigint").alias("n_axes"),
        in_time["size"].alias("n_steps"),
        in_time["iso_step"].alias("step"),
    ).withColumn("n_axes", F.when(F.col("n_axes") > 0, F.col("n_axes")))


@query(
    with_views("daily")
    + """SELECT t, y, x, band, value FROM (
           SELECT t, y, x, 'precip' AS band, ROUND(precip, 2) AS value FROM daily
           UNION ALL SELECT t, y, x, 'tax', ROUND(tax, 2) FROM daily)
         WHERE t >= TIMESTAMP '1996-01-01' AND t < TIMESTAMP '1997-07-01' AND y BETWEEN 2 AND 7"""
)
def loaded_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube stored and recorded twice; the newest published record is opened and cut."""
    path = scratch_path(spark, "rain")
    write_cube(daily_cube(spark, sf_dir), path, dataset_id="rain")
    records = c.latest_per_dataset(artifacts(spark, sf_dir))
    named = records.withColumns({"dataset_id": F.lit("rain"), "format": F.lit(c.CUBE_FORMAT)})
    newest = F.col("created_at") == records.agg(F.max("created_at")).scalar()
    located = c.publish(named.withColumn("path", F.when(newest, path).otherwise("old")), newest, now())
    cube = c.load_collection(
        spark, located, "rain", {"south": 2, "north": 7}, ["1996", "1997-06"], ["tax", "precip", "none"]
    )
    return cube.select("t", "y", "x", "band", F.round("value", 2).alias("value"))


@query(
    """SELECT variable, dimensions, long_name, units, CAST(n AS BIGINT) AS n FROM (VALUES
         ('precip', 't,y,x', 'rain', 'mm'), ('price', 't,y,x', NULL, NULL), ('tax', 't,y,x', NULL, 'share')) v(variable, dimensions, long_name, units)
       CROSS JOIN (SELECT COUNT(*) AS n FROM (SELECT DISTINCT l_shipdate, CAST(FLOOR(l_suppkey / 10.0) AS BIGINT) % 10, l_suppkey % 10 FROM lineitem))"""
)
def described_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables of a stored cube after masking: dimensions, names and units survive the way through the files."""
    cube = daily_cube(spark, sf_dir)
    cube = cube.withMetadata("precip", {"long_name": "rain", "units": "mm"}).withMetadata("tax", {"units": "share"})
    path = scratch_path(spark, "described")
    write_cube(mask_nodata(cube, nodata=-99999.0), path, dataset_id="rain")
    stored = read_cube(spark, path)
    rows = variable_summary(stored).withColumn("dimensions", F.array_join("dimensions", ","))
    return rows.join(stored.agg(F.count("*").alias("n")))


@query(
    with_views("artifacts")
    + """SELECT dataset_id, STRING_AGG(created_at || '|' || cov_end, ';' ORDER BY created_at DESC, seq) AS versions, COUNT(*) AS n
         FROM artifacts GROUP BY 1"""
)
def nested_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of every dataset as one list, newest first."""
    lists = c.dataset_versions(artifacts(spark, sf_dir))
    text = F.transform(
        "versions", lambda v: F.concat_ws("|", v["created_at"].cast("string"), v["coverage"]["temporal"]["end"])
    )
    return lists.select("dataset_id", F.array_join(text, ";").alias("versions"), F.size("versions").cast("bigint").alias("n"))


@query(
    with_views("artifacts")
    + """, kept AS (SELECT * FROM artifacts WHERE seq % 3 <> 0),
         usable AS (SELECT dataset_id, scope_start, scope_end, scope_xmin, MAX(seq) AS seq FROM kept
                    WHERE cov_start = scope_start AND (scope_end IS NULL OR cov_end = scope_end) GROUP BY ALL)
         SELECT COUNT(*) AS added, (SELECT COUNT(*) FROM artifacts) AS before,
                (SELECT COUNT(*) FROM artifacts) + COUNT(*) AS ids
         FROM (SELECT DISTINCT dataset_id, scope_start, scope_end, scope_xmin FROM artifacts) n
         WHERE NOT EXISTS (SELECT 1 FROM usable u WHERE u.dataset_id = n.dataset_id AND u.scope_start IS NOT DISTINCT FROM n.scope_start
           AND u.scope_end IS NOT DISTINCT FROM n.scope_end AND u.scope_xmin IS NOT DISTINCT FROM n.scope_xmin)"""
)
def catalog_with_deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records are handed in again twice, while a third of the stores is gone: those are not reused, and none is added twice."""
    records = artifacts(spark, sf_dir)
    standing = records.filter("seq % 3 <> 0")
    # every record gets a store of its own, named after it
    own = records.withColumns({"path": F.concat(F.lit("store/"), "artifact_id"), "asset_paths": F.array().cast("array<string>")})
    existing = standing.select(F.concat(F.lit("store/"), "artifact_id").alias("path"))
    again = own.withColumn("artifact_id", F.concat(F.lit("again-"), "artifact_id"))
    twice = again.union(again.withColumn("artifact_id", F.concat(F.lit("more-"), "artifact_id")))
    after = c.upsert_artifact(own, twice, existing_paths=existing)
    return after.agg(
        F.sum(F.col("artifact_id").rlike("again-").cast("bigint")).alias("added"),
        F.sum((~F.col("artifact_id").rlike("again-")).cast("bigint")).alias("before"),
        F.count_distinct("artifact_id").alias("ids"),
    )
