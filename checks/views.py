"""The given tables as cubes, zones and catalog tables: once for Spark, once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.periods import PERIOD_TYPES, period_id
from gridtide.operators.catalog import (
    BOX_TYPE,
    CUBE_FORMAT,
    FLAT_FORMAT,
    LEDGER_FORMAT,
    PUBLICATION_TYPE,
    PUBLISHED,
    UNPUBLISHED,
)
from gridtide.plans.sync import AVAILABILITY_TYPE
from gridtide.sources.grid import GridSpec

# The grid that the keys are mapped to: ten by ten cells of size one.
GRID = GridSpec(0.0, 1.0, 10, 0.0, 1.0, 10)

NOW = "2001-08-21 12:34:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_grid(key: str) -> tuple[Column, Column]:
    """Row and column of a key on the grid."""
    y = F.floor(F.col(key) / 10.0).cast("bigint") % 10
    return y.alias("y"), (F.col(key) % 10).alias("x")


# -- cubes ----------------------------------------------------------------

DAILY_SQL = """daily AS (
  SELECT l_shipdate AS t, CAST(FLOOR(l_suppkey / 10.0) AS BIGINT) % 10 AS y, l_suppkey % 10 AS x,
         SUM(l_quantity) AS precip, SUM(l_extendedprice) AS price, SUM(l_tax) AS tax
  FROM lineitem GROUP BY 1, 2, 3)"""

HOURLY_SQL = """hourly AS (
  SELECT DATE_TRUNC('hour', ts) AS t, CAST(FLOOR(user_id / 10.0) AS BIGINT) % 10 AS y, user_id % 10 AS x,
         AVG(value) AS t2m
  FROM events GROUP BY 1, 2, 3)"""

BANDS_SQL = """bands AS (
  SELECT DATE_TRUNC('hour', ts) AS t, CAST(FLOOR(user_id / 10.0) AS BIGINT) % 10 AS y, user_id % 10 AS x,
         event_type AS band, AVG(value) AS value
  FROM events GROUP BY 1, 2, 3, 4)"""

ZONES_SQL = """zones AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS zone_id, n_name AS name,
         2 * (n_nationkey % 5) - 0.5 AS x0, 2 * (n_nationkey % 5) + 1.5 AS x1,
         2 * FLOOR(n_nationkey / 5.0) - 0.5 AS y0, 2 * FLOOR(n_nationkey / 5.0) + 1.5 AS y1
  FROM nation)"""

# every cell of the grid with the zone around it
ASSIGNED_SQL = """assigned AS (
  SELECT z.zone_id, z.name, g.x, g.y
  FROM (SELECT a.r AS x, b.r AS y FROM RANGE(10) a(r), RANGE(10) b(r)) g
  JOIN zones z ON g.x > z.x0 AND g.x < z.x1 AND g.y > z.y0 AND g.y < z.y1)"""


def daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items on the grid, before they are summed up to the daily cube."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_shipdate").alias("t"),
        *on_grid("l_suppkey"),
        F.col("l_quantity").alias("precip"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("tax"),
    )


def daily_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_rows(spark, sf_dir)
    return rows.groupBy("t", "y", "x").agg(*[F.sum(v).alias(v) for v in ("precip", "price", "tax")])


def precip_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_cube(spark, sf_dir).select("t", "y", "x", "precip")


def daily_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of the daily cube, straight from the table it is built from."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("t"))


def hourly_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")
    return events.groupBy(hour, *on_grid("user_id")).agg(F.avg("value").alias("t2m"))


def hourly_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"))


def band_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")
    return events.groupBy(hour, *on_grid("user_id"), F.col("event_type").alias("band")).agg(F.avg("value").alias("value"))


# -- zones ----------------------------------------------------------------


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One square per nation, as features with a closed ring."""
    nation = table(spark, sf_dir, "nation")
    x0 = 2 * (F.col("n_nationkey") % 5) - 0.5
    y0 = 2 * F.floor(F.col("n_nationkey") / 5.0) - 0.5

    def corner(dx: float, dy: float) -> Column:
        return F.array((x0 + dx).cast("double"), (y0 + dy).cast("double"))

    ring = F.array(corner(0, 0), corner(2, 0), corner(2, 2), corner(0, 2), corner(0, 0))
    points = F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return nation.select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.col("n_name").alias("name"),
        F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string")).alias(
            "properties"
        ),
        F.struct(F.lit("Polygon").alias("type"), F.array(F.array(ring)).alias("coordinates")).alias("geometry"),
        F.array(points).alias("rings"),
    )


# -- catalog --------------------------------------------------------------


def sql_period(moment: str, period_type: str) -> str:
    return (
        f"CASE {period_type} WHEN 'hourly' THEN STRFTIME({moment}, '%Y-%m-%dT%H') "
        f"WHEN 'daily' THEN STRFTIME({moment}, '%Y-%m-%d') WHEN 'weekly' THEN STRFTIME({moment}, '%G-W%V') "
        f"WHEN 'monthly' THEN STRFTIME({moment}, '%Y-%m') WHEN 'yearly' THEN STRFTIME({moment}, '%Y') END"
    )


def sql_period_start(text: str, period_type: str) -> str:
    return (
        f"CASE {period_type} WHEN 'hourly' THEN TRY_STRPTIME({text}, '%Y-%m-%dT%H') "
        f"WHEN 'daily' THEN TRY_STRPTIME({text}, '%Y-%m-%d') "
        f"WHEN 'weekly' THEN TRY_STRPTIME({text} || '-1', '%G-W%V-%u') "
        f"WHEN 'monthly' THEN TRY_STRPTIME({text}, '%Y-%m') WHEN 'yearly' THEN TRY_STRPTIME({text}, '%Y') END"
    )


SQL_PERIOD_TYPE = (
    "CASE {0} % 5 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' "
    "WHEN 3 THEN 'monthly' ELSE 'yearly' END"
)

ARTIFACTS_SQL = f"""artifacts AS (
  SELECT o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) AS artifact_id, CAST(o_custkey AS VARCHAR) AS dataset_id,
         CASE WHEN o_custkey % 4 = 0 THEN 's' || o_custkey END AS source_dataset_id,
         'dataset ' || o_custkey AS dataset_name, 'v' || (o_custkey % 3) AS variable, pt AS period_type,
         CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'ledger'
              WHEN o_orderpriority[1] IN ('3', '4') THEN 'parquet' ELSE 'csv' END AS format,
         CASE WHEN o_orderkey % 11 <> 0 THEN 'store/' || o_orderkey END AS path,
         CASE WHEN o_orderkey % 2 = 0 THEN 'asset/' || o_orderkey END AS asset_path,
         {sql_period('o_orderdate', 'pt')} AS scope_start,
         CASE WHEN o_orderkey % 3 <> 0 THEN {sql_period("(o_orderdate + INTERVAL 40 DAY)", 'pt')} END AS scope_end,
         CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey % 7 AS DOUBLE) END AS scope_xmin,
         CASE WHEN o_orderkey % 7 = 0 THEN {sql_period("(o_orderdate + INTERVAL 365 DAY)", 'pt')}
              ELSE {sql_period('o_orderdate', 'pt')} END AS cov_start,
         CASE WHEN o_orderkey % 5 = 0 THEN {sql_period("(o_orderdate + INTERVAL 400 DAY)", 'pt')}
              ELSE {sql_period("(o_orderdate + INTERVAL 40 DAY)", 'pt')} END AS cov_end,
         CAST(o_custkey % 7 AS DOUBLE) AS xmin,
         CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_custkey % 7 + 1 AS DOUBLE) END AS xmax,
         o_orderdate AS created_at,
         CASE WHEN o_orderstatus = 'F' THEN 'published' ELSE 'unpublished' END AS status,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) END AS collection_id,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS published_at
  FROM (SELECT *, {SQL_PERIOD_TYPE.format('o_custkey')} AS pt FROM orders))"""

LATEST_SQL = """latest AS (
  SELECT * FROM artifacts
  QUALIFY ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, seq) = 1)"""

PATHS_SQL = """paths AS (
  SELECT DISTINCT 'store/' || l_orderkey AS path FROM lineitem
  UNION SELECT DISTINCT 'asset/' || l_orderkey FROM lineitem WHERE l_returnflag = 'N')"""


def period_type_of(key: str) -> Column:
    pick = F.col(key) % 5
    chain = F.when(pick == 0, PERIOD_TYPES[0])
    for index, name in enumerate(PERIOD_TYPES[1:4], 1):
        chain = chain.when(pick == index, name)
    return chain.otherwise(PERIOD_TYPES[4])


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as catalog records: a customer is a dataset, an order one of its versions."""
    orders = table(spark, sf_dir, "orders").withColumn("pt", period_type_of("o_custkey"))
    key, owner, made = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")

    def text(column: Column, prefix: str = "") -> Column:
        return F.concat(F.lit(prefix), column.cast("string"))

    def after(days: int) -> Column:
        return period_id(made + F.expr(f"INTERVAL {days} DAY"), F.col("pt"))

    corner = (owner % 7).cast("double")
    path = F.when(key % 11 != 0, text(key, "store/"))
    asset = F.when(key % 2 == 0, text(key, "asset/"))
    urgency = F.substring("o_orderpriority", 1, 1)
    published = F.col("o_orderstatus") == "F"
    scope_box = F.struct(corner.alias("xmin"), F.lit(0.0).alias("ymin"), (corner + 1).alias("xmax"), F.lit(1.0).alias("ymax"))
    spatial = F.struct(
        corner.alias("xmin"),
        F.lit(0.0).alias("ymin"),
        F.when(key % 13 != 0, corner + 1).alias("xmax"),
        F.lit(1.0).alias("ymax"),
    )
    return orders.select(
        key.alias("seq"),
        text(key).alias("artifact_id"),
        text(owner).alias("dataset_id"),
        F.when(owner % 4 == 0, text(owner, "s")).alias("source_dataset_id"),
        text(owner, "dataset ").alias("dataset_name"),
        text(owner % 3, "v").alias("variable"),
        F.col("pt").alias("period_type"),
        F.when(urgency.isin("1", "2"), LEDGER_FORMAT)
        .when(urgency.isin("3", "4"), CUBE_FORMAT)
        .otherwise(FLAT_FORMAT)
        .alias("format"),
        path.alias("path"),
        F.array_compact(F.array(asset)).alias("asset_paths"),
        F.array(text(owner % 3, "v")).alias("variables"),
        F.struct(
            period_id(made, F.col("pt")).alias("start"),
            F.when(key % 3 != 0, after(40)).alias("end"),
            F.when(owner % 2 == 0, scope_box).alias("bbox"),
        ).alias("request_scope"),
        F.struct(
            F.struct(
                F.when(key % 7 == 0, after(365)).otherwise(period_id(made, F.col("pt"))).alias("start"),
                F.when(key % 5 == 0, after(400)).otherwise(after(40)).alias("end"),
            ).alias("temporal"),
            spatial.alias("spatial"),
            F.lit(None).cast(BOX_TYPE).alias("spatial_wgs84"),
        ).alias("coverage"),
        made.alias("created_at"),
        F.struct(
            F.when(published, PUBLISHED).otherwise(UNPUBLISHED).alias("status"),
            F.when(published, text(owner)).alias("collection_id"),
            F.when(published, made).alias("published_at"),
            F.when(published, text(owner, "collections/")).alias("catalog_path"),
        )
        .cast(PUBLICATION_TYPE)
        .alias("publication"),
    )


def stored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    stores = items.select(F.concat(F.lit("store/"), F.col("l_orderkey").cast("string")).alias("path"))
    assets = items.filter(F.col("l_returnflag") == "N").select(
        F.concat(F.lit("asset/"), F.col("l_orderkey").cast("string")).alias("path")
    )
    return stores.unionByName(assets).distinct()


TEMPLATES_SQL = f"""templates AS (
  SELECT CAST(c_custkey AS VARCHAR) AS dataset_id,
         CASE (c_custkey // 5) % 3 WHEN 0 THEN 'temporal' WHEN 1 THEN 'release' ELSE 'static' END AS kind,
         CASE WHEN c_nationkey % 2 = 0 THEN 'append' ELSE 'rematerialize' END AS execution,
         {SQL_PERIOD_TYPE.format('c_custkey')} AS period_type,
         CASE c_custkey % 4 WHEN 1 THEN 'complete_month' WHEN 2 THEN 'lagged' WHEN 3 THEN 'release' END AS policy,
         c_nationkey % 6 <> 0 AS has_availability,
         CASE WHEN c_nationkey % 3 = 0 THEN 25 END AS complete_after_day, 5 AS lag_hours,
         CASE WHEN c_nationkey % 4 <> 0 THEN 30 END AS lag_days,
         CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey % 2 END AS latest_year_offset,
         CASE WHEN c_nationkey % 7 = 0 THEN 2000 END AS latest_year, c_nationkey % 8 = 0 AS allow_future,
         c_mktsegment AS short_name, 'mm' AS units, CASE WHEN c_nationkey % 2 = 0 THEN c_name END AS source
  FROM customer WHERE c_acctbal >= 0)"""


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as dataset templates; those in debt have none."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    kind = F.floor(key / 5) % 3
    availability = F.struct(
        F.when(key % 4 == 1, "complete_month").when(key % 4 == 2, "lagged").when(key % 4 == 3, "release").alias("policy"),
        F.when(nation % 3 == 0, 25).alias("complete_after_day"),
        F.lit(5).alias("lag_hours"),
        F.when(nation % 4 != 0, 30).alias("lag_days"),
        F.when(nation % 5 != 0, nation % 2).alias("latest_year_offset"),
        F.when(nation % 7 == 0, 2000).alias("latest_year"),
        (nation % 8 == 0).alias("allow_future"),
    ).cast(AVAILABILITY_TYPE)
    steps = F.when(key % 5 == 0, "PT1H").when(key % 5 == 1, "P1D").when(key % 5 == 2, "P1W").when(key % 5 == 3, "P1M")
    box = F.array(*[(v).cast("double") for v in (key % 7, F.lit(0), key % 7 + 2, F.lit(2))])
    return table(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0).select(
        key.cast("string").alias("dataset_id"),
        F.when(kind == 0, "temporal").when(kind == 1, "release").otherwise("static").alias("kind"),
        F.when(nation % 2 == 0, "append").otherwise("rematerialize").alias("execution"),
        period_type_of("c_custkey").alias("period_type"),
        F.when(nation % 6 != 0, availability).alias("availability"),
        F.col("c_mktsegment").alias("short_name"),
        F.lit("mm").alias("units"),
        F.lit("1 x 1").alias("resolution"),
        F.when(nation % 2 == 0, F.col("c_name")).alias("source"),
        F.lit(None).cast("string").alias("source_url"),
        steps.otherwise("P1Y").alias("iso_step"),
        box.alias("bbox"),
        F.struct(
            F.when(nation % 2 == 0, "blues").alias("colormap"),
            F.array(F.lit(0.0), F.lit(20.0)).alias("range"),
            F.lit(-9999.0).alias("nodata"),
        ).alias("display"),
    )


PERIODS_SQL = f"""stored_periods AS (
  SELECT dataset_id, CASE WHEN seq % 501 = 0 THEN 'oops' ELSE {sql_period("(created_at + INTERVAL 60 DAY)", 'period_type')} END
         AS period_id
  FROM artifacts WHERE status = 'published')"""


def stored_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stores of published datasets hold; a few texts are malformed."""
    later = F.col("created_at") + F.expr("INTERVAL 60 DAY")
    text = F.when(F.col("seq") % 501 == 0, "oops").otherwise(period_id(later, F.col("period_type")))
    records = artifacts(spark, sf_dir).filter(F.col("publication.status") == PUBLISHED)
    return records.select("dataset_id", text.alias("period_id"))


REQUESTS_SQL = f"""requests AS (
  SELECT CAST(c_custkey AS VARCHAR) AS dataset_id,
         CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '  '
              ELSE CASE WHEN c_custkey % 97 = 0 THEN 'soon'
                   ELSE {sql_period("(TIMESTAMP '1998-01-01' + INTERVAL (c_custkey % 1500) DAY)",
                                    SQL_PERIOD_TYPE.format('c_custkey'))} END END AS requested_end
  FROM customer WHERE c_mktsegment <> 'BUILDING')"""


def sync_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested ends in native format; some blank, some unreadable, some datasets without a request."""
    key = F.col("c_custkey")
    moment = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((key % 1500).cast("int"))
    native = period_id(moment, period_type_of("c_custkey"))
    wanted = F.when(key % 6 == 1, "  ").when(key % 6 != 0, F.when(key % 97 == 0, "soon").otherwise(native))
    return table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "BUILDING").select(
        key.cast("string").alias("dataset_id"), wanted.alias("requested_end")
    )


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def with_views(*names: str) -> str:
    """A WITH clause of the named views."""
    known = {
        "daily": DAILY_SQL,
        "hourly": HOURLY_SQL,
        "bands": BANDS_SQL,
        "zones": ZONES_SQL,
        "assigned": ASSIGNED_SQL,
        "artifacts": ARTIFACTS_SQL,
        "latest": LATEST_SQL,
        "paths": PATHS_SQL,
        "templates": TEMPLATES_SQL,
        "stored_periods": PERIODS_SQL,
        "requests": REQUESTS_SQL,
    }
    return "WITH " + ",\n".join(known[name] for name in names) + "\n"
