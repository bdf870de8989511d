"""Queries that append, stream, rebuild and sync."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import query
from checks.views import GRID, daily_times, hourly_cube, now, on_grid, precip_cube, table, with_views
from gridtide.errors import UnsafeStoreError
from gridtide.functions.periods import period_id
from gridtide.operators import catalog as c
from gridtide.operators.combine import find_gaps, pending_periods
from gridtide.operators.reduce import coverage
from gridtide.plans.derived import artifact_row, materialize_resampled
from gridtide.plans.ingest import ingest
from gridtide.plans.sync import APPEND, REMATERIALIZE, TEMPLATE_SCHEMA, plan_sync, record_coverages, run_sync
from gridtide.session import scratch_path
from gridtide.streaming.append import append_from, append_missing, rematerialize, stream_append
from gridtide.streaming.resample import stream_resample
from gridtide.streaming.store import PeriodStore

TEMPLATE = {"id": "temperature", "variable": "t2m", "transforms": ["kelvin_to_celsius"]}
CELSIUS_SQL = with_views("hourly") + "SELECT t, y, x, ROUND(t2m - 273.15, 6) AS t2m FROM hourly"


def rounded(cube: DataFrame, name: str) -> DataFrame:
    return cube.withColumn(name, F.round(name, 6))


@query(
    """WITH days AS (SELECT UNNEST(GENERATE_SERIES((SELECT MIN(l_shipdate) FROM lineitem), (SELECT MAX(l_shipdate) FROM lineitem),
                     INTERVAL 1 DAY)) AS t)
       SELECT STRFTIME(t, '%Y-%m-%d') AS period_id FROM days WHERE t NOT IN (SELECT DATE_TRUNC('day', o_orderdate) FROM orders)"""
)
def days_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the shipments that no order was placed on."""
    bounds = daily_times(spark, sf_dir).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    wanted = bounds.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("t"))
    stored = table(spark, sf_dir, "orders").select(period_id("o_orderdate", "daily").alias("period_id")).distinct()
    return pending_periods(wanted.select(period_id("t", "daily").alias("period_id")), stored)


@query(
    """WITH days AS (SELECT UNNEST(GENERATE_SERIES((SELECT MIN(o_orderdate) FROM orders), (SELECT MAX(o_orderdate) FROM orders),
                     INTERVAL 1 DAY)) AS t)
       SELECT t, STRFTIME(t, '%Y-%m-%d') AS period_id FROM days WHERE t NOT IN (SELECT o_orderdate FROM orders)"""
)
def days_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_gaps(table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("t")), "daily")


@query(CELSIUS_SQL)
def appended_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten days in the middle are stored first; then all missing hours, before and behind; then nothing."""
    cube = hourly_cube(spark, sf_dir)
    store = PeriodStore(spark, scratch_path(spark, "hours"), "hourly")
    source = _any_shape(cube)
    append_missing(source, store, TEMPLATE, "2024-01-10T00", "2024-01-19T23")
    append_missing(source, store, TEMPLATE, "2024-01-01T00", "2024-01-31T23")
    append_missing(source, store, TEMPLATE, "2024-01-01T00", "2024-01-31T23")
    return rounded(_only_cells(store.read()), "t2m").select("t", "y", "x", "t2m")


def _any_shape(cube: DataFrame) -> DataFrame:
    """Sparse hours made dense over the ten by ten grid, since a store wants one shape."""
    hours = cube.select("t").distinct()
    every = hours.select("t", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("n"))
    cells = every.select("t", F.floor(F.col("n") / 10).cast("bigint").alias("y"), (F.col("n") % 10).cast("bigint").alias("x"))
    return cells.join(cube, ["t", "y", "x"], "left")


def _only_cells(cube: DataFrame) -> DataFrame:
    return cube.filter(F.col("t2m").isNotNull())


@query(
    """SELECT STRFTIME(l_shipdate, '%Y-%m') AS period_id, COUNT(DISTINCT CAST(FLOOR(l_suppkey / 10.0) AS BIGINT) % 10) AS ny,
              COUNT(DISTINCT l_suppkey % 10) AS nx, COUNT(*) AS cells FROM lineitem GROUP BY 1"""
)
def period_shapes_of_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridtide.streaming.store import period_shapes

    items = table(spark, sf_dir, "lineitem")
    rows = items.select(period_id("l_shipdate", "monthly").alias("period_id"), *on_grid("l_suppkey"))
    return period_shapes(rows).drop("cell_hash")


@query(
    with_views("daily")
    + """SELECT k, STRFTIME(MIN(t), '%Y-%m-%d') AS "start", STRFTIME(MAX(t), '%Y-%m-%d') AS "end", 0.0 AS xmin, 9.0 AS xmax, 0.0 AS ymin, 9.0 AS ymax
         FROM daily JOIN (VALUES (1, DATE '1996-03-01', DATE '1996-12-31'), (2, DATE '1995-05-01', DATE '1996-12-31'),
                                 (3, DATE '1995-05-01', DATE '1999-02-28')) v(k, a, z) ON t >= a AND t <= z GROUP BY k"""
)
def coverage_by_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store covers after each of three appends, told by its ledger alone."""
    cube = _any_shape(precip_cube(spark, sf_dir))
    store = PeriodStore(spark, scratch_path(spark, "covered"), "daily")
    reached = []
    for k, (start, end) in enumerate((("1996-03-01", "1996-12-31"), ("1995-05-01", "1996-12-31"), ("1995-05-01", "1999-02-28")), 1):
        append_missing(cube, store, {"variable": "precip"}, start, end)
        reached.append((k, *store.coverage().select("start", "end", "xmin", "xmax", "ymin", "ymax").first()))
    # told at once, since plans over the same folder at different times count as the same to Spark
    return spark.createDataFrame(reached, "k int, start string, end string, xmin double, xmax double, ymin double, ymax double")


@query("SELECT DISTINCT STRFTIME(l_shipdate, '%G-W%V') AS period_id FROM lineitem")
def stored_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods a store knows of, after a rebuild by week."""
    weeks = precip_cube(spark, sf_dir).groupBy(F.date_trunc("week", "t").cast("timestamp_ntz").alias("t"), "y", "x")
    store = PeriodStore(spark, scratch_path(spark, "weeks"), "weekly")
    dense = _any_shape(weeks.agg(F.sum("precip").alias("precip")))
    rematerialize(dense, store, {"variable": "precip"}, "1990-W01", "2010-W52")
    return store.committed_periods()


@query(CELSIUS_SQL)
def streamed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed folder per day streamed into a store that already holds two days; run twice."""
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "streamed")
    dense = _any_shape(hourly_cube(spark, sf_dir))
    dense.repartition(F.to_date("t")).write.parquet(landing)
    store = PeriodStore(spark, path, "hourly")
    append_missing(dense, store, TEMPLATE, "2024-01-05T00", "2024-01-06T23")
    for _ in range(2):
        stream, _progress = stream_append(
            spark, landing, dense.schema, store, TEMPLATE, scratch_path(spark, "stream-state")
        )
        stream.awaitTermination()
    return rounded(_only_cells(store.read()), "t2m").select("t", "y", "x", "t2m")


@query(
    with_views("hourly")
    + """SELECT TIME_BUCKET(INTERVAL '2 days', t, TIMESTAMP '2024-01-01') AS t, y, x, ROUND(SUM(t2m), 6) AS t2m FROM hourly
         WHERE t < (SELECT TIME_BUCKET(INTERVAL '2 days', MAX(t), TIMESTAMP '2024-01-01') FROM hourly) GROUP BY 1, 2, 3"""
)
def streamed_two_day_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-day sums of a stream of hours; the bin the watermark has not passed stays out."""
    landing, out = scratch_path(spark, "hours"), scratch_path(spark, "sums")
    cube = hourly_cube(spark, sf_dir)
    cube.write.parquet(landing)
    rows = spark.readStream.schema(cube.schema).parquet(landing)
    sums = stream_resample(rows, "2D", "sum", "2024-01-01", watermark="0 seconds")
    stream = (
        sums.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "sums-state"))
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return rounded(spark.read.parquet(out), "t2m").select("t", "y", "x", "t2m")


@query(
    with_views("daily")
    + """SELECT DATE_TRUNC('month', t) AS t, y, x, ROUND(SUM(precip), 6) AS precip FROM daily
         WHERE t >= TIMESTAMP '1995-02-01' AND t < DATE_TRUNC('month', (SELECT MAX(t) FROM daily)) GROUP BY 1, 2, 3"""
)
def streamed_monthly_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sums of a stream that is stopped in the middle of a month and goes on from its checkpoint."""
    landing, out, state = (scratch_path(spark, n) for n in ("days", "months", "months-state"))
    cube = precip_cube(spark, sf_dir)
    for rows in (cube.filter("t < TIMESTAMP_NTZ'1998-05-17'"), cube.filter("t >= TIMESTAMP_NTZ'1998-05-17'")):
        rows.write.mode("append").parquet(landing)
        source = spark.readStream.schema(cube.schema).parquet(landing)
        sums = stream_resample(source, "MS", "sum", "1995-01-02", watermark="0 seconds")
        writer = sums.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(out), "precip").select("t", "y", "x", "precip")


@query(
    with_views("daily")
    + """SELECT t, y, x, ROUND(precip, 6) AS precip FROM daily WHERE t >= TIMESTAMP '1996-01-01' AND t < TIMESTAMP '2001-01-01'"""
)
def rebuilt_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with wrong values for two years is rebuilt over five; the rebuild takes over as a whole."""
    cube = _any_shape(precip_cube(spark, sf_dir))
    store = PeriodStore(spark, scratch_path(spark, "rebuilt"), "daily")
    wrong = cube.withColumn("precip", F.lit(-1.0))
    rematerialize(wrong, store, {"variable": "precip"}, "1996-01-01", "1997-12-31")
    rematerialize(cube, store, {"variable": "precip"}, "1996-01-01", "2000-12-31")
    return rounded(store.read().filter("precip IS NOT NULL"), "precip").select("t", "y", "x", "precip")


def _template_row(name: str, kind: str, execution: str, policy: str | None) -> tuple:
    availability = None if policy is None else (policy, None, None, None, None, None, None)
    return (name, kind, execution, "daily", availability, *(None,) * 5, "P1D", None, None)


SYNCED_SQL = ", ".join(
    f"('{name}', {action}, '{status}', DATE '{start}', DATE '{stop}')"
    for name, action, status, start, stop in (
        ("append", "'append'", "completed", "1995-01-02", "2001-08-01"),
        ("broken", "NULL", "failed", "1995-01-02", "1999-01-01"),
        ("failing", "'append'", "failed", "1995-01-02", "1999-01-01"),
        ("fixed", "'not_syncable'", "not_syncable", "1995-01-02", "1999-01-01"),
        ("ready", "'no_op'", "up_to_date", "1995-01-02", "2001-08-01"),
        ("rebuild", "'rematerialize'", "completed", "1995-01-02", "2001-08-01"),
    )
)


@query(
    with_views("daily")
    + f"""SELECT dataset_id, t, y, x, ROUND(precip, 6) AS precip, status, action,
                 STRFTIME(stop - INTERVAL 1 DAY, '%Y-%m-%d') AS recorded_end
          FROM daily JOIN (VALUES {SYNCED_SQL}) v(dataset_id, action, status, start, stop) ON t >= start AND t < stop"""
)
def synced_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six recorded stores are planned and brought up to the last complete month.

    One is appended to, one rebuilt, one is current and one static; one has an unreadable end and one fails, and both
    leave the others to go on. The catalog then names the new ends.
    """
    cube = _any_shape(precip_cube(spark, sf_dir))
    path = scratch_path(spark, "dense")
    cube.write.parquet(path)
    cube = spark.read.parquet(path)
    catalog = c.CatalogTable(spark, scratch_path(spark, "catalog"))
    rows = {
        "append": ("temporal", APPEND),
        "broken": ("temporal", REMATERIALIZE),
        "failing": ("temporal", APPEND),
        "fixed": ("static", APPEND),
        "ready": ("temporal", APPEND),
        "rebuild": ("temporal", REMATERIALIZE),
    }
    stores, records = {}, []
    for name in rows:
        stores[name] = PeriodStore(spark, scratch_path(spark, name), "daily")
        end = "2001-07-31" if name == "ready" else "1998-12-31"
        append_missing(cube, stores[name], {"id": name, "variable": "precip"}, "1995-01-02", end)
        record = artifact_row(
            spark,
            coverage(stores[name].read(), "daily"),
            dataset_id=name,
            source_dataset_id=None,
            name=name,
            variable="precip",
            period_type="daily",
            fmt=c.LEDGER_FORMAT if name != "broken" else c.CUBE_FORMAT,
            path=stores[name].path,
            start="1995-01-02",
            end=end,
            bbox=None,
            now=now(),
        )
        if name == "broken":
            temporal = F.col("coverage.temporal").withField("end", F.lit("oops"))
            record = record.withColumn("coverage", F.col("coverage").withField("temporal", temporal))
        records.append(record.withColumn("seq", F.lit(len(records)).cast("bigint")))
    catalog.replace(reduce(DataFrame.unionByName, records))
    templates = spark.createDataFrame(
        [_template_row(n, k, e, None if k == "static" else "complete_month") for n, (k, e) in rows.items()], TEMPLATE_SCHEMA
    )
    periods = [s.committed_periods().withColumn("dataset_id", F.lit(n)) for n, s in stores.items() if n != "broken"]
    asked = spark.createDataFrame([(n, None) for n in rows], "dataset_id string, requested_end string")
    plan = plan_sync(catalog.read(), templates, reduce(DataFrame.unionByName, periods), asked, now())

    def template(row) -> dict:
        fails = ["no_such_transform"] if row["dataset_id"] == "failing" else []
        return {"id": row["dataset_id"], "variable": "precip", "transforms": fails}

    def append(row):
        return append_missing(cube, stores[row["dataset_id"]], template(row), row["delta_start"], row["delta_end"])

    def rebuild(row):
        return rematerialize(cube, stores[row["dataset_id"]], template(row), row["current_start"], row["target_end"])

    def note(finished) -> None:
        names = [row["dataset_id"] for row, _ in finished]
        record_coverages(catalog, {name: stores[name].coverage() for name in names}, now())

    outcomes = run_sync(plan, {APPEND: append, REMATERIALIZE: rebuild}, record_all=note)
    ends = {r["dataset_id"]: r["end"] for r in catalog.read().select("dataset_id", "coverage.temporal.end").collect()}
    ends["broken"] = "1998-12-31" if ends["broken"] == "oops" else None  # left as it was
    done = []
    for outcome in outcomes:
        name = outcome["dataset_id"]
        notes = {"dataset_id": name, "status": outcome["status"], "action": outcome["action"], "recorded_end": ends[name]}
        rows_of = rounded(stores[name].read().filter("precip IS NOT NULL"), "precip").select("t", "y", "x", "precip")
        done.append(rows_of.withColumns({k: F.lit(v).cast("string") for k, v in notes.items()}))
    return reduce(DataFrame.unionByName, done)


@query(
    with_views("hourly")
    + "SELECT COUNT(*) AS n, 'refused' AS outcome FROM hourly"
)
def refused_first_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that no ledger and no announced write explains: an append refuses to touch them."""
    cube = hourly_cube(spark, sf_dir)
    store = PeriodStore(spark, scratch_path(spark, "unsafe"), "hourly")
    data = f"{store.data_path(0)}/batch=unknown"
    cube.write.parquet(data)
    try:
        append_missing(_any_shape(cube), store, TEMPLATE, "2024-01-01T00", "2024-01-31T23")
        outcome = "written"
    except UnsafeStoreError:
        outcome = "refused"
    return spark.read.parquet(data).agg(F.count("*").alias("n")).withColumn("outcome", F.lit(outcome))


class ShipmentDays:
    """A source adapter over the shipments: daily rain on the grid of the keys."""

    def __init__(self, cube: DataFrame) -> None:
        self.cube = cube

    def grid(self, bbox):
        return GRID

    def periods(self, start: str, end: str) -> DataFrame:
        days = self.cube.select(period_id("t", "daily").alias("period_id")).distinct()
        return days.filter(F.col("period_id").between(start, end))

    def fetch(self, periods: DataFrame, bbox) -> DataFrame:
        keyed = self.cube.withColumn("period_id", period_id("t", "daily"))
        return keyed.join(periods.select("period_id"), "period_id", "left_semi").drop("period_id")


@query(
    with_views("daily")
    + "SELECT t, y, x, ROUND(precip, 6) AS precip FROM daily WHERE t < TIMESTAMP '2001-01-01'"
)
def adapter_appended_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that a source adapter offers, appended in two overlapping runs up to the end of 2000."""
    adapter = ShipmentDays(_any_shape(precip_cube(spark, sf_dir)))
    store = PeriodStore(spark, scratch_path(spark, "adapter"), "daily")
    append_from(adapter, store, {"variable": "precip"}, "1990-01-01", "1997-06-30")
    append_from(adapter, store, {"variable": "precip"}, "1996-01-01", "2000-12-31")
    return rounded(store.read().filter("precip IS NOT NULL"), "precip").select("t", "y", "x", "precip")


@query(
    with_views("daily")
    + """SELECT t, y, x, ROUND(precip, 6) AS precip, 'published' AS status, '2000-12-31' AS recorded_end, CAST(1 AS BIGINT) AS records
         FROM daily WHERE t < TIMESTAMP '2001-01-01'"""
)
def ingested_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset ingested twice, first to 1997 and then to 2000: one record, brought up to date and published."""
    cube = _any_shape(precip_cube(spark, sf_dir))
    store = PeriodStore(spark, scratch_path(spark, "ingested"), "daily")
    catalog = c.CatalogTable(spark, scratch_path(spark, "catalog"))
    template = {"id": "rain", "variable": "precip"}
    ingest(cube, store, catalog, template, "1995-01-02", "1997-12-31", now())
    record = ingest(cube, store, catalog, template, "1995-01-02", "2000-12-31", now(), publish=True)
    row = record.select("publication.status", F.col("coverage.temporal.end").alias("recorded_end")).first()
    done = rounded(store.read().filter("precip IS NOT NULL"), "precip").select("t", "y", "x", "precip")
    notes = {"status": row["status"], "recorded_end": row["recorded_end"]}
    return done.withColumns({**{k: F.lit(v) for k, v in notes.items()}, "records": F.lit(catalog.read().count())})


@query(
    with_views("daily")
    + """SELECT t, y, x, ROUND(precip, 6) AS precip, 'rain_ms_sum' AS dataset_id, '1995-01' AS scope_start, '2001-10' AS scope_end,
                '1995-02' AS cov_start, 'published' AS status, CAST(1 AS BIGINT) AS records
         FROM (SELECT DATE_TRUNC('month', t) AS t, y, x, SUM(precip) AS precip FROM daily GROUP BY 1, 2, 3)
         WHERE t >= TIMESTAMP '1995-02-01' AND t < TIMESTAMP '2001-11-01'"""
)
def derived_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sums as a dataset of their own: resampled, written, recorded and published."""
    catalog = c.CatalogTable(spark, scratch_path(spark, "catalog"))
    record = materialize_resampled(
        spark,
        catalog,
        precip_cube(spark, sf_dir),
        scratch_path(spark, "derived"),
        source_dataset_id="rain",
        source_period_type="daily",
        variable="precip",
        frequency="MS",
        method="sum",
        start="1995-01-01",
        end="2001-12-31",
        now=now(),
    )
    row = record.select(
        "dataset_id",
        "path",
        F.col("request_scope.start").alias("scope_start"),
        F.col("request_scope.end").alias("scope_end"),
        F.col("coverage.temporal.start").alias("cov_start"),
        "publication.status",
    ).first()
    notes = {name: F.lit(row[name]) for name in ("dataset_id", "scope_start", "scope_end", "cov_start", "status")}
    cube = spark.read.parquet(row["path"]).select("t", "y", "x", F.round("precip", 6).alias("precip"))
    return cube.withColumns({**notes, "records": F.lit(catalog.read().count())})
