import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridtide.errors import NoDataError, ShapeError, UnsafeStoreError
from gridtide.operators.reduce import coverage
from gridtide.session import scratch_path
from gridtide.streaming.append import append_missing, rematerialize, stream_append
from gridtide.streaming.resample import LateRows, stream_resample
from gridtide.streaming.store import PeriodStore

TEMPLATE = {"id": "rain", "variable": "precip"}
SCHEMA = "t timestamp_ntz, y double, x double, precip double"


@pytest.fixture
def days(spark):
    rows = [(dt.datetime(2026, 1, d), 0.0, 0.0, float(d)) for d in (1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def store(spark):
    return PeriodStore(spark, scratch_path(spark, "store"), "daily")


def stored(store):
    return sorted((r["t"].day, r["precip"]) for r in store.read().collect())


def test_second_run_writes_nothing(days, store):
    assert append_missing(days, store, TEMPLATE, "2026-01-01", "2026-01-03") == 3
    assert append_missing(days, store, TEMPLATE, "2026-01-01", "2026-01-03") == 0
    assert stored(store) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_gap_before_the_newest_is_filled(days, store):
    assert append_missing(days, store, TEMPLATE, "2026-01-02", "2026-01-02") == 1
    assert append_missing(days, store, TEMPLATE, "2026-01-01", "2026-01-03") == 2
    assert [d for d, _ in stored(store)] == [1, 2, 3]


def test_empty_range_and_missing_store(days, store):
    assert store.committed_periods().isEmpty()
    assert append_missing(days, store, TEMPLATE, "2026-01-03", "2026-01-01") == 0
    with pytest.raises(FileNotFoundError):
        store.read()


def test_other_shape_stops_but_keeps_what_came_before(spark, days, store):
    bad = days.unionByName(spark.createDataFrame([(dt.datetime(2026, 1, 2), 1.0, 0.0, 9.0)], SCHEMA))
    with pytest.raises(ShapeError, match="has spatial shape"):
        append_missing(bad, store, TEMPLATE, "2026-01-01", "2026-01-03")
    assert stored(store) == [(1, 1.0)]
    assert append_missing(days, store, TEMPLATE, "2026-01-01", "2026-01-03") == 2
    assert stored(store) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_other_cells_of_same_shape(spark, days, store):
    moved = days.withColumn("x", F.when(F.dayofmonth("t") == 3, 5.0).otherwise(F.col("x")))
    with pytest.raises(ShapeError, match="another set of cells"):
        append_missing(moved, store, TEMPLATE, "2026-01-01", "2026-01-03", same_cells=True)
    assert [d for d, _ in stored(store)] == [1, 2]


def test_values_without_ledger_are_not_overwritten(days, store):
    days.write.parquet(store.data_path(0) + "/batch=x")
    with pytest.raises(UnsafeStoreError):
        append_missing(days, store, TEMPLATE, "2026-01-01", "2026-01-03")


def test_strange_folder_is_refused(days, spark, store):
    days.write.parquet(store.path)
    with pytest.raises(UnsafeStoreError):
        append_missing(days, store, TEMPLATE, "2026-01-01", "2026-01-03")


def test_crash_between_values_and_ledger(days, store):
    store.announce("lost", 0)
    store.write_values(days.withColumn("precip", F.lit(-1.0)), "lost", 0)
    assert append_missing(days, store, TEMPLATE, "2026-01-01", "2026-01-03") == 3
    assert stored(store) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_transforms_run_on_the_way_in(days, store):
    append_missing(days, store, {**TEMPLATE, "transforms": ["metres_to_mm"]}, "2026-01-01", "2026-01-03")
    cube = store.read()
    assert stored(store) == [(1, 1000.0), (2, 2000.0), (3, 3000.0)]
    assert cube.schema["precip"].metadata["units"] == "mm"


def test_rebuild_takes_over(days, store):
    rematerialize(days.withColumn("precip", F.lit(0.0)), store, TEMPLATE, "2026-01-01", "2026-01-02")
    assert rematerialize(days, store, TEMPLATE, "2026-01-01", "2026-01-03") == 3
    assert stored(store) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    with pytest.raises(NoDataError):
        rematerialize(days, store, TEMPLATE, "2027-01-01", "2027-01-02")
    assert len(stored(store)) == 3


def test_stream_is_replay_safe(spark, days, store):
    landing = scratch_path(spark, "landing")
    append_missing(days, store, TEMPLATE, "2026-01-02", "2026-01-02")
    days.repartition(3, "t").write.parquet(landing)
    counts = []
    for _ in range(2):
        query, progress = stream_append(spark, landing, SCHEMA, store, TEMPLATE, scratch_path(spark, "state"))
        query.awaitTermination()
        counts.append((progress.periods_written, progress.periods_skipped))
    assert counts == [(2, 1), (0, 3)]
    assert stored(store) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_stream_goes_on_from_its_checkpoint(spark, days, store):
    landing, state = scratch_path(spark, "landing"), scratch_path(spark, "state")
    for day in (1, 2, 3):
        days.filter(F.dayofmonth("t") == day).write.mode("append").parquet(landing)
        query, progress = stream_append(spark, landing, SCHEMA, store, TEMPLATE, state)
        query.awaitTermination()
        assert progress.periods_written == 1
    assert len(stored(store)) == 3


def test_stream_bins_and_late_rows(spark):
    landing, state, out = (scratch_path(spark, n) for n in ("landing", "state", "out"))

    def land(*moments):
        rows = [(dt.datetime.fromisoformat(m), 0.0, 0.0, 1.0) for m in moments]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landing)

    def run():
        rows = spark.readStream.schema(SCHEMA).parquet(landing)
        bins = stream_resample(rows, "W-MON", "sum", "2026-01-05", watermark="0 seconds")
        query = (
            bins.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return query

    late = LateRows(spark)
    land("2026-01-04T00:00", "2026-01-05T00:00", "2026-01-11T23:00")
    run()
    land("2026-01-13T00:00")
    run()
    land("2026-01-06T00:00", "2026-01-20T00:00")
    last = run()
    rows = spark.read.schema(SCHEMA).parquet(out).orderBy("t").collect()
    assert [(r["t"].day, r["precip"]) for r in rows] == [(5, 2.0), (12, 1.0)]
    assert late.of(last) >= 1
    late.close()


def test_late_rows_are_counted_over_all_triggers(spark):
    from types import SimpleNamespace as Event

    late = LateRows(spark)
    try:
        for n in range(250):
            operators = [Event(numRowsDroppedByWatermark=n % 2), Event(numRowsDroppedByWatermark=1)]
            late.onQueryProgress(Event(progress=Event(id="q", stateOperators=operators)))
        late.onQueryTerminated(Event(id="q"))
        assert late.of(Event(id="q", isActive=False)) == 125 + 250
    finally:
        late.close()


def test_a_stored_period_in_another_file_stops_the_stream(spark, days, store):
    landing, state = scratch_path(spark, "landing"), scratch_path(spark, "state")
    first = days.filter(F.dayofmonth("t") == 1)
    first.coalesce(1).write.mode("append").parquet(landing)
    query, progress = stream_append(spark, landing, SCHEMA, store, TEMPLATE, state)
    query.awaitTermination()
    assert progress.periods_written == 1
    late = days.withColumn("x", F.col("x") + 1)
    late.filter(F.dayofmonth("t") < 3).coalesce(1).write.mode("append").parquet(landing)
    query, progress = stream_append(spark, landing, SCHEMA, store, TEMPLATE, state)
    with pytest.raises(Exception, match="2026-01-01 is stored already"):
        query.awaitTermination()
    assert stored(store) == [(1, 1.0)] and progress.periods_written == 0


def test_two_files_of_one_trigger_make_one_period(spark, days, store):
    landing, state = scratch_path(spark, "landing"), scratch_path(spark, "state")
    day = days.filter(F.dayofmonth("t") == 1)
    for shift in (0, 1):
        day.withColumn("x", F.col("x") + shift).coalesce(1).write.mode("append").parquet(landing)
    query, progress = stream_append(spark, landing, SCHEMA, store, TEMPLATE, state)
    query.awaitTermination()
    assert progress.periods_written == 1 and store.read().count() == 2


def test_shapes_are_counted_once_without_expanding_rows(days):
    from gridtide.streaming.store import period_shapes

    plan = period_shapes(days.select(F.lit("p").alias("period_id"), "y", "x"))._jdf.queryExecution().toString()
    assert "Expand" not in plan


def test_ranges_prune_buckets_in_both_stores(spark, store):
    from gridtide.sources.cube import cut_by_bucket, read_cube, write_cube

    rows = [(dt.datetime(2026, 1, 1) + dt.timedelta(days=n), 0.0, 0.0, float(n)) for n in range(200)]
    cube = spark.createDataFrame(rows, SCHEMA)
    append_missing(cube, store, TEMPLATE, "2026-01-01", "2026-07-19")
    path = scratch_path(spark, "cube")
    write_cube(cube, path, dataset_id="rain")
    for opened in (store.read("2026-03-01", "2026-03-31"), cut_by_bucket(read_cube(spark, path), "2026-03", "2026-03")):
        plan = opened._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(time_bucket" in plan
        assert opened.count() == 31
    assert store.read(end="2026-01-10").count() == 10 and store.read("2026-07-10").count() == 10


def test_coverage_comes_from_the_ledger(spark, store):
    rows = [(dt.datetime(2026, 1, d, 6), y, x, 1.0) for d in range(1, 8) for y in (4.0, 5.5) for x in (-2.0, 0.0, 7.25)]
    cube = spark.createDataFrame(rows, SCHEMA)
    for start, end in (("2026-01-03", "2026-01-04"), ("2026-01-01", "2026-01-06")):
        append_missing(cube, store, TEMPLATE, start, end)
        got = store.coverage()
        assert got.first() == coverage(store.read(), "daily").first()
        assert got.inputFiles() and all("/ledger/" in f for f in got.inputFiles())
    row = store.coverage("EPSG:25833").first()
    assert (row["start"], row["end"], row["xmax"], row["ymin"]) == ("2026-01-01", "2026-01-06", 7.25, 4.0)
    assert row["spatial_wgs84"] is not None


def test_coverage_of_an_empty_store_and_of_refused_periods(spark, days, store):
    assert store.coverage().first() == coverage(days.limit(0), "daily").first()
    bad = days.unionByName(spark.createDataFrame([(dt.datetime(2026, 1, 2), 1.0, 0.0, 9.0)], SCHEMA))
    with pytest.raises(ShapeError):
        append_missing(bad, store, TEMPLATE, "2026-01-01", "2026-01-03")
    assert store.coverage().first() == coverage(store.read(), "daily").first()


def test_coverage_of_a_ledger_without_extents_reads_the_values(spark, days, store):
    append_missing(days, store, TEMPLATE, "2026-01-01", "2026-01-03")
    old = store.ledger().drop("t_min", "t_max", "x_min", "x_max", "y_min", "y_max").collect()
    kept = spark.createDataFrame(old, store.ledger().drop("t_min", "t_max", "x_min", "x_max", "y_min", "y_max").schema)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(store.ledger_path(0))
    assert store.coverage().first() == coverage(store.read(), "daily").first()


def test_a_second_ingest_reads_no_values_of_the_first(spark, days, store):
    from gridtide.operators.catalog import CatalogTable
    from gridtide.plans.ingest import ingest

    catalog = CatalogTable(spark, scratch_path(spark, "catalog"))
    template = {"id": "rain", "variable": "precip"}
    ingest(days, store, catalog, template, "2026-01-01", "2026-01-02", F.lit("2026-02-01 00:00:00"))
    first = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store.data_path(0))
    files = first.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    hidden = store.data_path(0) + "-away"
    batch = [s.getPath().getName() for s in files.listStatus(first)][0]
    files.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.data_path(0)}/{batch}"), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(hidden))
    record = ingest(days, store, catalog, template, "2026-01-01", "2026-01-03", F.lit("2026-02-02 00:00:00")).first()
    assert record["coverage"]["temporal"]["end"] == "2026-01-03" and record["coverage"]["temporal"]["start"] == "2026-01-01"


def run_months(spark, landing, out, state, frequency, start, method="sum"):
    rows = spark.readStream.schema(SCHEMA).parquet(landing)
    bins = stream_resample(rows, frequency, method, start, watermark="0 seconds")
    writer = bins.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()
    return sorted((r["t"], r["x"], r["precip"]) for r in spark.read.schema(SCHEMA).parquet(out).collect())


def test_calendar_bins_come_out_when_the_next_bin_is_reached(spark):
    landing, out, state = (scratch_path(spark, n) for n in ("landing", "months", "state"))

    def land(*moments):
        rows = [(dt.datetime.fromisoformat(m), 0.0, x, 1.0) for m in moments for x in (0.0, 1.0)]
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(landing)

    def go():
        return [(t.isoformat()[:10], v) for t, x, v in run_months(spark, landing, out, state, "MS", "2026-01-01") if x == 1.0]

    land("2026-01-01T00:00", "2026-01-31T23:59:59.999999", "2026-02-10T00:00", "2025-12-31T23:00")
    assert go() == [("2026-01-01", 2.0)]
    land("2026-02-11T00:00", "2026-02-28T23:59:59.5")
    assert go() == [("2026-01-01", 2.0)]  # stopped and started again within a month
    land("2026-03-01T00:00", "2026-02-10T06:00")
    assert go() == [("2026-01-01", 2.0), ("2026-02-01", 4.0)]
    land("2026-02-20T00:00", "2026-05-01T00:00")  # too late, and a month without rows
    assert go() == [("2026-01-01", 2.0), ("2026-02-01", 4.0), ("2026-03-01", 1.0)]


@pytest.mark.parametrize(
    "frequency, start, want",
    [
        ("2MS", "2025-11-01", [("2025-11-01", 61.0), ("2026-01-01", 59.0), ("2026-03-01", 61.0)]),
        ("QS", "2025-11-01", [("2026-01-01", 90.0)]),
        ("YS", "2025-01-01", [("2025-01-01", 61.0)]),
    ],
)
def test_calendar_bins_of_several_units(spark, frequency, start, want):
    landing, out, state = (scratch_path(spark, n) for n in ("landing", "bins", "state"))
    days = spark.sql("SELECT explode(sequence(DATE'2025-11-01', DATE'2026-05-05'))").selectExpr(
        "CAST(col AS timestamp_ntz) AS t", "0D AS y", "0D AS x", "1D AS precip"
    )
    days.write.parquet(landing)
    assert [(t.isoformat()[:10], v) for t, _, v in run_months(spark, landing, out, state, frequency, start)] == want


def test_a_tiled_store_holds_the_same_values(spark):
    cube = spark.range(40 * 40 * 3).selectExpr(
        "CAST(DATE'2026-01-01' + CAST(id % 3 AS INT) AS timestamp_ntz) AS t", "CAST(id DIV 120 AS DOUBLE) AS y", "CAST(id DIV 3 % 40 AS DOUBLE) AS x", "id * 0.5 AS precip"
    )
    stores = [PeriodStore(spark, scratch_path(spark, "tiled"), "daily", tile=tile) for tile in (None, (8.0, 8.0))]
    for one in stores:
        append_missing(cube, one, TEMPLATE, "2026-01-01", "2026-01-03")
    plain, tiled = (sorted(tuple(r) for r in s.read("2026-01-02", "2026-01-03").select("t", "y", "x", "precip").collect()) for s in stores)
    assert plain == tiled and len(plain) == 3200
