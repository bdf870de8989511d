import datetime as dt
import threading
import time

import pytest
from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from gridtide.errors import GridError, NoDataError, NotFoundError
from gridtide.operators import catalog as c
from gridtide.operators.reduce import axis_summary, coverage, variable_summary
from gridtide.plans.derived import materialize_resampled
from gridtide.plans.sync import APPEND, REMATERIALIZE, TEMPLATE_SCHEMA, plan_sync, record_coverages, run_sync
from gridtide.session import scratch_path
from gridtide.sources.cube import write_cube

BOX = (1.0, 2.0, 3.0, 4.0)


def record(seq, end, made, *, scope_end="same", start="2026-01-01", dataset="rain", fmt="ledger", status="published", path="p", period="daily"):
    scope_end = end if scope_end == "same" else scope_end
    return (
        seq, f"a{seq}", dataset, None, "Rain", "precip", period, fmt, path, [path] if path else [], ["precip"],
        (start, scope_end, BOX), ((start, end), BOX, None), dt.datetime.fromisoformat(made), (status, None, None, None),
    )


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), c.ARTIFACT_SCHEMA)


@pytest.fixture
def ask(spark):
    schema = f"request_id string, dataset_id string, request_scope {c.SCOPE_TYPE}"
    return lambda start, end, box=BOX: spark.createDataFrame([("q", "rain", (start, end, box))], schema)


def test_newest_version(spark, table):
    records = table(record(1, "2026-01-10", "2026-01-10"), record(2, "2026-01-11", "2026-01-11"))
    row = c.latest_per_dataset(records).first()
    assert (row["artifact_id"], row["coverage"]["temporal"]["end"]) == ("a2", "2026-01-11")
    plan = c.latest_per_dataset(records)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_tie_goes_to_the_first(table):
    records = table(record(2, "b", "2026-01-10"), record(1, "a", "2026-01-10"))
    assert c.latest_per_dataset(records).first()["artifact_id"] == "a1"


def test_unpublished_newest_hides(table):
    older, newer = record(1, "x", "2026-01-10"), record(2, "y", "2026-01-11", status="unpublished")
    assert c.latest_published(table(older, newer)).isEmpty()
    assert c.latest_published(table(older)).count() == 1
    assert c.latest_published(table(record(1, "x", "2026-01-10", fmt="csv"))).isEmpty()


def test_reuse(table, ask):
    longer = record(1, "2026-02-29", "2026-01-10", scope_end="2026-02-10")
    exact = record(2, "2026-02-10", "2026-01-11")
    assert c.find_existing(table(exact, longer), ask("2026-01-01", "2026-02-10")).first()["artifact_id"] == "a2"
    assert c.find_existing(table(longer), ask("2026-01-01", "2026-02-10")).isEmpty()
    clamped = record(3, "2026-01-31", "2026-01-10")
    assert c.find_existing(table(clamped), ask("2026-01-01", "2026-02-10")).isEmpty()
    open_end = record(4, "2026-02-10", "2026-01-10", scope_end=None)
    assert c.find_existing(table(open_end), ask("2026-01-01", None)).count() == 1
    assert c.find_existing(table(open_end), ask("2026-01-01", None, None)).isEmpty()


def test_missing_storage_is_not_reused(spark, table, ask):
    paths = spark.createDataFrame([("q",)], "path string")
    assert c.find_existing(table(record(1, "e", "2026-01-10")), ask("2026-01-01", "e"), paths).isEmpty()
    kept = c.materialized(table(record(1, "e", "2026-01-10", path="q"), record(2, "e", "2026-01-10", path=None)), paths)
    assert [r["artifact_id"] for r in kept.collect()] == ["a1"]


def test_scope_rules(table):
    shorter = record(1, "2026-01-31", "2026-01-10", scope_end="2026-02-10")
    longer = record(2, "2026-03-01", "2026-01-10", scope_end="2026-02-10")
    fits = c.realise_scope(table(shorter, longer)).collect()
    assert [(r["artifact_id"], r["request_scope"]["end"]) for r in fits] == [("a1", "2026-01-31")]


def test_a_hot_scope_is_reduced_before_the_join(spark, table):
    records = table(*(record(n, "2026-01-31", "2026-02-01") for n in range(1000)))
    scope = ("2026-01-01", "2026-01-31", BOX)
    asked = spark.createDataFrame(
        [(f"q{n}", "rain", scope) for n in range(1000)], f"request_id string, dataset_id string, request_scope {c.SCOPE_TYPE}"
    )
    assert c.last_usable(records).count() == 1
    found = c.find_existing(records, asked).collect()
    assert len(found) == 1000 and {r["artifact_id"] for r in found} == {"a999"}


def test_equal_scopes_of_one_call_are_one_record(table):
    old = record(0, "2026-01-31", "2026-02-01")
    twice = table(record(7, "2026-01-31", "2026-03-01"), record(8, "2026-01-31", "2026-04-01"))
    fresh = table(record(7, "2026-02-28", "2026-03-01"), record(8, "2026-02-28", "2026-04-01"))
    replaced = c.upsert_artifact(table(old), twice, overwrite=True).collect()
    assert [(r["artifact_id"], r["seq"], r["created_at"].month) for r in replaced] == [("a0", 0, 4)]
    added = c.upsert_artifact(table(old), fresh).collect()
    assert sorted((r["artifact_id"], r["created_at"].month) for r in added) == [("a0", 2), ("a7", 3)]


def test_a_record_without_files_is_not_reused(spark, table):
    old, new = record(0, "2026-01-31", "2026-02-01", path="gone"), record(5, "2026-01-31", "2026-03-01", path="here")
    there = spark.createDataFrame([("here",)], "path string")
    ids = [r["artifact_id"] for r in c.upsert_artifact(table(old), table(new), existing_paths=there).collect()]
    assert sorted(ids) == ["a0", "a5"]


def test_upsert_keeps_identity(spark, table):
    catalog = c.CatalogTable(spark, scratch_path(spark, "catalog"))
    assert catalog.read().isEmpty()
    catalog.replace(table(record(1, "2026-02-10", "2026-01-10")))
    again = table(record(9, "2026-02-10", "2026-03-01", status="unpublished"))
    assert [r["artifact_id"] for r in catalog.upsert(again).collect()] == ["a1"]
    row = catalog.upsert(again, overwrite=True).collect()
    assert [(r["artifact_id"], r["publication"]["status"], r["created_at"].month) for r in row] == [("a1", "published", 3)]
    catalog.upsert(table(record(5, "2027-01-01", "2026-03-01")))
    assert catalog.read().count() == 2
    assert catalog.publish(["a5"], F.lit("2026-04-01 00:00:00")).filter("publication.collection_id = 'rain'").count() == 1


def test_unfinished_version_is_ignored(spark, table):
    catalog = c.CatalogTable(spark, scratch_path(spark, "catalog"))
    catalog.replace(table(record(1, "e", "2026-01-10")))
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        table(record(2, "e", "2026-01-10")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
            f"{catalog.path}/version=00000001"
        )
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    assert [r["artifact_id"] for r in catalog.read().collect()] == ["a1"]
    catalog.replace(table(record(3, "e", "2026-01-10")))
    assert [r["artifact_id"] for r in catalog.read().collect()] == ["a3"]


def test_versions(table):
    made = ["2026-01-01T05:00", "2026-01-02T01:00", "2026-01-02T07:00", "2026-01-02T07:00"]
    records = table(*[record(i, "e", m) for i, m in enumerate(made)])
    assert [r["seq"] for r in c.version_history(records).orderBy("version").collect()] == [2, 3, 1, 0]
    nested = c.dataset_versions(records, ["rain"]).first()["versions"]
    assert [v["created_at"].hour for v in nested] == [7, 7, 1, 5]


def template(kind="temporal", execution=None, period="daily", availability=None):
    return ("rain", kind, execution, period, availability, "Rain", "mm", None, "Source", None, "P1D", None, ("blues", [0.0, 20.0], -9999.0))


def policy(name=None, lag_hours=None, lag_days=None, offset=None, year=None, future=None):
    return (name, None, lag_hours, lag_days, offset, year, future)


@pytest.fixture
def plan(spark, table):
    def make(row, tmpl, asked, now="2026-04-15 00:00:00", stored=()):
        return plan_sync(
            table(row),
            spark.createDataFrame([tmpl], TEMPLATE_SCHEMA),
            spark.createDataFrame([("rain", p) for p in stored], "dataset_id string, period_id string"),
            spark.createDataFrame([("rain", asked)], "dataset_id string, requested_end string"),
            F.lit(now).cast("timestamp_ntz"),
        )

    return make


def short(df):
    r = df.first()
    return r["action"], r["reason"], r["target_end"], r["target_end_source"]


def test_temporal_plans(plan):
    row = record(1, "2026-01-31", "2026-02-01")
    assert short(plan(row, template(), "2026-01-31")) == ("no_op", "no_new_period", "2026-01-31", "request")
    made = plan(row, template(), "2026-02-10").first()
    assert (made["action"], made["delta_start"], made["delta_end"]) == ("rematerialize", "2026-02-01", "2026-02-10")
    assert short(plan(row, template(execution="append"), "2026-02-10"))[:2] == ("append", "new_periods_available_for_append")
    rewritten = record(1, "2026-01-31", "2026-02-01", fmt="parquet")
    assert short(plan(rewritten, template(execution="append"), "2026-02-10"))[0] == "rematerialize"
    assert short(plan(row, template(), " "))[2:] == ("2026-04-15", "default_today")
    lagged = template(availability=policy("lagged", lag_days=60))
    assert short(plan(row, lagged, None))[2:] == ("2026-02-14", "default_today_clamped_by_availability")
    unnamed = template(availability=policy(lag_days=60))
    assert short(plan(row, unnamed, "2026-04-01"))[2:] == ("2026-02-14", "request_clamped_by_availability")
    stored = plan(row, template(execution="append"), "2026-02-10", stored=["2026-02-03", "2026-02-05"]).first()
    assert (stored["current_end"], stored["delta_start"]) == ("2026-02-05", "2026-02-06")
    broken = plan(row, template(), "2026-02-10", stored=["2026-02-03", "oops"]).first()
    assert broken["current_end"] == "2026-01-31"


def test_release_plans(plan):
    row = record(1, "2024", "2026-02-01", start="2015", period="yearly")
    lagged = template("release", period="yearly", availability=policy("lagged", offset=1))
    assert short(plan(row, lagged, "2026")) == ("rematerialize", "new_release_available", "2025", "request_clamped_by_availability")
    assert short(plan(row, template("release", period="yearly"), "2024"))[:2] == ("no_op", "no_new_release")
    future = template("release", period="yearly", availability=policy("release", future=True))
    assert short(plan(row, future, "2030"))[2] == "2030"


def test_static_and_broken_plans(plan):
    row = record(1, "2026-01-31", "2026-02-01")
    assert short(plan(row, template("static"), "nonsense")) == ("not_syncable", "static_dataset", "2026-01-31", "current_coverage")
    bad = plan(row, template(), "nonsense")
    assert bad.first()["action"] is None and "Invalid daily period" in bad.first()["error"]
    failed = run_sync(bad, {})[0]
    assert failed["status"] == "failed" and "Invalid daily period" in failed["reason"]
    for end, kind in (("oops", "temporal"), (None, "temporal"), ("oops", "release")):
        odd = plan(record(1, end, "2026-02-01"), template(kind), "2026-02-10").first()
        assert odd["action"] is None and "no period" in odd["error"]
    unknown = plan(row, template("weekly"), "2026-02-10").first()
    assert unknown["action"] is None and "Unknown sync kind weekly" in unknown["error"]


def test_the_stored_end_is_brought_to_native_text(plan):
    hourly = record(1, "2026-04-21T13:27:45", "2026-04-22", period="hourly")
    made = plan(hourly, template(period="hourly"), "2026-04-21T13").first()
    assert made["current_end"] == "2026-04-21T13" and made["action"] == "no_op"


def test_failures_leave_the_others_to_go_on(plan):
    row = record(1, "2026-01-31", "2026-02-01")
    first, second = (plan(row, template(execution="append"), "2026-02-10").withColumn("dataset_id", F.lit(n)) for n in "ab")

    def fetch(planned):
        if planned["dataset_id"] == "a":
            raise RuntimeError("no network")
        return 1

    noted = []
    done = run_sync(first.union(second), {APPEND: fetch}, lambda planned, result: noted.append((planned["dataset_id"], result)))
    assert [(d["status"], d["reason"]) for d in done] == [("failed", "RuntimeError: no network"), ("completed", None)]
    assert noted == [("b", 1)]


def many(plan, names):
    row = record(1, "2026-01-31", "2026-02-01")
    one = plan(row, template(execution="append"), "2026-02-10")
    return one.drop("dataset_id").join(one.sparkSession.createDataFrame([(n,) for n in names], "dataset_id string")).select(*one.columns)


def test_slow_stores_are_synced_at_the_same_time(spark, plan):
    spans = {}

    def work(row):
        began = time.monotonic()
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool").startswith("sync-")
        spark.range(2).repartition(2).foreach(lambda _: time.sleep(1.5))
        spans[row["dataset_id"]] = (began, time.monotonic())

    groups = set()
    done = run_sync(many(plan, "abc"), {APPEND: lambda r: (work(r), groups.add(spark.sparkContext.getLocalProperty("spark.jobGroup.id")))}, workers=2)
    assert [d["status"] for d in done] == ["completed"] * 3 and len(groups) == 3
    assert max(spans["a"][0], spans["b"][0]) < min(spans["a"][1], spans["b"][1])
    assert spans["c"][0] >= min(spans["a"][1], spans["b"][1])
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") not in groups


def test_a_failing_execution_cancels_its_own_jobs_only(spark, plan):
    left = {}

    def fails(row):
        def linger():
            try:
                spark.range(1).foreach(lambda _: time.sleep(60))
                left["a"] = "ended"
            except Exception:
                left["a"] = "cancelled"

        thread = threading.Thread(target=inheritable_thread_target(linger))
        thread.start()
        left["thread"] = thread
        time.sleep(1.5)
        raise RuntimeError("gave up")

    def works(row):
        spark.range(1).foreach(lambda _: time.sleep(3))
        return "fine"

    done = run_sync(many(plan, "ab"), {APPEND: lambda r: fails(r) if r["dataset_id"] == "a" else works(r)})
    left["thread"].join(20)
    assert [(d["status"], d["result"]) for d in done] == [("failed", None), ("completed", "fine")]
    assert left["a"] == "cancelled"


def test_one_catalog_version_for_a_whole_run(spark, plan, table, cube_of):
    catalog = c.CatalogTable(spark, scratch_path(spark, "catalog"))
    catalog.replace(table(*[record(k, "2026-01-31", "2026-02-01", dataset=n) for k, n in enumerate("abcd")]))
    covered = coverage(cube_of("2026-01-01", 24, [1] * 40), "daily")

    def note(finished):
        record_coverages(catalog, {row["dataset_id"]: covered for row, _ in finished}, F.lit("2026-03-01 00:00:00"))

    run_sync(many(plan, "abc"), {APPEND: lambda r: 1 if r["dataset_id"] != "b" else 1 / 0}, record_all=note)
    assert catalog._versions(complete_only=False) == [0, 1]
    ends = {r["dataset_id"]: (r["coverage"]["temporal"]["end"], r["request_scope"]["end"]) for r in catalog.read().collect()}
    assert ends == {n: ("2026-02-09", "2026-02-09") if n in "ac" else ("2026-01-31", "2026-01-31") for n in "abcd"}
    with pytest.raises(GridError, match="'z' has no record"):
        record_coverages(catalog, {"a": covered, "z": covered}, F.lit("2026-03-01 00:00:00"))
    assert catalog._versions(complete_only=False) == [0, 1]


def test_run_sync(plan):
    row = record(1, "2026-01-31", "2026-02-01")
    calls = {APPEND: lambda r: ("added", r["delta_start"]), REMATERIALIZE: lambda r: ("rebuilt", r["target_end"])}
    done = run_sync(plan(row, template(execution="append"), "2026-02-10"), calls)
    assert (done[0]["status"], done[0]["result"]) == ("completed", ("added", "2026-02-01"))
    assert run_sync(plan(row, template(), "2026-01-31"), calls)[0]["status"] == "up_to_date"
    assert run_sync(plan(row, template("static"), None), calls)[0]["status"] == "not_syncable"


def test_derived_dataset_is_reused(spark, cube_of):
    catalog, root = c.CatalogTable(spark, scratch_path(spark, "catalog")), scratch_path(spark, "derived")
    cube = cube_of("2026-01-01", 24, [1] * 62, "precip")

    def derive(frequency="MS", start="2026-01-01", end="2026-02-28", overwrite=False):
        return materialize_resampled(
            spark, catalog, cube, root, source_dataset_id="rain", source_period_type="daily", variable="precip",
            frequency=frequency, method="sum", start=start, end=end, now=F.lit("2026-05-01 00:00:00"), overwrite=overwrite,
        ).first()

    first = derive()
    assert (first["dataset_id"], first["period_type"], first["publication"]["status"]) == ("rain_ms_sum", "monthly", "published")
    assert first["request_scope"]["start"] == "2026-01" and first["coverage"]["temporal"]["end"] == "2026-02"
    again = derive()
    assert (again["artifact_id"], again["path"]) == (first["artifact_id"], first["path"])
    anew = derive(overwrite=True)
    assert anew["artifact_id"] == first["artifact_id"] and anew["path"] != first["path"]
    cut = c.load_collection(spark, catalog.read(), "rain_ms_sum", None, ["2026-02", None])
    assert [r["precip"] for r in cut.collect()] == [28.0]
    with pytest.raises(NoDataError):
        derive(start="2027-01-01", end="2027-03-31")
    with pytest.raises(NotFoundError):
        c.load_collection(spark, catalog.read(), "snow")


def test_collection_record(spark, table, cube_of):
    cube = cube_of("2026-01-01", 24, [1, 2], "precip")
    axes = axis_summary(cube).withColumn("dataset_id", F.lit("rain"))
    variables = variable_summary(cube).withColumn("dataset_id", F.lit("rain"))
    templates = spark.createDataFrame([template()], TEMPLATE_SCHEMA)
    found = c.collection_metadata(table(record(1, "2026-01-02", "2026-02-01")), templates, axes, variables)
    row = found.first()
    assert row["keywords"] == ["rain", "precip", "zarr", "stac", "Source", "Rain"]
    assert (row["bbox"]["xmin"], row["interval"]["end"].day, row["render"]["rescale"]) == (1.0, 2, [0.0, 20.0])
    assert [d["axis"] for d in row["dimensions"]] == ["t", "x", "y"] and row["dimensions"][0]["iso_step"] == "P1D"
    assert '"dataset_id":"rain"' in c.collection_json(found).first()["document"]
