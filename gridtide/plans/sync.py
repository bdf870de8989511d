"""What every dataset needs to become current, and doing it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.errors import GridError
from gridtide.functions.availability import (
    COMPLETE_MONTH,
    LAGGED,
    RELEASE,
    lagged_available,
    latest_complete_month,
    release_available,
)
from gridtide.functions.periods import default_end, next_period, normalize_period, period_rejection
from gridtide.operators.catalog import LEDGER_FORMAT, CatalogTable, committed_end, latest_per_dataset
from gridtide.session import scratch_path

AVAILABILITY_TYPE = (
    "struct<policy:string,complete_after_day:int,lag_hours:int,lag_days:int,"
    "latest_year_offset:int,latest_year:int,allow_future:boolean>"
)
TEMPLATE_SCHEMA = (
    "dataset_id string, kind string, execution string, period_type string, "
    f"availability {AVAILABILITY_TYPE}, short_name string, units string, resolution string, "
    "source string, source_url string, iso_step string, bbox array<double>, "
    "display struct<colormap:string,range:array<double>,nodata:double>"
)

# Sync kinds, actions and outcomes.
TEMPORAL, RELEASE_KIND, STATIC = "temporal", "release", "static"
NO_OP, NOT_SYNCABLE, APPEND, REMATERIALIZE = "no_op", "not_syncable", "append", "rematerialize"
UP_TO_DATE, COMPLETED, FAILED = "up_to_date", "completed", "failed"

# Executions of a sync run that are under way at the same time.
SYNC_WORKERS = 4

# Messages of a plan.
STATIC_MESSAGE = "This dataset is static and is not syncable."
NO_PERIOD_MESSAGE = "Data already exists through {0}; target {1} does not require a new download."
NO_RELEASE_MESSAGE = "Release {0} is already available locally; target {1} does not require a new download."
NEW_RELEASE_MESSAGE = "A newer release is available: {1}. Sync will rematerialize the dataset."
APPEND_MESSAGE = (
    "Data exists through {0}. Sync will append missing periods {2} through {1} and extend coverage through {1}."
)
REBUILD_MESSAGE = "Data exists through {0}. Sync will rematerialize the dataset through {1}."


def _fill(template: str, *values: Column) -> Column:
    """Text with ``{0}``, ``{1}``, ... replaced by columns."""
    pieces: list[Column] = []
    rest = template
    while rest:
        text, brace, tail = rest.partition("{")
        if text:
            pieces.append(F.lit(text))
        if not brace:
            break
        index, _, rest = tail.partition("}")
        pieces.append(values[int(index)])
    return F.concat(*pieces)


def available_end(now: Column, period_type: Column, requested_end: Column, availability: Column) -> Column:
    """What the declared policy offers for a requested end, in native format."""
    lagged = lagged_available(
        now,
        period_type,
        requested_end,
        availability["lag_hours"],
        availability["lag_days"],
        availability["latest_year_offset"],
    )
    by_policy = (
        F.when(availability["policy"] == COMPLETE_MONTH, latest_complete_month(now, availability["complete_after_day"]))
        .when(availability["policy"] == LAGGED, lagged)
        .when(
            availability["policy"] == RELEASE,
            release_available(availability["allow_future"], availability["latest_year"], requested_end, lagged),
        )
    )
    return F.when(availability["policy"].isNull(), lagged).otherwise(normalize_period(by_policy, period_type))


def plan_sync(
    artifacts: DataFrame,
    templates: DataFrame,
    periods: DataFrame,
    requests: DataFrame,
    now: Column,
    append_only: Column | None = None,
) -> DataFrame:
    """One plan row per dataset that has a record and a template.

    ``append_only`` says which records take their end from the store (see ``committed_end``); an end is brought to
    the native text of its period type.

    ``requests`` has dataset_id and requested_end; a dataset it does not name is planned up to the
    current period. All comparisons are between texts of the dataset's own period format.
    A plan that cannot be made carries its reason in ``error`` and no action.
    """
    latest = committed_end(latest_per_dataset(artifacts), periods, append_only)
    base = (
        latest.select(
            "dataset_id", "format", F.col("request_scope.start").alias("current_start"), "current_end"
        )
        .join(templates.select("dataset_id", "kind", "execution", "period_type", "availability"), "dataset_id")
        .join(requests.select("dataset_id", "requested_end"), "dataset_id", "left")
    )
    moves = F.col("kind") != STATIC
    base = base.withColumn("native_end", F.when(moves, normalize_period("current_end", F.col("period_type"))))
    base = base.withColumn("current_end", F.coalesce("native_end", "current_end"))
    kind, period_type = F.col("kind"), F.col("period_type")
    asked = F.nullif(F.trim("requested_end"), F.lit(""))
    resolved = base.withColumns(
        {
            "asked": asked,
            "label": F.when(asked.isNotNull(), "request").otherwise("default_today"),
            "resolved": F.when(
                kind != STATIC,
                F.when(asked.isNotNull(), normalize_period(asked, period_type)).otherwise(default_end(period_type, now)),
            ),
        }
    )
    resolved = resolved.withColumn(
        "offered", available_end(now, period_type, F.col("resolved"), F.col("availability"))
    ).withColumn("upcoming", F.when(kind == TEMPORAL, next_period("current_end", period_type)))
    offered = F.col("offered")
    unreadable = F.col("native_end").isNull() | ((kind == TEMPORAL) & F.col("upcoming").isNull())
    clamped = F.when(F.col("availability").isNull(), F.col("resolved")).otherwise(F.least("resolved", offered))
    targeted = resolved.withColumns(
        {
            "error": F.when(
                ~F.coalesce(kind.isin(TEMPORAL, RELEASE_KIND, STATIC), F.lit(False)),
                F.concat(F.lit("Unknown sync kind "), F.coalesce(kind, F.lit("none"))),
            ).when(
                kind != STATIC,
                F.coalesce(
                    F.when(
                        F.coalesce(unreadable, F.lit(True)),
                        F.concat(F.lit("The stored end is no period: "), F.coalesce("current_end", F.lit("none"))),
                    ),
                    period_rejection("asked", period_type),
                    F.when(
                        F.col("availability").isNotNull() & offered.isNull(),
                        F.lit("Availability policy gives no valid period"),
                    ),
                ),
            ),
            "target": F.when(kind == STATIC, F.col("current_end")).otherwise(clamped),
        }
    )
    target, current, upcoming = F.col("target"), F.col("current_end"), F.col("upcoming")
    can_append = F.coalesce((F.col("execution") == APPEND) & (F.col("format") == LEDGER_FORMAT), F.lit(False))
    current_enough = F.when(kind == TEMPORAL, upcoming > target).otherwise(current >= target)
    outcome = (
        F.when(F.col("error").isNotNull(), F.lit(None))
        .when(kind == STATIC, "static_dataset")
        .when(kind == TEMPORAL, F.when(current_enough, "no_new_period")
              .when(can_append, "new_periods_available_for_append")
              .otherwise("new_periods_available"))
        .when(current_enough, "no_new_release")
        .otherwise("new_release_available")
    )
    reasoned = targeted.withColumn("reason", outcome)
    reason = F.col("reason")
    moving = reason.isin("new_periods_available_for_append", "new_periods_available")
    return reasoned.select(
        "dataset_id",
        kind.alias("sync_kind"),
        F.when(reason == "static_dataset", NOT_SYNCABLE)
        .when(reason.isin("no_new_period", "no_new_release"), NO_OP)
        .when(reason == "new_periods_available_for_append", APPEND)
        .when(reason.isNotNull(), REMATERIALIZE)
        .alias("action"),
        reason,
        F.when(reason == "static_dataset", STATIC_MESSAGE)
        .when(reason == "no_new_period", _fill(NO_PERIOD_MESSAGE, current, target))
        .when(reason == "no_new_release", _fill(NO_RELEASE_MESSAGE, current, target))
        .when(reason == "new_release_available", _fill(NEW_RELEASE_MESSAGE, current, target))
        .when(reason == "new_periods_available_for_append", _fill(APPEND_MESSAGE, current, target, upcoming))
        .when(reason == "new_periods_available", _fill(REBUILD_MESSAGE, current, target))
        .alias("message"),
        "current_start",
        "current_end",
        target.alias("target_end"),
        F.when(kind == STATIC, "current_coverage")
        .otherwise(
            F.concat(
                F.col("label"),
                F.when(target == F.col("resolved"), "").otherwise("_clamped_by_availability"),
            )
        )
        .alias("target_end_source"),
        F.when(moving, upcoming).alias("delta_start"),
        F.when(moving, target).alias("delta_end"),
        "error",
    )


def run_sync(
    plan: DataFrame,
    executors: Mapping[str, Callable[[Row], Any]],
    record: Callable[[Row, Any], None] | None = None,
    record_all: Callable[[list[tuple[Row, Any]]], None] | None = None,
    workers: int = SYNC_WORKERS,
) -> list[dict[str, Any]]:
    """Carry out planned rows, up to ``workers`` of them at a time; each execution has its own Spark jobs.

    ``executors`` gives a function for ``append`` and one for ``rematerialize``. They run in threads with a job group
    each and share the cluster by scheduling pools, which are fair in a session of ``build_session``. What an execution
    that fails left running is cancelled by its group. ``record`` is called with the plan row and the result of
    each finished one, in the calling thread; ``record_all`` once with all of them, to note the new coverage in one version
    of the catalog (see ``record_coverages``). The plan is written down before the first execution, since executions
    change the stores it was made from. A dataset that cannot be planned or whose execution fails is reported as failed
    with its reason, and the others go on.
    """
    spark = plan.sparkSession
    path = scratch_path(spark, "sync-plan")
    plan.write.parquet(path)
    fixed = spark.read.schema(plan.schema).parquet(path).orderBy("dataset_id")
    run, context = uuid.uuid4().hex, spark.sparkContext

    def carry_out(row: Row, place: int) -> Any:
        group = f"sync-{run}-{place}"
        context.setJobGroup(group, f"sync {row['dataset_id']}", interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", f"sync-{place % workers}")
        try:
            return executors[row["action"]](row)
        except Exception:
            context.cancelJobGroup(group)
            raise

    outcomes, started, finished = [], [], []
    with ThreadPoolExecutor(workers) as pool:
        for row in fixed.collect():  # one short row for each dataset
            due = row["error"] is None and row["action"] not in (NO_OP, NOT_SYNCABLE)
            ready = row["current_start"] is not None and row["target_end"] is not None
            # wrapped anew for each one, as it carries the properties of this thread over
            job = pool.submit(inheritable_thread_target(spark)(carry_out), row, len(started)) if due and ready else None
            started.append((row, job))
        for row, job in started:
            status, result, reason = _outcome(row, job)
            if status == COMPLETED:
                try:
                    if record is not None:
                        record(row, result)
                    finished.append((row, result))
                except Exception as problem:  # noqa: BLE001  one dataset's failure is its outcome
                    status, reason = FAILED, f"{type(problem).__name__}: {problem}"
            outcomes.append(
                {
                    "dataset_id": row["dataset_id"],
                    "action": row["action"],
                    "status": status,
                    "result": result,
                    "reason": reason,
                }
            )
    if record_all is not None and finished:
        record_all(finished)
    return outcomes


def _outcome(row: Row, job: Future | None) -> tuple[str, Any, str | None]:
    """Status, result and reason of one planned row, once it is done."""
    if row["error"] is not None:
        return FAILED, None, row["error"]
    if row["action"] == NO_OP:
        return UP_TO_DATE, None, None
    if row["action"] == NOT_SYNCABLE:
        return NOT_SYNCABLE, None, None
    if job is None:
        return FAILED, None, "There is no start or no target to sync to"
    problem = job.exception()
    if problem is not None:
        return FAILED, None, f"{type(problem).__name__}: {problem}"
    return COMPLETED, job.result(), None


def record_coverage(catalog: CatalogTable, dataset_id: str, covered: DataFrame, now: Column) -> None:
    """Note what a dataset covers now (one row of ``coverage``) on its newest record."""
    record_coverages(catalog, {dataset_id: covered}, now)


def record_coverages(catalog: CatalogTable, covered: Mapping[str, DataFrame], now: Column) -> None:
    """Note what datasets cover now, each one row of ``coverage``, on their newest records, as one version of the catalog."""
    spark, records = catalog.spark, catalog.read()
    extent = F.struct(
        F.struct("start", "end").alias("temporal"), F.struct("xmin", "ymin", "xmax", "ymax").alias("spatial"), "spatial_wgs84"
    )
    kind = records.schema["coverage"].dataType
    rows: Sequence[Row] = [d.select(F.lit(n).alias("dataset_id"), extent.cast(kind).alias("fresh")).first() for n, d in covered.items()]
    fresh = spark.createDataFrame(rows, T.StructType([T.StructField("dataset_id", T.StringType()), T.StructField("fresh", kind)]))
    newest = latest_per_dataset(records.join(fresh.select("dataset_id"), "dataset_id", "left_semi"))
    chosen = newest.select("artifact_id", "dataset_id").join(fresh, "dataset_id")
    unknown = fresh.join(chosen.select("dataset_id"), "dataset_id", "left_anti").first()
    if unknown is not None:
        raise GridError(f"Dataset '{unknown['dataset_id']}' has no record")
    joined = records.join(chosen.select("artifact_id", "fresh"), "artifact_id", "left")
    known, reached = F.col("fresh").isNotNull(), F.col("fresh.temporal.end")
    scope = F.when(F.col("request_scope").isNotNull(), F.col("request_scope").withField("end", reached))
    noted = joined.withColumns(
        {
            "coverage": F.when(known, F.col("fresh")).otherwise(F.col("coverage")),
            "request_scope": F.when(known, scope).otherwise(F.col("request_scope")),
            "created_at": F.when(known, now.cast("timestamp_ntz")).otherwise(F.col("created_at")),
        }
    )
    catalog.replace(noted.select(*records.columns))
