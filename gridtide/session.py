"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Needed for right results: times are naive UTC, and re-writing one period must
# leave the other partitions of a store alone.
REQUIRED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# Only for speed. Sizes stay Spark's decision: partition counts come from AQE and
# a join side is broadcast only below the byte limit.
TUNING_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    # jobs of several datasets that sync at the same time share the executors
    "spark.scheduler.mode": "FAIR",
}


def build_session(app_name: str = "gridtide", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the settings above; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    merged = {**TUNING_SETTINGS, **REQUIRED_SETTINGS}
    merged.update({key.replace("__", "."): value for key, value in settings.items()})
    for key, value in merged.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the required settings to a session somebody else built."""
    for key, value in REQUIRED_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint directory of the cluster.

    The directory comes from ``spark.checkpoint.dir``. A local folder is used only
    where that is unset and the session runs in local mode.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="gridtide-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
