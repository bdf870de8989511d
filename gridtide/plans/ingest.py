"""Ingesting a dataset in one call: append, check what was reached, record, publish."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.errors import GridError
from gridtide.functions.crs import WGS84
from gridtide.operators.catalog import LEDGER_FORMAT, CatalogTable, latest_per_dataset, scope_accepts
from gridtide.plans.derived import artifact_row
from gridtide.plans.sync import record_coverage
from gridtide.streaming.append import append_missing
from gridtide.streaming.store import PeriodStore


def ingest(
    source: DataFrame | Callable[[DataFrame], DataFrame],
    store: PeriodStore,
    catalog: CatalogTable,
    template: Mapping[str, Any],
    start: str,
    end: str,
    now: Column,
    publish: bool = False,
    bbox: tuple[float, float, float, float] | None = None,
    crs: str = WGS84,
) -> DataFrame:
    """Append the missing periods of a range and record what the store covers then, by its ledger. Returns the record in force.

    The first run adds a record, later ones bring it up to date. Data that starts elsewhere than asked, or goes
    beyond the asked end, is refused before it is recorded.
    """
    spark = store.spark
    dataset_id = template["id"]
    append_missing(source, store, template, start, end)
    covered = store.coverage(crs)
    record = artifact_row(
        spark,
        covered,
        dataset_id=dataset_id,
        source_dataset_id=template.get("source_dataset_id"),
        name=template.get("name", dataset_id),
        variable=template.get("variable"),
        period_type=store.period_type,
        fmt=LEDGER_FORMAT,
        path=store.path,
        start=start,
        end=end,
        bbox=bbox,
        now=now,
    )
    own = F.col("dataset_id") == dataset_id
    if catalog.read().filter(own).isEmpty():
        if record.filter(scope_accepts(F.col("coverage"), F.col("request_scope"))).isEmpty():
            raise GridError(f"What was stored of '{dataset_id}' does not fit the requested range {start} to {end}")
        catalog.upsert(record)
    else:
        record_coverage(catalog, dataset_id, covered, now)
    newest = latest_per_dataset(catalog.read().filter(own)).first()
    if publish and newest["publication"]["status"] != "published":
        catalog.publish([newest["artifact_id"]], now)
    return catalog.read().filter(F.col("artifact_id") == newest["artifact_id"])
