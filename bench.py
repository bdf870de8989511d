"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the folder of the tables and ``BENCH_CPUS`` the number of cores. Each query
is materialised in full (every row and column) without collecting it; the first run of the session
is a warm-up that is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import all_queries  # noqa: E402
from gridtide.session import build_session  # noqa: E402

HEADLINE = (
    "monthly_zone_means",
    "monthly_sums",
    "ten_day_sums",
    "weekly_means",
    "hourly_to_daily_means",
    "calendar_seasons",
    "scaled_time_maximum",
    "spatial_means",
    "zone_statistics",
    "half_resolution",
    "dense_cube",
    "merged_cubes",
    "other_grid",
    "mercator_cube",
    "nearest_cells_of_suppliers",
    "missing_days_per_supplier",
    "newest_versions",
    "reusable_results",
    "sync_plans",
    "stored_cube_subset",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()

    def run(name: str) -> float:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    run(HEADLINE[0])
    seconds = {name: run(name) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
