"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` picks the data, ``BENCH_CPUS`` the local cores. Each query is
run to a sink that discards its rows, so every column of every row is computed.
"""

from __future__ import annotations

import json
import os
import time

from demandloom import get_spark
from demandloom.plans.catalog import QUERIES

HEADLINE = [
    "shed_profile_by_hour", "shed_intervals", "shed_hourly", "shed_piecewise_fit", "shed_fit_line",
    "shed_box_stats", "shed_day_hour_pivot", "shed_peak", "hourly_resample_dense", "report_to_wide",
    "calendar_features", "summer_workdays", "event_grid", "case_steps", "design_steps", "baseline_match",
    "profile_window_shift", "profile_merge", "profile_rate", "operating_hours_warp", "ruleset_year",
    "ruleset_half_hours", "raise_insulation", "insulation_layer", "cost_year0", "window_wall_ratio",
    "wall_area_by_orientation", "perimeter", "story_perimeter", "zone_classes", "zone_plenums",
    "setpoint_checks", "log_levels",
]


def run(spark, name: str, sf_dir: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = get_spark(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, names[0], sf_dir)  # start-up and class loading
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
