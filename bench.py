"""Times the headline queries (without the rounding that the comparison with SQL adds) at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from hourloom.plans import catalog, registry
from hourloom.session import build_session

HEADLINE = ["flagship_panel", "cross_entity_fill", "interpolate_limit6", "null_run_lengths", "rolling_mean", "city_lead_lag", "blend_rank", "blend_grid", "error_breakdowns", "variance_share_top", "paired_bootstrap_ci"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(2 * int(cpus)), spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["hourly_facts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.PLAIN[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
