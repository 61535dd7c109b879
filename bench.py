"""Time the registered queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Every query is materialised in full by a write to the ``noop`` sink: a warm-up, then the median of
three runs; one run for the queries that write whole lakes. The layers that the mart queries read (landed, silver, gold) are built once before,
timed on their own; silver and gold are built a second time, warm, for the rows per second.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable

from tripmill.plans import layers
from tripmill.plans.registry import QUERIES
from tripmill.session import build_session, scratch_path

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
# These write whole lakes, so one cold run tells enough.
WHOLE_LAKES = {"lake_run_repaired", "reject_balance", "silver_type_change", "gold_by_delta"}


def timed(action: Callable[[], object]) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    build = {
        "landed": timed(lambda: layers.landed(spark, sf_dir)),
        "silver": timed(lambda: layers.silver(spark, sf_dir)),
        "gold": timed(lambda: layers.gold(spark, sf_dir)),
    }
    chosen = sys.argv[1:] or list(QUERIES)
    seconds = {}
    for name in chosen:

        def run(query=QUERIES[name]) -> None:
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()

        if name in WHOLE_LAKES:
            seconds[name] = round(timed(run), 3)
            continue
        run()
        seconds[name] = round(statistics.median(timed(run) for _ in range(RUNS)), 3)
    rows = layers.landed(spark, sf_dir).count()
    silver_path, gold_path = scratch_path(spark, "bench-silver"), scratch_path(spark, "bench-gold")
    rebuild = timed(lambda: layers.build_silver(spark, sf_dir, silver_path)) + timed(
        lambda: layers.build_gold(spark, sf_dir, silver_path, gold_path)
    )
    report = {
        "metric": "total seconds over all registered queries, warm, median of runs",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cold_build_sec": {layer: round(spent, 3) for layer, spent in build.items()},
        "warm_build_sec": round(rebuild, 3),
        "raw_rows": rows,
        "rows_per_sec_conform_to_gold": round(rows / rebuild),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
