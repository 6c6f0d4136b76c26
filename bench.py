"""Benchmark: headline queries on the driver tables.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: ``{"metric", "value", "unit", "queries", "sf", ...}``.
Each query runs to completion through Spark's ``noop`` sink (the whole plan
executes, nothing is collected to the driver); its wall time is recorded.
``BENCH_QUERIES`` (comma list) or ``BENCH_ALL=1`` changes the set.  A
short untimed warm-up on ``BENCH_WARMUP_DIR`` (default the sf0.001 tables)
runs first, so JIT compilation is not billed to the first timed query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from innkeep.plans import catalog  # noqa: E402
from innkeep.session import checkpoint_dir, get_spark  # noqa: E402

HEADLINE = [
    # B / C listings and joins
    "customer_directory", "available_rooms", "room_occupancy", "outstanding_invoices", "upcoming_events",
    "reservation_list", "order_list", "request_list", "request_room_matches", "customers_ordering",
    "rooms_above_average",
    # D reports
    "room_inventory_report", "room_type_summary", "frontdesk_workload", "hall_utilisation", "dashboard_stats",
    # H billing
    "stay_charges",
    # J quality
    "check_unique", "check_foreign_key",
    # I bulk changes
    "checkout_invoices", "payment_invoices", "request_submissions", "decision_requests", "booking_stays",
    "replayed_room_status", "customer_removal_rejects",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    if os.environ.get("BENCH_QUERIES"):
        names = [n.strip() for n in os.environ["BENCH_QUERIES"].split(",") if n.strip()]
    elif os.environ.get("BENCH_ALL") == "1":
        names = catalog.names()
    else:
        names = [n for n in HEADLINE if n in catalog.names()]

    spark = get_spark(
        f"local[{cpus}]",
        app_name="innkeep-bench",
        conf={
            "spark.sql.shuffle.partitions": str(int(cpus) * 2),
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
        },
    )
    # the shared checkpoint folder comes from the cluster (spark.checkpoint.dir);
    # a local run without one gets a fresh scratch folder, as the tests do
    if os.environ.get("BENCH_NO_CHECKPOINT") != "1":
        checkpoint_dir(spark, tempfile.mkdtemp(prefix="innkeep-bench-ckpt-"))
    # warm-up (not timed): JVM start, and JIT of the join, aggregate and
    # checkpoint code paths on the smallest tables when they are present
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    warm = ["room_occupancy", "check_unique", "checkout_invoices"] if os.path.isdir(warm_dir) else []
    for name in warm:
        catalog.build(name, spark, warm_dir).write.format("noop").mode("overwrite").save()
    catalog.build("halls", spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()  # build included: a job may stage rows while planning
        df = catalog.build(name, spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": int(cpus),
                "n_queries": len(times),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
