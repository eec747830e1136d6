"""Benchmark the headline queries; prints ONE JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default: the headline set below).

Every query is forced with a ``noop`` write (full computation, nothing sent
to the driver) and timed once after a warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from loadcast.catalog.registry import all_queries  # noqa: E402
from loadcast.operators import features as fe  # noqa: E402
from loadcast.session import build_session, checkpoint_root  # noqa: E402
from loadcast.sources import panels  # noqa: E402


def feature_table(spark, sf):
    """The whole Step 2 feature table of the dense panel (every window feature)."""
    return fe.build_features(panels.demand_panel(spark, sf))


HEADLINE = [
    "feature_table",
    "flagship_lag_error",
    "a6_changed_rows",
    "a9_upsert",
    "a8_group_consecutive",
    "e1_demand_last_year_dow",
    "e4_last_before",
    "e5_same_dow_last_week",
    "e6_same_week_last_year",
    "d3_describe",
    "c7_chronological_split",
    "f3_fit_gas_model",
    "f1_fit_demand_forest",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(f"local[{cpus}]", app_name="loadcast-bench",
                          shuffle_partitions=max(8, 2 * cpus))
    checkpoint_root(spark)
    reg = {k: fn for k, (fn, _) in all_queries().items()}
    reg["feature_table"] = feature_table
    # Warm-up: JVM, parquet footers, codegen caches.
    panels.demand_panel(spark, sf).agg(F.count(F.lit(1))).collect()
    times = {}
    for name in names:
        t0 = time.time()
        df = reg[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
