"""Benchmark the headline queries; print ONE JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1),
``BENCH_CPUS`` (default 8), ``BENCH_REPEAT`` (default 3, best run counts).
Each query is run to completion through the ``noop`` sink (every row is
computed, nothing is collected to the driver), after one untimed warm-up pass
over all headline queries; the time includes building the DataFrame.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from simtrail.plans import catalog  # noqa: E402
from simtrail.session import build_session  # noqa: E402

HEADLINE = (
    "sim_profile",
    "rfm_score",
    "delta_segments",
    "primary_sim_breakdown",
    "trip_profile",
    "od_matrix",
    "profiled_trip_profile",
    "corridor_tiers",
    "corridor_deciles",
    "segment_tier_profile",
    "segment_daypart_profile",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    scratch = tempfile.mkdtemp(prefix="simtrail-bench-")
    # The checkpoint folder is read from the session (spark-defaults);
    # ``build_session`` only creates one when none is named.
    spark = build_session(
        master=f"local[{cpus}]",
        shuffle_partitions=cpus,
        app_name="simtrail-bench",
        extra_conf={
            "spark.driver.memory": "16g",
            "spark.local.dir": os.path.join(scratch, "local"),
        },
    )
    qs = catalog.queries()
    # Warm-up: one untimed pass over the headline queries (JVM class loading,
    # JIT, codegen caches), so the timed runs measure the steady state.
    for name in HEADLINE:
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(max(1, repeat)):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        timings[name] = round(best, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
