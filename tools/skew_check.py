"""Skew check: one device holds a third of all observations.

Runs, on generated data (``spark.range``; test-fixture data, not a
registered query), the plain per-device ``lead`` and ``mobility.movements``,
and the built-in global ``percent_rank`` window and the distributed
``functions.ranking.percent_rank`` over values where one value holds a third
of the rows.  Reads Spark's event log (written to a fresh scratch folder) and
reports, for each, the largest number of shuffle records read by one task.

Usage: python tools/skew_check.py [rows] [unit_minutes]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from simtrail.functions.ranking import percent_rank  # noqa: E402
from simtrail.operators import mobility  # noqa: E402
from simtrail.session import build_session  # noqa: E402

STATES = ["A", "B", "C", "D", "E"]


def points(spark, n: int):
    month = 30 * 86_400
    ids = spark.range(n)
    return ids.select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 20_000).alias("ifa"),
        F.col("id").alias("obs_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % month).alias("seen_at"),
        F.element_at(F.array(*[F.lit(s) for s in STATES]), ((F.xxhash64("id") % 5 + 5) % 5 + 1).cast("int")).alias("state"),
    )


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    cap = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    scratch = tempfile.mkdtemp(prefix="skew-")
    spark = build_session(
        master="local[8]",
        shuffle_partitions=64,
        extra_conf={
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": scratch,
            "spark.eventLog.compress": "false",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            # AQE splits a skewed join partition above this size (256 MB by
            # default); scaled down to the size of this check.
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2m",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m",
            "spark.driver.memory": "16g",
        },
    )
    sc = spark.sparkContext
    pts = points(spark, n)
    runs = {}

    w = Window.partitionBy("ifa").orderBy("seen_at", "obs_id")
    plain = pts.select(
        "ifa", "state", F.lead("state").over(w).alias("next_state"), F.lead("obs_id").over(w).isNotNull().alias("has_next")
    )
    sc.setJobDescription("plain")
    t = time.perf_counter()
    plain_trips = mobility.trips(plain).count()
    runs["plain per-device lead"] = time.perf_counter() - t

    sc.setJobDescription("split")
    t = time.perf_counter()
    split_trips = mobility.trips(mobility.movements(pts, unit_minutes=cap)).count()
    runs[f"movements(unit_minutes={cap})"] = time.perf_counter() - t
    # Global percent_rank over values where one value holds a third of the rows.
    vals = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(42.0)).otherwise((F.col("id") * 7919 % 1_000_003).cast("double")).alias("v"),
    )
    out_a, out_b = os.path.join(scratch, "rank_window"), os.path.join(scratch, "rank_distributed")
    sc.setJobDescription("rank_window")
    t = time.perf_counter()
    percent_rank(vals, "v", out="p", method="window").select("id", "p").write.parquet(out_a)
    runs["percent_rank built-in window"] = time.perf_counter() - t
    sc.setJobDescription("rank_distributed")
    t = time.perf_counter()
    percent_rank(vals, "v", out="p").select("id", "p").write.parquet(out_b)
    runs["percent_rank distributed"] = time.perf_counter() - t
    sc.setJobDescription("compare")
    a, b = spark.read.parquet(out_a), spark.read.parquet(out_b).withColumnRenamed("p", "q")
    mismatches = a.join(b, "id", "full").where(~F.col("p").eqNullSafe(F.col("q"))).count()
    assert mismatches == 0, mismatches
    spark.stop()

    stage_desc, task_max = {}, {}
    logs = glob.glob(os.path.join(scratch, "eventlog_v2_*", "events_*")) + glob.glob(os.path.join(scratch, "local-*"))
    for f in logs:
        if os.path.isdir(f):
            continue
        for line in open(f, errors="replace"):
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if not isinstance(e, dict):
                continue
            if e["Event"] == "SparkListenerStageSubmitted":
                props = e.get("Properties") or {}
                stage_desc[e["Stage Info"]["Stage ID"]] = props.get("spark.job.description", "")
            if e["Event"] == "SparkListenerTaskEnd":
                m = (e.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                recs = m.get("Total Records Read", 0)
                sid = e["Stage ID"]
                task_max[sid] = max(task_max.get(sid, 0), recs)
    worst = {}
    for sid, recs in task_max.items():
        d = stage_desc.get(sid, "")
        worst[d] = max(worst.get(d, 0), recs)
    assert plain_trips == split_trips, (plain_trips, split_trips)
    print(json.dumps({
        "rows": n,
        "hot_device_rows": (n + 2) // 3,
        "trips": split_trips,
        "largest_task_shuffle_records": {"plain per-device lead": worst.get("plain", 0),
                                         f"movements(unit_minutes={cap})": worst.get("split", 0),
                                         "percent_rank built-in window": worst.get("rank_window", 0),
                                         "percent_rank distributed": worst.get("rank_distributed", 0)},
        "seconds": {k: round(v, 2) for k, v in runs.items()},
    }))


if __name__ == "__main__":
    main()
