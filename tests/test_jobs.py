"""Both jobs end to end on hand-made files, with the CSV hand-over between them."""

import os

from pyspark.sql import functions as F

from simtrail import schemas
from simtrail.__main__ import main as cli
from simtrail.config import CarrierSlots
from simtrail.sources import readers

SLOTS = CarrierSlots()


def _inputs(spark, root):
    activity = [
        ("d1", "Smart", "cellular", "20211101", 5), ("d1", "Metfone", "cellular", "20211102", 3),
        ("d2", "Smart", "cellular", "20211103", 1), ("d2", "Cellcard", "cellular", "20211130", 9),
        ("d2", "Metfone", "cellular", "20211115", 4), ("d3", "Smart", "cellular", "20211105", 2),
        ("d1", "Smart", "cellular", "20211201", 50),  # outside the period
    ]
    spark.createDataFrame(activity, schemas.CARRIER_ACTIVITY_RAW).write.mode("overwrite").parquet(f"{root}/activity")
    pt = lambda st, t: ("c", st, "KH", t, 1)
    locs = [
        ("d1", [pt("Kandal", "2021-11-01 07:00:00"), pt("Phnom Penh", "2021-11-01 08:00:00")]),
        ("d1", [pt("Kandal", "2021-11-02 18:00:00")]),
        ("d2", [pt("Phnom Penh", "2021-11-06 09:00:00"), pt("Kandal", "2021-11-06 10:00:00")]),
        ("d3", [pt("Kandal", "2021-11-01 07:00:00"), pt("Phnom Penh", "2021-11-01 08:00:00")]),  # not profiled
    ]
    spark.createDataFrame(
        locs, "ifa string, gps array<struct<city:string,state:string,country:string,last_seen:string,brq_count:long>>"
    ).write.mode("overwrite").parquet(f"{root}/locations")
    for seg, ids in (("PP", ["d1"]), ("SS", ["d1", "d2"])):
        spark.createDataFrame([(i,) for i in ids], "ifa string").write.mode("overwrite").parquet(f"{root}/segments/{seg}")


def test_profile_then_travel(spark, scratch_dir):
    root = os.path.join(scratch_dir, "jobs")
    _inputs(spark, root)
    cli(["profile", "--activity", f"{root}/activity", "--start", "20211101", "--end", "20211130",
         "--out", f"{root}/profile", "--csv", "--single-file", "--carriers", "Smart,Metfone,Cellcard"])
    prof = readers.read_sim_profile(spark, f"{root}/profile", SLOTS.score_columns, fmt="csv")
    assert sorted(r["ifa"] for r in prof.collect()) == ["d1", "d2"]
    cli(["report", "--profile", f"{root}/profile", "--profile-csv", "--out", f"{root}/report"])
    seg = spark.read.parquet(f"{root}/report/delta_segments")
    assert seg.agg(F.sum("devices")).first()[0] == 2
    prim = spark.read.parquet(f"{root}/report/primary_sim")
    assert prim.agg(F.sum("count")).first()[0] == 2
    cli(["travel", "--locations", f"{root}/locations", "--profile", f"{root}/profile", "--profile-csv",
         "--segments", f"{root}/segments", "--segments-layout", "folders", "--out", f"{root}/travel",
         "--corridor", "Kandal,Phnom Penh", "--unit-minutes", "30", "--cuts", "0.1,0.8", "--restrict", "late",
         "--start", "2021-11-01", "--end", "2021-11-06"])
    tp = spark.read.parquet(f"{root}/travel/trip_profile")
    got = sorted((r["ifa"], r["travel"], r["count"]) for r in tp.collect())
    assert got == [("d1", "Kandal_Phnom Penh", 1), ("d1", "Phnom Penh_Kandal", 1), ("d2", "Phnom Penh_Kandal", 1)]
    base = f"{root}/travel/corridor=kandal_phnom_penh"
    tiers = spark.read.parquet(f"{base}/segment_tiers")
    all_rows = tiers.where(F.col("segment") == "all").agg(F.sum("ifa_count")).first()[0]
    assert all_rows == 2
    wk = spark.read.parquet(f"{base}/segment_weekparts")
    assert wk.where(F.col("segment") == "all").agg(F.sum("count")).first()[0] == 2 + 2 + 1


def test_default_parquet_paths(spark, scratch_dir):
    root = os.path.join(scratch_dir, "jobs_parquet")
    _inputs(spark, root)
    membership = spark.createDataFrame([("d1", "PP"), ("d2", "SS")], "ifa string, segment string")
    readers.write_segments(membership, f"{root}/segments_partitioned")
    cli(["profile", "--activity", f"{root}/activity", "--start", "20211101", "--end", "20211130",
         "--out", f"{root}/profile"])
    cli(["report", "--profile", f"{root}/profile", "--out", f"{root}/report"])
    assert spark.read.parquet(f"{root}/report/secondary_sim").agg(F.sum("count")).first()[0] == 2
    cli(["travel", "--locations", f"{root}/locations", "--profile", f"{root}/profile",
         "--segments", f"{root}/segments_partitioned", "--out", f"{root}/travel",
         "--corridor", "Kandal,Phnom Penh"])
    tiers = spark.read.parquet(f"{root}/travel/corridor=kandal_phnom_penh/segment_tiers")
    assert {r["segment"] for r in tiers.collect()} == {"PP", "SS", "all"}
