"""Corridor tiers, percentiles and segment profiles (FIXTURES.md F4, F5)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simtrail import config
from simtrail.operators import cohort, segments

PROFILE = "ifa string, travel string, weekday_weekend string, time_of_day string, count long"


@pytest.fixture(scope="module")
def profile(spark):
    rows = []
    counts = [1, 1, 2, 2, 2, 3, 4, 4, 6, 12]
    for i, c in enumerate(counts):
        half = c // 2
        rows.append((f"d{i}", "Kandal_Phnom Penh", "weekday", "morning", c - half))
        if half:
            rows.append((f"d{i}", "Phnom Penh_Kandal", "weekend", "evening", half))
    rows.append(("out", "Takeo_Phnom Penh", "weekday", "night", 50))  # outside the corridor
    return spark.createDataFrame(rows, PROFILE)


def test_corridor_filters_and_totals(profile):
    rows = cohort.corridor(profile, "Kandal", "Phnom Penh")
    assert "travel" not in rows.columns
    wk = {r["weekday_weekend"]: r["count"] for r in cohort.corridor_by_weekpart(rows).collect()}
    dp = {r["time_of_day"]: r["count"] for r in cohort.corridor_by_daypart(rows).collect()}
    assert sum(wk.values()) == sum(dp.values()) == 37


def test_deciles_match_linear_interpolation(profile):
    per = cohort.corridor_per_device(cohort.corridor(profile, "Kandal", "Phnom Penh"))
    got = cohort.percentile_profile(per).first()
    vals = sorted(r["count"] for r in per.collect())
    for p in config.DECILES:
        assert got[f"p{round(p * 100):02d}"] == pytest.approx(np.percentile(vals, p * 100))


def test_tiers_inclusive_cuts(profile):
    per = cohort.corridor_per_device(cohort.corridor(profile, "Kandal", "Phnom Penh"))
    tiers = {r["ifa"]: (r["count"], r["tier_id"], r["tier_level"]) for r in cohort.tier(per).collect()}
    vals = sorted(v[0] for v in tiers.values())
    lo, hi = np.percentile(vals, 10), np.percentile(vals, 80)
    for n, tid, level in tiers.values():
        want = "Low" if 0 < n <= lo else "Mid" if lo < n <= hi else "High"
        assert level == want, (n, lo, hi)
    assert {v[1] for v in tiers.values()} <= {"TRV_01_001", "TRV_01_002", "TRV_01_003"}
    four = {r["ifa"]: r["tier_level"] for r in cohort.tier(per, config.TIER_CUTS_FOUR).collect()}
    assert four["d9"] == "Ultra High"


def test_segments_distinct_vs_sum(spark, profile):
    rows = cohort.corridor(profile, "Kandal", "Phnom Penh")
    tiers = cohort.tier(cohort.corridor_per_device(rows))
    membership = spark.createDataFrame(
        [("d9", "PP"), ("d9", "SS"), ("d0", "SS"), ("d5", "Others")], "ifa string, segment string"
    )
    tp = segments.segment_tier_profile(tiers, membership).collect()
    all_rows = {r["tier_level"]: r["ifa_count"] for r in tp if r["segment"] == "all"}
    assert sum(all_rows.values()) == 3  # d9 counted once in "all"
    dp = segments.segment_daypart_profile(cohort.device_daypart(rows), membership).collect()
    all_sum = sum(r["count"] for r in dp if r["segment"] == "all")
    seg_sum = sum(r["count"] for r in dp if r["segment"] != "all")
    assert all_sum == seg_sum == 12 * 2 + 1 + 3  # d9 counted twice in sums
    wp = segments.segment_weekpart_profile(cohort.device_weekpart(rows), membership).collect()
    assert sum(r["count"] for r in wp if r["segment"] == "all") == all_sum


def test_tier_exact_cut_values(spark):
    # counts 0..10: p10 = 1.0 and p80 = 8.0 fall exactly on data values
    per = spark.createDataFrame([(f"d{i}", i) for i in range(11)], "ifa string, count long")
    got = {r["count"]: (r["tier_id"], r["tier_level"]) for r in cohort.tier(per).collect()}
    assert got[0] == (None, None)  # not > 0: no tier
    assert got[1] == ("TRV_01_001", "Low")  # on the lower cut: Low (inclusive)
    assert got[2] == ("TRV_01_002", "Mid")
    assert got[8] == ("TRV_01_002", "Mid")  # on the upper cut: Mid (inclusive)
    assert got[9] == ("TRV_01_003", "High")


def test_approximate_percentiles_option(spark):
    per = spark.createDataFrame([(f"d{i}", i) for i in range(1, 1001)], "ifa string, count long")
    exact = cohort.percentile_profile(per).first()
    approx = cohort.percentile_profile(per, accuracy=10_000).first()
    for c in exact.asDict():
        assert abs(exact[c] - approx[c]) <= 1.0  # data values within one rank of the exact cut
    tiers = {r["tier_level"] for r in cohort.tier(per, accuracy=10_000).collect()}
    assert tiers == {"Low", "Mid", "High"}


def test_many_corridors_in_one_scan(spark):
    """Every dataset of every corridor equals the single-corridor one; the profile is read once."""
    import random

    from simtrail.operators import corridors
    from simtrail.plans import travel

    rnd = random.Random(4)
    rows = [(f"d{rnd.randint(0, 60)}", f"{a}_{b}", rnd.choice(["weekday", "weekend"]), rnd.choice(["morning", "night"]), rnd.randint(1, 9))
            for a, b in ("AB", "BA", "AC", "CA", "BC", "CD") for _ in range(80)]
    profile = spark.createDataFrame(rows, "ifa string, travel string, weekday_weekend string, time_of_day string, count long")
    members = spark.createDataFrame([(f"d{i}", s) for i in range(50) for s in ("PP", "SS")[: 1 + i % 2]], "ifa string, segment string")
    pairs = [("A", "B"), ("C", "A"), ("B", "A"), ("X", "Y")]
    got = corridors.corridor_cohorts(profile, pairs, members)
    for a, b in pairs[:2]:
        want = travel.corridor_report(profile, a, b, members)
        assert set(want) == set(got)
        for name, df in want.items():
            own = got[name].where(F.col("corridor") == f"{a}_{b}").select(*df.columns)
            assert sorted(map(tuple, own.collect())) == sorted(map(tuple, df.collect())), (a, b, name)
    assert {r["corridor"] for r in got["per_device"].collect()} == {"A_B", "C_A"}


def test_corridors_are_written_to_their_folders(spark, tmp_path):
    from simtrail.plans import travel

    df = spark.createDataFrame([("A_B", "x", 1), ("C D_A", "y", 2)], "corridor string, k string, n long")
    keys = {"A_B": "corridor=a_b", "C D_A": "corridor=c_d_a", "X_Y": "corridor=x_y"}
    for _ in range(2):  # a second run replaces the first
        written = travel.save_by_corridor(df, str(tmp_path), "totals", keys)
    assert {k: [tuple(r) for r in spark.read.parquet(p).collect()] for k, p in written.items()} == {
        "corridor=a_b/totals": [("x", 1)], "corridor=c_d_a/totals": [("y", 2)], "corridor=x_y/totals": []}
    assert sorted(x.name for x in tmp_path.iterdir()) == ["corridor=a_b", "corridor=c_d_a", "corridor=x_y"]


@pytest.mark.parametrize("sizes", [[1], [5, 1, 40], [300, 2]])
def test_percentiles_by_group(spark, sizes):
    import random

    from simtrail.functions.ranking import exact_percentiles

    rnd = random.Random(sum(sizes))
    rows = [(f"g{i}", rnd.choice([None, rnd.randint(0, 30)])) for i, n in enumerate(sizes) for _ in range(n)] + [(f"g{i}", 7) for i in range(len(sizes))]
    df = spark.createDataFrame(rows, "g string, v long")
    ps = [0.0, 0.1, 0.5, 0.8, 1.0]
    want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("v", ps).alias("p")).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r["g"]: r["__p"] for r in exact_percentiles(df, "v", ps, by=["g"]).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_bitmap_counts_equal_distinct_counts_and_merge(spark):
    """Over several 32,768-number buckets; tables of two periods unite without their rows."""
    from simtrail.functions.distinct import device_bitmaps, device_numbers, distinct_counts, merged_bitmaps

    rows = spark.range(120_000).select(
        (F.col("id") % 70_001).cast("string").alias("ifa"), (F.col("id") % 3).alias("a"), (F.col("id") % 7 % 4).alias("b"), (F.col("id") % 5).alias("period")
    )
    rows = rows.unionByName(rows.limit(10).withColumn("ifa", F.lit(None).cast("string")))
    numbers = device_numbers(rows)
    got = numbers.agg(F.count(F.lit(1)), F.countDistinct("device_no"), F.min("device_no"), F.max("device_no")).first()
    assert tuple(got) == (70_001, 70_001, 0, 70_000)
    joined = rows.join(numbers, "ifa")
    parts = [device_bitmaps(joined.where(cond), ["a", "b"]) for cond in ("period < 2", "period >= 2")]
    both = merged_bitmaps(parts[0].unionByName(parts[1]), ["a", "b"])
    for dims in (["a", "b"], ["a"], ["b"]):
        want = {tuple(r) for r in rows.groupBy(*dims).agg(F.countDistinct("ifa").alias("n")).collect()}
        assert {tuple(r) for r in distinct_counts(both, dims, "n").collect()} == want
