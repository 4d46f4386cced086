"""Distributed percent_rank equals Spark's built-in, bit for bit."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from simtrail.functions.ranking import exact_percentiles, percent_rank, ranged_runs, value_counts


def _builtin(df, asc):
    order = F.col("v").asc() if asc else F.col("v").desc()
    return {r["id"]: r["p"] for r in df.withColumn("p", F.percent_rank().over(Window.orderBy(order))).collect()}


def _ours(df, asc):
    return {r["id"]: r["p"] for r in percent_rank(df, "v", ascending=asc, out="p").select("id", "p").collect()}


@pytest.fixture
def all_ranges(spark):
    """Small ranges stay apart, as they do on large inputs."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("asc", [True, False])
def test_ties_and_nulls(spark, all_ranges, asc):
    rnd = random.Random(7)
    rows = [(i, rnd.choice([None, 1.0, 2.0, 2.0, 7.5, float(rnd.randint(0, 40))])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v double")
    assert _ours(df, asc) == _builtin(df, asc)


def test_single_row_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0)], "id long, v double")
    assert _ours(df, True) == {1: 0.0}


def test_all_tied_is_zero(spark):
    df = spark.createDataFrame([(i, 3.0) for i in range(10)], "id long, v double")
    assert set(_ours(df, True).values()) == {0.0}


def test_ties_at_top_keep_max_below_one(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 3.0)], "id long, v double")
    assert max(_ours(df, True).values()) == pytest.approx(2 / 3)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=60), st.booleans())
def test_property_matches_builtin(spark, values, asc):
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    assert _ours(df, asc) == _builtin(df, asc)


def test_distributed_plan_has_no_builtin_percent_rank(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 7).cast("double").alias("v"))
    plan = percent_rank(df, "v", out="p")._jdf.queryExecution().executedPlan().toString()
    assert "percent_rank" not in plan.lower()


def test_counts_keep_real_nulls_apart(spark):
    df = spark.createDataFrame(
        [(1, None, 2.0), (2, 5, None), (3, 5, 2.0), (4, None, 3.0)], "id long, a long, b double"
    )
    rows = value_counts(df, ["a", "b"]).collect()
    got_a = {(r["a"], r["__n"]) for r in rows if r["__gid"] == 1}
    got_b = {(r["b"], r["__n"]) for r in rows if r["__gid"] == 2}
    assert got_a == {(5, 2), (None, 2)}
    assert got_b == {(2.0, 2), (3.0, 1), (None, 1)}


def test_ranges_follow_the_shuffle_width(spark, all_ranges):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") * 37 % 9973).cast("double").alias("v"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for n in (width, 4 * width):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            counts = value_counts(df, ["v"])
            parts = counts.groupBy("__part").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("__part").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", width)
        assert len(parts) == n
        assert all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:], strict=False))


def test_scores_from_shared_histograms_match_builtin_with_nulls(spark):
    from simtrail.operators import rfm

    rnd = random.Random(11)
    rows = [(f"d{i % 97}", f"c{i % 3}", rnd.choice([None, 1, 2, 3]), rnd.choice([None, 1.0, 4.0]),
             rnd.choice([None, 10.0, 20.0, float(i)]), 1, 1) for i in range(600)]
    df = spark.createDataFrame(
        rows, "ifa string, carrier string, recency_days int, usage_frequency double, brq_m double, "
        "data_usage_freq long, brq_count long")
    a = {(r["ifa"], r["carrier"], r["recency_days"], r["usage_frequency"], r["brq_m"]): (r["r"], r["f"], r["m"])
         for r in rfm.rfm_score(df).collect()}
    b = {(r["ifa"], r["carrier"], r["recency_days"], r["usage_frequency"], r["brq_m"]): (r["r"], r["f"], r["m"])
         for r in rfm.rfm_score(df, method="window").collect()}
    assert len(rfm.rfm_score(df).collect()) == 600 and a == b


def test_dates_rank_like_builtin(spark):
    import datetime as dt

    rows = [(i, dt.date(2021, 1, 1) + dt.timedelta(days=i % 17)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v date")
    for asc in (True, False):
        assert _ours(df, asc) == _builtin(df, asc)


@pytest.mark.parametrize("asc", [True, False])
def test_hot_value_is_spread_over_ranges(spark, all_ranges, asc):
    """A value held by half of all rows crosses ranges: no range has twice the median, ranks stay those of one sort."""
    rnd = random.Random(2)
    rows = [(i, 5.0 if i % 2 else rnd.choice([None, float("nan"), -0.0, 0.0, rnd.uniform(0, 9)])) for i in range(12_000)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(6)
    sizes = sorted(r["count"] for r in ranged_runs(df, "v", ascending=asc).groupBy("__part").count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2], sizes
    assert _ours(df, asc) == _builtin(df, asc)


def test_ranks_of_strings_and_of_no_rows(spark):
    df = spark.createDataFrame([(i, "äbc"[i % 3] if i % 5 else None) for i in range(60)], "id long, v string")
    assert _ours(df, True) == _builtin(df, True)
    assert percent_rank(df.limit(0), "v").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_percentiles_equal_the_builtin(spark, all_ranges, n):
    rnd = random.Random(n)
    rows = [(rnd.choice([None, rnd.randint(0, 9), rnd.randint(0, 10**6)]),) for _ in range(n)] + [(3,)]
    df = spark.createDataFrame(rows, "v long")
    ps = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]
    want = df.agg(F.percentile("v", ps)).first()[0]
    assert exact_percentiles(df, "v", ps).first()["__p"] == want
    assert exact_percentiles(df.limit(0), "v", ps).first()["__p"] is None


def test_percentiles_of_a_million_distinct_values(spark):
    df = spark.range(1_000_001).select((F.col("id") * 7919 % 1_000_003).alias("v"))
    got = exact_percentiles(df, "v", [0.1, 0.5, 0.9]).first()["__p"]
    assert got == df.agg(F.percentile("v", [0.1, 0.5, 0.9])).first()[0]
