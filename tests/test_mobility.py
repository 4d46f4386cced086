"""Trips and calendar features on hand-made observations (FIXTURES.md F2)."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from simtrail.operators import mobility

SCHEMA = "ifa string, obs_id long, seen_at timestamp, state string"


def ts(day, hour, minute=0):
    return dt.datetime(2021, 9, day, hour, minute)


def _trips(spark, rows, **kw):
    pts = spark.createDataFrame(rows, SCHEMA)
    out = mobility.calendar_features(mobility.trips(mobility.movements(pts, **kw)))
    return sorted((r["ifa"], r["obs_id"], r["travel"]) for r in out.collect())


def test_same_state_run_then_change(spark):
    rows = [("a", 1, ts(1, 8), "A"), ("a", 2, ts(1, 9), "A"), ("a", 3, ts(1, 10), "B")]
    assert _trips(spark, rows) == [("a", 2, "A_B")]


def test_last_observation_has_no_trip(spark):
    rows = [("a", 1, ts(1, 8), "A")]
    pts = spark.createDataFrame(rows, SCHEMA)
    mv = mobility.movements(pts).collect()
    assert len(mv) == 1 and mv[0]["has_next"] is False and mv[0]["next_state"] is None
    assert _trips(spark, rows) == []


def test_null_state_is_not_skipped(spark):
    rows = [("a", 1, ts(1, 8), "A"), ("a", 2, ts(1, 9), None), ("a", 3, ts(1, 10), "B")]
    assert _trips(spark, rows) == []


def test_devices_never_linked(spark):
    rows = [("a", 1, ts(1, 8), "A"), ("b", 2, ts(1, 9), "B")]
    assert _trips(spark, rows) == []


def test_trip_across_midnight_and_empty_days(spark):
    rows = [("a", 1, ts(1, 23, 50), "A"), ("a", 2, ts(2, 0, 10), "B"), ("a", 3, ts(9, 12), "C")]
    assert _trips(spark, rows) == [("a", 1, "A_B"), ("a", 2, "B_C")]


def test_equal_timestamps_use_tie_break(spark):
    rows = [("a", 2, ts(1, 8), "B"), ("a", 1, ts(1, 8), "A"), ("a", 3, ts(1, 9), "C")]
    assert _trips(spark, rows) == [("a", 1, "A_B"), ("a", 2, "B_C")]


@pytest.mark.parametrize(
    "hour,part",
    [(5, "night"), (6, "morning"), (12, "morning"), (13, "afternoon"), (17, "afternoon"),
     (18, "evening"), (22, "evening"), (23, "night"), (0, "night")],
)
def test_daypart_boundaries(spark, hour, part):
    rows = [("a", 1, ts(1, hour), "A"), ("a", 2, ts(1, hour) + dt.timedelta(minutes=30), "B")]
    pts = spark.createDataFrame(rows, SCHEMA)
    r = mobility.calendar_features(mobility.trips(mobility.movements(pts))).collect()[0]
    assert r["time_of_day"] == part and r["hour"] == hour


@pytest.mark.parametrize(
    "day,name,part",
    [(17, "Friday", "weekday"), (18, "Saturday", "weekend"), (19, "Sunday", "weekend"), (20, "Monday", "weekday")],
)
def test_weekpart(spark, day, name, part):
    rows = [("a", 1, ts(day, 21), "A"), ("a", 2, ts(day + 1, 7), "B")]
    pts = spark.createDataFrame(rows, SCHEMA)
    r = mobility.calendar_features(mobility.trips(mobility.movements(pts))).collect()[0]
    # Features come from the departure, not the arrival.
    assert (r["day"], r["weekday_weekend"], r["time_of_day"]) == (name, part, "evening")


def test_split_equals_plain_device_lead(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(1500):
        dev = "hot" if i % 3 else f"d{rnd.randint(0, 20)}"
        rows.append((dev, i, ts(rnd.randint(1, 20), rnd.randint(0, 23), rnd.randint(0, 59)),
                     rnd.choice(["A", "B", "C", None])))
    pts = spark.createDataFrame(rows, SCHEMA)
    w = Window.partitionBy("ifa").orderBy("seen_at", "obs_id")
    plain = pts.select("ifa", "obs_id", "state", F.lead("state").over(w).alias("next_state"),
                       F.lead("obs_id").over(w).isNotNull().alias("has_next"))
    expect = sorted(tuple(r) for r in plain.collect())
    for minutes in (None, 1, 10, 60, 1440):
        got = mobility.movements(pts, unit_minutes=minutes).select(
            "ifa", "obs_id", "state", "next_state", "has_next")
        assert sorted(tuple(r) for r in got.collect()) == expect, minutes


def test_ties_without_ids_lose_and_invent_no_link(spark):
    """Many rows at one time, no obs_id: the sequence of states is that of one sort by (time, state)."""
    rnd = random.Random(5)
    rows = [("t", None, ts(1, 8, 10 * (i % 3)), rnd.choice(["A", "B", "C", None])) for i in range(900)]
    moves = mobility.movements(spark.createDataFrame(rows, SCHEMA))
    order = sorted(rows, key=lambda r: (r[2], r[3] is not None, r[3] or ""))
    expect = sorted((a[3] or "", b[3] or "") for a, b in zip(order, order[1:]))
    got = moves.where("has_next").collect()
    assert sorted((r["state"] or "", r["next_state"] or "") for r in got) == expect
    assert moves.where("not has_next").count() == 1


def test_crowded_minute_is_spread_over_ranges(spark):
    """A third of all rows in one minute of one device: no range holds twice the median, and the links are those of one sort."""
    rnd = random.Random(9)
    rows = [("hot", None, ts(3, 8), rnd.choice("ABCDEFGH") + str(i)) for i in range(4000)]
    rows += [(f"d{rnd.randint(0, 400)}", i, ts(rnd.randint(1, 20), rnd.randint(0, 23), rnd.randint(0, 59)), rnd.choice("AB")) for i in range(8000)]
    pts = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = mobility.ordered_points(pts).groupBy("__part").count().collect()
        moves = mobility.movements(pts)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = sorted(r["count"] for r in parts)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2], sizes
    hot = [r for r in moves.where("ifa = 'hot'").collect()]
    order = sorted(r[3] for r in rows if r[0] == "hot")
    assert {(r["state"], r["next_state"]) for r in hot} == set(zip(order, [*order[1:], None]))
    assert sum(not r["has_next"] for r in hot) == 1


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_or_no_rows(spark, n):
    rows = [("a", i, ts(1, 8 + i), "AB"[i % 2]) for i in range(n)]
    moves = mobility.movements(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["obs_id"], r["next_state"]) for r in moves) == [(i, "AB"[(i + 1) % 2] if i + 1 < n else None) for i in range(n)]


def test_rows_without_device_are_dropped(spark):
    rows = [(None, 1, ts(1, 8), "A"), (None, 2, ts(1, 9), "B"), ("a", 3, ts(1, 8), "A"), ("a", 4, ts(1, 9), "B")]
    assert {r["ifa"] for r in mobility.movements(spark.createDataFrame(rows, SCHEMA)).collect()} == {"a"}


def test_one_row_level_sort(spark):
    """The executed plan sorts the observations once; the other sorts are of one row a unit."""
    rows = [("a", i, ts(1 + i % 5, i % 24), "AB"[i % 2]) for i in range(200)]
    out = mobility.trips(mobility.movements(spark.createDataFrame(rows, SCHEMA), unit_minutes=10))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in line and "seen_at" in line for line in plan.splitlines()) == 1, plan


def test_restrict_to_devices_is_semi_join(spark):
    rows = [("a", 1, ts(1, 8), "A"), ("a", 2, ts(1, 9), "B"), ("b", 3, ts(1, 8), "A"), ("b", 4, ts(1, 9), "B")]
    pts = spark.createDataFrame(rows, SCHEMA)
    devices = spark.createDataFrame([("a",), ("a",)], "ifa string")  # listed twice
    for minutes in (None, 10):
        out = mobility.trips(mobility.movements(pts, devices, unit_minutes=minutes))
        assert sorted((r["ifa"], r["travel"]) for r in out.collect()) == [("a", "A_B")]
    assert "LeftSemi" in out._jdf.queryExecution().executedPlan().toString()


def test_location_points_explode_and_country(spark):
    nested = spark.createDataFrame(
        [
            ("a", [("X", "A", "KH", "2021-09-01 08:00:00", 1, 1), ("Y", "B", "TH", "2021-09-01 09:00:00", 1, 2)]),
            ("b", None),
            ("c", []),
        ],
        "ifa string, gps array<struct<city:string,state:string,country:string,last_seen:string,brq_count:long,obs_id:long>>",
    )
    pts = mobility.location_points(nested, "KH", tie_break="obs_id").collect()
    assert [(r["ifa"], r["state"], r["seen_at"]) for r in pts] == [("a", "A", dt.datetime(2021, 9, 1, 8))]


def test_profile_and_od_matrix_totals_agree(spark):
    rows = [("a", 1, ts(1, 8), "A"), ("a", 2, ts(1, 9), "B"), ("a", 3, ts(1, 10), "A"), ("b", 4, ts(2, 8), "A"),
            ("b", 5, ts(2, 20), "B")]
    prof = mobility.trip_profile(mobility.calendar_features(mobility.trips(mobility.movements(
        spark.createDataFrame(rows, SCHEMA)))))
    od = mobility.od_matrix(prof)
    assert prof.agg(F.sum("count")).first()[0] == od.agg(F.sum("count")).first()[0] == 3
    top = mobility.top_trips(prof, 1).collect()[0]
    # all counts are 1: the key columns break the tie
    assert (top["ifa"], top["travel"], top["count"]) == ("a", "A_B", 1)
    und = {r["route"]: r["count"] for r in mobility.undirected_travel(mobility.trips(mobility.movements(
        spark.createDataFrame(rows, SCHEMA)))).collect()}
    assert und == {"A_B": 3}


def test_malformed_time_is_null_not_error(spark):
    """SURVEY 2.11 #6 and #8: a bad timestamp parses to null (ANSI stays on)
    and gives null calendar features, not 'weekday'."""
    nested = spark.createDataFrame(
        [("a", [("X", "A", "KH", "2021-09-01", 1, 1), ("X", "B", "KH", "2021-09-01 08:00:00", 1, 2),
                ("X", "C", "KH", "2021-09-01 09:00:00", 1, 3)])],
        "ifa string, gps array<struct<city:string,state:string,country:string,last_seen:string,brq_count:long,obs_id:long>>",
    )
    pts = mobility.location_points(nested, "KH", tie_break="obs_id")
    assert sorted((r["obs_id"], r["seen_at"] is None) for r in pts.collect()) == [(1, True), (2, False), (3, False)]
    feats = {r["obs_id"]: r for r in mobility.calendar_features(mobility.trips(mobility.movements(pts))).collect()}
    # the null-time observation sorts first and departs A -> B with no calendar features
    assert feats[1]["travel"] == "A_B" and feats[1]["weekday_weekend"] is None and feats[1]["time_of_day"] is None
    assert feats[2]["travel"] == "B_C" and feats[2]["weekday_weekend"] == "weekday"


def test_state_named_like_null_is_kept(spark):
    """SURVEY 2.11 #9: the null-safe filter keeps a province whose name contains 'null'."""
    rows = [("a", 1, ts(1, 8), "Nullarbor"), ("a", 2, ts(1, 9), "B")]
    assert _trips(spark, rows) == [("a", 1, "Nullarbor_B")]
