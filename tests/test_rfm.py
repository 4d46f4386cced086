"""RFM base and scores on hand-made activity (FIXTURES.md F1, F6)."""

import datetime as dt

import pytest

from simtrail.config import CarrierSlots
from simtrail.operators import rfm, sim

SCHEMA = "ifa string, carrier string, network string, date date, brq_count long"
SLOTS = CarrierSlots()


def d(y, m, day):
    return dt.date(y, m, day)


ROWS = [
    # device x: Smart twice on one day (one active day, volume summed), Metfone on two days
    ("x", "Smart", "cellular", d(2021, 12, 31), 5),
    ("x", "Smart", "cellular", d(2021, 12, 31), 7),
    ("x", "Metfone", "cellular", d(2021, 12, 30), 1),
    ("x", "Metfone", "cellular", d(2022, 1, 2), 1),
    # dropped rows: null carrier, wifi
    ("x", None, "cellular", d(2022, 1, 2), 100),
    ("x", "Cellcard", "wifi", d(2022, 1, 2), 100),
    # device y: one carrier only -> not multi-SIM
    ("y", "Smart", "cellular", d(2022, 1, 1), 9),
    # a row whose date did not parse adds volume but no active day
    ("x", "Metfone", "cellular", None, 10),
    # device z: three listed carriers plus a fourth one
    ("z", "Smart", "cellular", d(2022, 1, 1), 2),
    ("z", "Metfone", "cellular", d(2022, 1, 1), 3),
    ("z", "Cellcard", "cellular", d(2021, 12, 1), 4),
    ("z", "Other", "cellular", d(2022, 1, 3), 8),
]


@pytest.fixture(scope="module")
def activity(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_multi_sim_devices(activity):
    got = {r["ifa"]: r["total_carriers"] for r in rfm.multi_sim_devices(activity).collect()}
    assert got == {"x": 2, "z": 4}


def test_rfm_base_values(activity):
    base = {(r["ifa"], r["carrier"]): r for r in rfm.rfm_base(activity).collect()}
    assert set(base) == {("x", "Smart"), ("x", "Metfone"), ("z", "Smart"), ("z", "Metfone"),
                         ("z", "Cellcard"), ("z", "Other")}
    # global last day = 2022-01-03; true date differences across the year end
    assert base[("x", "Smart")]["recency_days"] == 4
    assert base[("x", "Metfone")]["recency_days"] == 2
    assert base[("z", "Cellcard")]["recency_days"] == 34
    assert base[("x", "Smart")]["data_usage_freq"] == 1
    assert base[("x", "Smart")]["brq_count"] == 12
    assert base[("x", "Metfone")]["data_usage_freq"] == 2
    assert base[("x", "Metfone")]["brq_count"] == 12
    assert base[("x", "Smart")]["usage_frequency"] == 1.0 and base[("x", "Smart")]["brq_m"] == 12.0


def test_rfm_base_monthly_normalisation(activity):
    base = {(r["ifa"], r["carrier"]): r for r in rfm.rfm_base(activity, normalise="months").collect()}
    # months spanned: 2021-12 .. 2022-01 = 2
    assert base[("x", "Smart")]["brq_m"] == 6.0
    assert base[("x", "Metfone")]["usage_frequency"] == 1.0


def test_scores_match_builtin_and_range(activity):
    base = rfm.rfm_base(activity)
    a = {(r["ifa"], r["carrier"]): (r["r"], r["f"], r["m"], r["rfm"]) for r in rfm.rfm_score(base).collect()}
    b = {(r["ifa"], r["carrier"]): (r["r"], r["f"], r["m"], r["rfm"])
         for r in rfm.rfm_score(base, method="window").collect()}
    assert a == b
    assert all(0.0 <= v <= 5.0 for t in a.values() for v in t[:3])
    mx = rfm.score_maxima(rfm.rfm_score(base)).first()
    # two pairs tie at the top volume (12): ties share the lower rank, so the
    # largest m is 4/5 * 5 = 4.0, below 5 (as in the reference's r maximum)
    assert mx["max_m"] == 4.0


def test_wide_table(activity):
    score = rfm.rfm_score(rfm.rfm_base(activity))
    wide = {r["ifa"]: r for r in sim.carrier_wide(score, SLOTS).collect()}
    z = wide["z"]
    assert z["carriers"] == ["Cellcard", "Metfone", "Other", "Smart"]
    assert z["carrier_number"] == 4  # the fourth carrier counts, but has no column
    per = {(r["ifa"], r["carrier"]): r["rfm"] for r in score.collect()}
    assert z["all_rfm"] == pytest.approx(sum(v for (i, _), v in per.items() if i == "z"))
    assert z["all_rfm"] > z["smart_rfm"] + z["metfone_rfm"] + z["cellcard_rfm"] - 1e-12
    x = wide["x"]
    assert x["cellcard_rfm"] == 0.0  # absent carrier -> 0.0, not null
    assert x["all_rfm"] == x["smart_rfm"] + x["metfone_rfm"]
    pivot = {r["ifa"]: r for r in sim.carrier_pivot(score, SLOTS).collect()}
    for c in SLOTS.score_columns:
        assert pivot["z"][c] == z[c] and pivot["x"][c] == x[c]


def test_key_check(activity):
    kc = rfm.key_check(rfm.rfm_score(rfm.rfm_base(activity)), ["ifa", "carrier"]).first()
    assert kc["rows"] == kc["distinct_keys"] == 6


def test_distribution(activity):
    dist = {(r["data_usage_freq"], r["carrier"]): r["ifa_count"]
            for r in rfm.rfm_distribution(rfm.rfm_base(activity), "data_usage_freq").collect()}
    assert dist[(1, "Smart")] == 2 and dist[(2, "Metfone")] == 1


def test_base_is_checkpointed(activity):
    """The written table is read; without the checkpoint the plan holds the aggregation."""
    written = rfm.rfm_base(activity)._jdf.queryExecution().optimizedPlan().toString()
    lazy = rfm.rfm_base(activity, checkpoint=False)
    whole = lazy._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [ifa" not in written and "Aggregate [ifa" in whole
    assert lazy.count() == 6


def test_active_days_over_years_and_before_1970(spark):
    days = [d(1969, 12, 31), d(1970, 1, 1), d(2020, 2, 29), d(2020, 2, 29), d(2021, 2, 28), d(2021, 12, 31)]
    rows = [("a", c, "cellular", day, 2) for c in ("Smart", "Metfone") for day in days]
    got = rfm.rfm_base(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["data_usage_freq"], r["brq_count"]) for r in got] == [(5, 12), (5, 12)]


def test_null_device_is_no_device(spark):
    rows = [(None, c, "MOBILE", dt.date(2021, 9, 1), 5) for c in ("Smart", "Metfone")]
    rows += [("a", c, "MOBILE", dt.date(2021, 9, 2), 5) for c in ("Smart", "Metfone")]
    activity = spark.createDataFrame(rows, SCHEMA)
    base = rfm.rfm_base(activity, network="MOBILE")
    assert {r["ifa"] for r in base.collect()} == {"a"}
