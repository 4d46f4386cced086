
import pytest

from simtrail.config import CarrierSlots
from simtrail.operators import sim

SLOTS = CarrierSlots()  # focal Smart, challenger 1 Metfone, challenger 2 Cellcard
S, M, C = "Smart", "Metfone", "Cellcard"

# (s, m, k, carrier_number) -> (primary, secondary, third, delta)
MATRIX = [
    ((8, 3, 0, 2), (S, M, "0", 5)),
    ((3, 8, 0, 2), (M, S, "0", -5)),
    ((0, 8, 3, 2), (M, C, "0", -8)),
    ((0, 3, 8, 2), (C, M, "0", -3)),
    ((8, 0, 3, 2), (S, C, "0", 5)),
    ((3, 0, 8, 2), (C, S, "0", -5)),
    ((8, 5, 3, 3), (S, M, C, 3)),
    ((8, 3, 5, 3), (S, C, M, 3)),
    ((5, 8, 3, 3), (M, S, C, -3)),
    ((5, 3, 8, 3), (C, S, M, -3)),
    ((3, 8, 5, 3), (M, C, S, -5)),
    ((3, 5, 8, 3), (C, M, S, -2)),
    ((5, 5, 0, 2), ("0", "others", "0", 0)),
    ((0, 5, 5, 2), ("0", "others", "0", -10)),
    ((5, 0, 0, 2), (S, "others", "0", 5)),
    ((0, 0, 0, 2), ("0", "others", "0", 0)),
    ((5, 5, 5, 3), ("0", "others", "0", -5)),
    ((5, 5, 3, 3), ("0", "others", C, -3)),
    ((5, 5, 8, 3), (C, "others", "0", -3)),
    ((8, 5, 5, 3), (S, "others", "0", -2)),
]


@pytest.fixture(scope="module")
def ranked(spark):
    rows = [(i, float(s), float(m), float(k), n) for i, ((s, m, k, n), _) in enumerate(MATRIX)]
    wide = spark.createDataFrame(rows, "ifa long, smart_rfm double, metfone_rfm double, cellcard_rfm double, carrier_number int")
    out = sim.focal_delta(sim.sim_rank(wide, SLOTS), SLOTS)
    return {r["ifa"]: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(MATRIX)))
def test_matrix_row(ranked, i):
    (s, m, k, n), (p, sec, third, delta) = MATRIX[i]
    r = ranked[i]
    assert (r["primary_sim"], r["secondary_sim"], r["third_sim"]) == (p, sec, third), MATRIX[i]
    assert r["delta_rfm"] == pytest.approx(delta)


def test_rank_columns_are_strings(ranked):
    r = ranked[0]
    assert all(isinstance(r[c], str) for c in ("primary_sim", "secondary_sim", "third_sim"))


def test_delta_rules(spark):
    wide = spark.createDataFrame(
        [(1, 8.0, 3.0, 2.0, 3), (2, 8.0, 3.0, 0.0, 2)],
        "ifa long, smart_rfm double, metfone_rfm double, cellcard_rfm double, carrier_number int",
    )
    ranked = sim.sim_rank(wide, SLOTS)
    total = {r["ifa"]: r["delta_rfm"] for r in sim.focal_delta(ranked, SLOTS, "total").collect()}
    by_count = {r["ifa"]: r["delta_rfm"] for r in sim.focal_delta(ranked, SLOTS, "by_count").collect()}
    assert total == {1: 3.0, 2: 5.0}
    assert by_count == {1: 5.0, 2: 5.0}


def test_delta_segments_partition_devices(spark):
    prof = spark.createDataFrame(
        [(1, 2.0), (2, -1.0), (3, 0.0), (4, -3.0)], "ifa long, delta_rfm double"
    )
    rows = {r["delta_class"]: r for r in sim.delta_segments(prof).collect()}
    assert {k: v["devices"] for k, v in rows.items()} == {"primary_focal": 1, "secondary_focal": 2, "either": 1}
    assert sum(v["share_pct"] for v in rows.values()) == pytest.approx(100.0)
    assert rows["secondary_focal"]["share_pct"] == 2 / 4 * 100
