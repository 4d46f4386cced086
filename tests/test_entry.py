"""Driver contract: entry(), queries() / oracle_sql() pairs, a quick oracle run."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from simtrail.plans import catalog, oracle

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:4] == ["ifa", "primary_sim", "secondary_sim", "third_sim"]


def test_every_query_has_oracle():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(catalog.queries()) <= set(entry_mod.queries())


def _duck():
    con = duckdb.connect()
    for t in ("orders", "events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def duck():
    return _duck()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_oracle_matches(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    rel = duck.sql(oracle.oracle_sql()[name])
    idx = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(r[i] for i in idx) for r in rel.fetchall())
    assert got == want


def test_no_row_caps_samples_or_cross_joins(spark):
    """Every registered query reads its tables whole: no limit or sample,
    except the top-k report, where the limit is the feature; and no
    nested-loop or Cartesian join appears in any physical plan."""
    for name, fn in sorted(catalog.queries().items()):
        qe = fn(spark, SF)._jdf.queryExecution()
        plan = qe.optimizedPlan().toString()
        assert "Sample" not in plan, name
        if name != "top_trips":
            assert "Limit" not in plan, name
        physical = qe.executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in physical and "CartesianProduct" not in physical, name
