"""Every registered query on the smallest tables, against its SQL twin where there is one."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) > 100


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        assert compare(got, con.execute(ORACLES[name]).df()) is None
    else:
        assert len(got)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["market", "ts"] and df.count() > 0


@pytest.mark.parametrize("name", ["a8_fills_append", "c2b_pit_matrix_dense", "d10_slippage_reconcile", "d15_feature_drift", "e4_equity_drawdown", "e8_cusum_batch", "e14_rollback_hysteresis"])
def test_query_in_small_cells(spark, sf, con, name, monkeypatch):
    """The same answers where every key is cut into many cells."""
    from tidemark.operators import cells, ordered

    monkeypatch.setattr(ordered, "counted_cells", lambda df, keys, order, rows=0: cells.counted_cells(df, keys, order, 150))
    assert compare(QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()) is None


def test_gate_reads_the_fills_once(spark, sf):
    """Both pairs of thresholds judge one report."""
    scans = lambda name: entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans("d11_calibration_gate") == scans("d10_slippage_reconcile") > 0
