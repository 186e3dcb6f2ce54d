"""Metrics, costs, drift, experiments, ledger and classifier against loops and hand values."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import risk
from tidemark.operators import costs, drift, experiments, ledger, metrics, model, returns, similarity


def column(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def lit(*values):
    return [F.lit(float(v)) for v in values]


def test_cost_and_size_rules(spark):
    assert column(spark, risk.slippage(*lit(0, 5000, 0.5, 0.02))) == 0.25
    assert column(spark, risk.slippage(*lit(10, 0, 0.5, 0.02))) == pytest.approx(0.25 + 0.1 * 0.02 * math.sqrt(10))
    assert column(spark, risk.kelly(*lit(0.6, 1, 1))) == pytest.approx(0.1)
    assert column(spark, risk.kelly(*lit(0.52, 1, 1))) == pytest.approx(0.02)
    for args in ((0.4, 1, 1), (0.6, 1, 0), (0, 1, 1), (1, 1, 1)):
        assert column(spark, risk.kelly(*lit(*args))) == 0.0
    assert column(spark, risk.volume_cap(*lit(0.1, 100000, 1000, 5000))) == 10
    assert column(spark, risk.volume_cap(*lit(0.1, 100000, 1000, 99))) == 1
    assert column(spark, risk.volume_cap(*lit(-0.1, 100000, 1000, 5000))) == 0
    assert column(spark, risk.round_to_tick(F.lit(85.0125), 0.025)) == pytest.approx(85.0)  # half goes to even


def test_order_plan_spreads_the_remainder(spark):
    df = spark.createDataFrame([(13,), (4,)], "n int")
    plan = costs.order_plan(df, F.col("n"), F.lit(1000.0), F.lit(100.0), F.lit(True)).orderBy("n", "slice_no").toPandas()
    assert plan[plan.n == 13].slice_contracts.tolist() == [3, 3, 3, 2, 2]
    assert plan[plan.n == 4].slice_contracts.tolist() == [4]
    assert (plan.price_mid[0], plan.price_step[0], plan.price_cross[0]) == (100.0, pytest.approx(100.1), pytest.approx(101.0))


def test_backtest_metrics_by_hand(spark):
    r = [0.01, -0.02, 0.0, 0.03, -0.11, 0.02]
    df = spark.createDataFrame([("m", datetime(2026, 1, 1) + timedelta(days=i), v, 1, int(v > 0)) for i, v in enumerate(r)], "k string, ts timestamp_ntz, ret double, predicted int, actual int")
    got = metrics.backtest_metrics(df, ["k"], ["ts"]).first()
    a = np.array(r)
    curve = np.cumprod(1 + a)
    assert got["sharpe_ratio"] == pytest.approx(a.mean() / a.std(ddof=1) * math.sqrt(252))
    assert got["total_return"] == pytest.approx(curve[-1] - 1)
    assert got["max_drawdown"] == pytest.approx((curve / np.maximum.accumulate(curve) - 1).min())
    assert (got["hit_rate"], got["n_trades"]) == (0.5, 5)
    one = metrics.backtest_metrics(df.limit(1), ["k"], ["ts"]).first()
    assert one["sharpe_ratio"] == 0.0


def test_fitness_bounds_and_missing(spark):
    def score(**over):
        base = {"sharpe": 1.0, "drawdown": -0.25, "calibration": 0.25, "robustness": 0.5, "slippage_adjusted_return": 0.25, "simplicity": 0.5}
        row = {**base, **over}
        df = spark.createDataFrame([("m", *[row[k] for k in base])], "k string, " + ", ".join(f"{k} double" for k in base))
        return metrics.fitness(df, ["k"]).first()["composite"]

    assert score() == pytest.approx(0.5)
    assert score(sharpe=99.0, drawdown=1.0, calibration=0.0, robustness=1.0, slippage_adjusted_return=9.0, simplicity=1.0) == pytest.approx(1.0)
    assert score(sharpe=-9.0, drawdown=-1.0, calibration=1.0, robustness=0.0, slippage_adjusted_return=-9.0, simplicity=0.0) == pytest.approx(0.0)
    assert score(sharpe=None) is None
    with pytest.raises(ValueError):
        metrics.fitness(spark.range(1), ["id"], {"sharpe": (0.5, 0, 1, False)})


def test_promotion_validity(spark):
    rows = [("a", i, 0.6 if i < 3 else 0.1, 0.5) for i in range(5)] + [("b", i, 0.5, 0.5) for i in range(5)] + [("c", i, 0.9, 0.5) for i in range(4)]
    got = {r["k"]: r for r in metrics.promotion(spark.createDataFrame(rows, "k string, w int, candidate double, champion double"), ["k"]).collect()}
    assert got["a"]["promoted"] and not got["b"]["promoted"]
    assert got["c"]["promoted"] is None and not got["c"]["valid"]


def psi_loop(b, c, bins=10, eps=1e-4):
    bins = max(2, min(bins, len(np.unique(b)) - 1))
    edges = np.quantile(b, np.linspace(0, 1, bins + 1))[1:-1]
    hb = np.bincount(np.searchsorted(edges, b, side="right"), minlength=bins) + eps
    hc = np.bincount(np.searchsorted(edges, c, side="right"), minlength=bins) + eps
    hb, hc = hb / hb.sum(), hc / hc.sum()
    return float(((hc - hb) * np.log(hc / hb)).sum())


def test_drift_against_loops(spark):
    rng = np.random.default_rng(4)
    same = rng.normal(size=1000)
    cases = {
        "same": (same, same), "shift": (rng.normal(size=1000), rng.normal(2, 1, 800)), "binary": (np.array([0.0, 1.0] * 50), rng.normal(size=70)),
        "few": (np.array([1.0, 2.0, 3.0, 3.0]), np.array([2.0, 2.0, 5.0])), "tiny": (np.array([1.0]), np.array([1.0, 2.0])),
    }
    rows = [(k, float(v), cur) for k, (b, c) in cases.items() for cur, vs in ((False, b), (True, c)) for v in vs]
    got = drift.feature_drift(spark.createDataFrame(rows, "feature string, x double, is_current boolean")).toPandas().set_index("feature")
    for k, (b, c) in cases.items():
        assert got.loc[k, "psi"] == pytest.approx(psi_loop(b, c), abs=1e-9), k
        if min(len(b), len(c)) >= 2:
            grid = np.concatenate([b, c])
            gap = max(abs((b <= v).mean() - (c <= v).mean()) for v in grid)
            assert got.loc[k, "ks_stat"] == pytest.approx(gap, abs=1e-12)
    assert got.loc["same", "psi"] < 0.01 and not got.loc["same", "drifted"]
    assert got.loc["shift", "psi"] > 0.25 and got.loc["shift", "drifted"]
    assert (got.loc["tiny", "ks_stat"], got.loc["tiny", "ks_pvalue"]) == (0.0, 1.0)
    assert np.isfinite(got["psi"]).all()


def report_row(spark, **over):
    base = {"sharpe_ratio": 1.0, "max_drawdown": -0.01, "hit_rate": 0.6, "calibration": 0.2, "sharpe_degraded": False, "drawdown_alert": False,
            "hit_rate_degraded": False, "drifted_features": [], "streaming_alerts": []}
    row = {**base, **over}
    return drift.diagnose(spark.createDataFrame(
        [tuple(row.values())],
        "sharpe_ratio double, max_drawdown double, hit_rate double, calibration double, sharpe_degraded boolean, drawdown_alert boolean, "
        "hit_rate_degraded boolean, drifted_features array<string>, streaming_alerts array<string>")).first()


@pytest.mark.parametrize(
    "flags,cause,confidence",
    [
        ({"drifted_features": ["a", "b", "c"], "sharpe_degraded": True}, "feature_distribution_drift", 0.8),
        ({"sharpe_degraded": True, "hit_rate_degraded": True, "calibration": 0.4}, "overfitting", 0.7),
        ({"sharpe_degraded": True}, "performance_degradation", 0.7),
        ({"drawdown_alert": True, "streaming_alerts": ["max_Drawdown"]}, "regime_change", 0.6),
        ({"drawdown_alert": True}, "performance_degradation", 0.5),
        ({"hit_rate_degraded": True, "calibration": 0.31}, "overfitting", 0.7),
        ({}, "performance_degradation", 0.5),
    ],
)
def test_diagnosis_priority(spark, flags, cause, confidence):
    got = report_row(spark, **flags)
    assert (got["primary_cause"], float(got["confidence"])) == (cause, confidence)
    assert got["recommended"] == config.CAUSE_MUTATIONS[cause]
    if not flags:
        assert got["evidence"] == [] and "No strong signals" in got["reasoning"]


def test_reconcile_needs_ten_fills(spark):
    rows = [("A", 0.2, 0.25)] * 9 + [("B", 0.2 + i / 100, 0.3 + i / 50) for i in range(12)] + [("C", 0.2, 0.1 * i) for i in range(10)]
    got = {r["symbol"]: r for r in costs.reconcile(spark.createDataFrame(rows, "symbol string, predicted_slippage double, actual_slippage double")).collect()}
    assert set(got) == {"B", "C"}
    p, a = np.array([0.2 + i / 100 for i in range(12)]), np.array([0.3 + i / 50 for i in range(12)])
    b = got["B"]
    assert b["bias"] == pytest.approx(a.mean() - p.mean()) and b["correlation"] == pytest.approx(1.0)
    assert b["p95_actual"] == pytest.approx(np.percentile(a, 95)) and b["median_predicted"] == pytest.approx(np.median(p))
    assert got["C"]["correlation"] == 0.0
    gate = {r["symbol"]: r for r in costs.calibration_gate(spark.createDataFrame([("x", 0.1, 0.5), ("y", -0.9, 0.9), ("z", 0.1, 0.2)], "symbol string, bias double, correlation double")).collect()}
    assert gate["x"]["calibrated"] and gate["y"]["reason"].startswith("bias") and gate["z"]["reason"].startswith("correlation")


def test_expression_resolution(spark):
    df = spark.createDataFrame([("current * 0.5", 0.1), ("current // 2", 31.0), ("max(8, current // 2)", 31.0), ("max(8, current // 2)", 9.0), ("bottom 3", 1.0)], "e string, c double")
    got = [r["v"] for r in df.select(experiments.resolve(F.col("e"), F.col("c")).alias("v")).collect()]
    assert got == [pytest.approx(0.05), 15.0, 15.0, 8.0, None]
    more = {"min(current, 3) - 1": 2.0, "-current / 4 + 2": -0.25, "(current + 1) * 2": 20.0, "2": None, "current * x": None, "current // 0": None,
            "max()": None, "current ** 2": None, "__import__('os')": None, "max(1, current) if current else 2": None, "": None, "current": 9.0, "True * current": None}
    assert {e: experiments.evaluate(e, 9.0) for e in more} == more
    assert experiments.evaluate("current * 2", None) is None and experiments.evaluate(None, 1.0) is None


def test_round_robin_and_multiple(spark):
    diag = spark.createDataFrame([(c, "overfitting") for c in range(4)], "cycle_no int, primary_cause string")
    names = ["reduce_num_leaves", "increase_min_child_samples", "add_dropout"]
    got = experiments.proposals(diag, experiments.playbook(spark), experiments.model_config(spark)).orderBy("cycle_no").collect()
    assert [r["name"] for r in got] == [names[c % 3] for c in range(4)]
    assert got[0]["value"] == "15" and got[2]["value"] == "0.56"
    many = experiments.proposals(diag.where("cycle_no = 1"), experiments.playbook(spark), experiments.model_config(spark), n=9)
    assert {r["name"] for r in many.collect()} == set(names)


def test_cooldown_boundary(spark):
    now = datetime(2026, 1, 10)
    log = spark.createDataFrame(
        [("hyperparameter", "rejected", now - timedelta(days=3)), ("feature_add", "rejected", now - timedelta(days=6)), ("ensemble_method", "promoted", now)],
        "mutation_type string, promotion_decision string, created_at timestamp_ntz")
    cand = spark.createDataFrame([(t,) for t in ("hyperparameter", "feature_add", "ensemble_method", "prediction_target")], "mutation_type string")
    left = {r[0] for r in experiments.cooldown_filter(cand, log, F.lit(now).cast("timestamp_ntz")).collect()}
    assert left == {"hyperparameter", "ensemble_method", "prediction_target"}


def test_budget_matches_loop(spark):
    rng = np.random.default_rng(7)
    kinds = [*config.BUDGET_PER_CATEGORY, "new_data_signal"]
    rows = [(c, i, kinds[rng.integers(len(kinds))]) for c in range(6) for i in range(25)]
    got = {(r["c"], r["i"]) for r in experiments.budget_filter(spark.createDataFrame(rows, "c int, i int, mutation_type string"), "c", ["i"]).collect()}
    want = set()
    for c in range(6):
        seen, total = {}, 0
        for cc, i, kind in rows:
            if cc == c and total < 5 and seen.get(kind, 0) < config.BUDGET_PER_CATEGORY.get(kind, 99):
                seen[kind], total = seen.get(kind, 0) + 1, total + 1
                want.add((c, i))
    assert got == want


def vector_frame(spark, v, base):
    return spark.createDataFrame([(base + i, None if r is None else [float(x) for x in r]) for i, r in enumerate(v)], "id int, v array<float>")


@pytest.mark.parametrize("chunk", [16, 4096])
def test_similarity_blocks(spark, chunk):
    rng = np.random.default_rng(2)
    c, m = rng.normal(size=(70, 8)), rng.normal(size=(90, 8))
    m[3] = c[5] * 2.0
    frame = lambda v, base: vector_frame(spark, v, base)
    got = similarity.similarity(frame(c, 0), frame(m, 1000), "id", "v", 0.85, chunk, 12).toPandas().set_index("id").sort_index()
    sims = (c @ m.T / np.linalg.norm(c, axis=1)[:, None] / np.linalg.norm(m, axis=1)).max(axis=1)
    np.testing.assert_allclose(got["max_similarity"], sims, atol=1e-6)
    assert got["is_duplicate"].tolist() == (sims > 0.85).tolist()
    empty = similarity.similarity(frame(c, 0), frame(m, 0).limit(0), "id", "v", 0.85, chunk).toPandas()
    assert len(empty) == 70 and (empty["max_similarity"] == 0).all() and not empty["is_duplicate"].any()


def test_similarity_skips_groups_that_cannot_win(spark):
    """Vectors in tight bunches: most pairs of candidate and group are skipped, and the answer stays exact."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    around = lambda n: np.concatenate([c + rng.normal(0, 0.02, (n, 16)) for c in centres])
    c, m = around(6), around(15)
    odd = [None, [0.0] * 16, [float("nan")] * 16]
    got = similarity.similarity(vector_frame(spark, [*c, *odd], 0), vector_frame(spark, [*m, *odd], 1000), "id", "v", 0.9).toPandas()
    got = got.set_index("id").sort_index()
    sims = (c @ m.T / np.linalg.norm(c, axis=1)[:, None] / np.linalg.norm(m, axis=1)).max(axis=1)
    np.testing.assert_allclose(got["max_similarity"][:120], sims, atol=1e-6)
    assert got["max_similarity"][120:].tolist() == [0.0] * 3 and got["groups_visited"][120:].tolist() == [0] * 3
    assert got["groups_visited"][:120].mean() < 0.3 * 64


def test_memory_of_thirty_days(spark):
    now = datetime(2026, 3, 31)
    df = spark.createDataFrame([(n, now - timedelta(days=n)) for n in (-1, 0, 29, 30, 31)], "n int, created_at timestamp_ntz")
    assert {r["n"] for r in similarity.recent(df, F.lit(now).cast("timestamp_ntz")).collect()} == {0, 29, 30}


def ledger_loop(p, ret, volume, spread, vol, walk_forward):
    """The rules of the ledger, bar by bar."""
    cap, wins, losses, out = 100_000.0, [], [], []
    for i in range(len(p)):
        side = 1 if p[i] >= 0.5 else -1
        prob = min(max(p[i] if walk_forward or side == 1 else 1 - p[i], 0.01), 0.99)
        win, loss = (np.mean(wins) if wins else 0.01), (np.mean(losses) if losses else 0.01)
        share = min(max(0.5 * (prob * win / loss - (1 - prob)) / (win / loss), 0.0), 0.10)
        lots = max(0, min(int(share * 100.0), int(0.02 * volume[i])))
        cost = spread[i] / 2 + 0.1 * vol[i] * math.sqrt(lots / max(volume[i], 1)) if lots else 0.0
        gain = (side * ret[i] - cost / 1000.0) * share if lots else 0.0
        cap *= 1 + gain
        out.append((lots, gain, cap))
        (wins if side * ret[i] > 0 else losses if side * ret[i] < 0 else []).append(abs(ret[i]))
    return np.array(out)


@pytest.mark.parametrize("walk_forward", [False, True])
def test_ledger_matches_loop(spark, walk_forward):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for market in ("A", "B"):
        for run in (0, 1):
            n = 150
            p, ret = rng.uniform(0.2, 0.9, n), rng.normal(0, 0.02, n)
            ret[::17] = 0.0
            volume, spread, vol = rng.uniform(0, 2000, n), rng.uniform(0, 1, n), rng.uniform(0.01, 0.03, n)
            want[market, run] = ledger_loop(p, ret, volume, spread, vol, walk_forward)
            rows += [(market, run, datetime(2026, 1, 1) + timedelta(days=i), *map(float, (p[i], ret[i], volume[i], spread[i], vol[i]))) for i in range(n)]
    df = spark.createDataFrame(rows, "market string, run_id int, ts timestamp_ntz, p double, ret double, volume double, spread double, rolling_vol double")
    for cell in (None, F.date_trunc("week", "ts")):  # one window, and cells far smaller than a series
        got = ledger.pnl_ledger(df.repartition(5), ["market", "run_id"], ["ts"], cell, walk_forward).toPandas()
        for key, g in got.groupby(["market", "run_id"]):
            g = g.sort_values("ts")
            assert g["n_contracts"].tolist() == want[key][:, 0].tolist() and (g["traded"] == (g["n_contracts"] > 0)).all()
            np.testing.assert_allclose(g["capital_return"], want[key][:, 1], atol=1e-12)
            np.testing.assert_allclose(g["capital_after"], want[key][:, 2], rtol=1e-10)
            np.testing.assert_allclose(g["peak"], g["capital_after"].cummax(), rtol=1e-10)


def test_replay_metrics(spark):
    rows = [("A", 0, datetime(2026, 1, 1) + timedelta(days=i), 0.6, 0.02 * (-1) ** i, 5000.0, 0.5, 0.02) for i in range(30)]
    df = spark.createDataFrame(rows, "market string, run_id int, ts timestamp_ntz, p double, ret double, volume double, spread double, rolling_vol double")
    led = ledger.pnl_ledger(df, ["market", "run_id"], ["ts"])
    pdf = led.toPandas().sort_values("ts")
    got = ledger.replay_metrics(led, ["market", "run_id"]).first()
    r = pdf["capital_return"]
    assert got["sharpe_ratio"] == pytest.approx(r.mean() / r.std() * math.sqrt(252))
    assert got["total_return"] == pytest.approx(pdf["capital_after"].iloc[-1] / 100_000 - 1)
    assert got["hit_rate"] == pytest.approx((pdf[pdf.traded].raw_return > 0).mean()) and got["n_trades"] == pdf.traded.sum() > 0
    assert got["max_drawdown"] == pytest.approx((pdf.capital_after / pdf.capital_after.cummax() - 1).min())


def account_loop(p, ret, volume, spread, vol):
    """An account bar by bar: lots follow the capital, the means are those of realised gains."""
    cap, gains, out = 100_000.0, [], []
    for i in range(len(p)):
        side = 1 if p[i] >= 0.5 else -1
        prob = min(max(p[i] if side == 1 else 1 - p[i], 0.01), 0.99)
        won, lost = [g for g in gains if g > 0], [g for g in gains if g < 0]
        odds = (np.mean(won) if won else 0.01) / (-np.mean(lost) if lost else 0.01)
        share = min(max(0.5 * (prob * odds - (1 - prob)) / odds, 0.0), 0.10)
        lots = max(0, min(int(share * cap / 1000.0), int(0.02 * volume[i])))
        cost = spread[i] / 2 + 0.1 * vol[i] * math.sqrt(lots / max(volume[i], 1)) if lots else 0.0
        gains.append((side * ret[i] - cost / 1000.0) * share if lots else 0.0)
        cap *= 1 + gains[-1]
        out.append((lots, gains[-1], cap))
    return np.array(out)


SERIES = "market string, run_id int, ts timestamp_ntz, p double, ret double, volume double, spread double, rolling_vol double"


def test_account_matches_loop(spark):
    """Null markets are a series; the state outlives batches; lots move with the capital."""
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for market in ("A", None):
        for run in (0, 1):
            n = 150
            p, ret = rng.uniform(0.2, 0.9, n), rng.normal(0.02, 0.12, n)
            ret[::17] = 0.0
            volume, spread, vol = rng.uniform(0, 3000, n), rng.uniform(0, 1, n), rng.uniform(0.01, 0.03, n)
            want[market, run] = account_loop(p, ret, volume, spread, vol)
            rows += [(market, run, datetime(2026, 1, 1) + timedelta(days=i), *map(float, (p[i], ret[i], volume[i], spread[i], vol[i]))) for i in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = ledger.account_ledger(spark.createDataFrame(rows, SERIES).repartition(5), ["market", "run_id"], ["ts"]).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and got["allowed"].all()
    for (market, run), loop in want.items():
        g = got[(got.market.isna() if market is None else got.market == market) & (got.run_id == run)].sort_values("ts")
        assert g["n_contracts"].tolist() == loop[:, 0].tolist() and (g["traded"] == (g["n_contracts"] > 0)).all()
        np.testing.assert_allclose(g["capital_return"], loop[:, 1], atol=1e-12)
        np.testing.assert_allclose(g["capital_after"], loop[:, 2], rtol=1e-10)
        np.testing.assert_allclose(g["peak"], g["capital_after"].cummax(), rtol=1e-10)
    assert max(loop[:, 0].max() for loop in want.values()) > 10  # more than a tenth of the first capital


def test_account_without_all_values(spark):
    """An unknown volume caps nothing, an unknown cost or return moves no capital, an unknown probability backs no trade."""
    day = lambda i: datetime(2026, 1, 1) + timedelta(days=i)
    rows = [("A", 0, day(0), 0.9, 0.1, None, 0.5, 0.02), ("A", 0, day(1), 0.9, None, 5000.0, 0.5, 0.02), ("A", 0, day(2), None, 0.1, 5000.0, 0.5, 0.02),
            ("A", 0, day(3), 0.9, 0.1, 5000.0, math.nan, 0.02), ("A", 0, day(4), 0.9, 0.1, 5000.0, 0.5, 0.02)]
    got = ledger.account_ledger(spark.createDataFrame(rows, SERIES), ["market", "run_id"], ["ts"]).orderBy("ts").collect()
    assert [r.n_contracts for r in got] == [10, 10, 0, 10, 10]
    assert [r.capital_return is None for r in got] == [False, True, False, True, False]
    assert got[0].capital_after == got[1].capital_after == got[2].capital_after == got[3].capital_after < got[4].capital_after
    assert ledger.account_ledger(spark.createDataFrame([], SERIES), ["market", "run_id"], ["ts"]).count() == 0


def test_queries_keep_the_account(spark, sf):
    """J6 and J6b over the bars of the tables, against the loop."""
    import __spark_entry__ as entry
    from tidemark.plans.models import replay_input

    bars = replay_input(spark, sf).toPandas()
    got = entry.queries()["j6_pnl_ledger"](spark, sf).toPandas()
    found = entry.queries()["j6b_replay_metrics"](spark, sf).toPandas().set_index(["market", "run_id"])
    assert len(got) == len(bars) and len(found) == bars.groupby(["market", "run_id"]).ngroups
    for key, g in bars.groupby(["market", "run_id"]):
        g = g.sort_values("ts")
        loop = account_loop(*(g[c].to_numpy() for c in ("p", "ret", "volume", "spread", "rolling_vol")))
        own = got[(got.market == key[0]) & (got.run_id == key[1])].sort_values("ts")
        assert own["n_contracts"].tolist() == loop[:, 0].tolist()
        np.testing.assert_allclose(own["capital_after"], loop[:, 2], atol=6e-4)
        r, curve = found.loc[key], loop[:, 2]
        assert r.total_return == pytest.approx(curve[-1] / 100_000 - 1, abs=1e-7) and r.n_trades == (loop[:, 0] > 0).sum()
        assert r.max_drawdown == pytest.approx((curve / np.maximum.accumulate(curve) - 1).min(), abs=1e-7)
        if loop[:, 1].std():
            assert r.sharpe_ratio == pytest.approx(loop[:, 1].mean() / loop[:, 1].std(ddof=1) * math.sqrt(252), abs=2e-5)


def test_rolling_vol_and_folds(spark):
    rng = np.random.default_rng(3)
    prices = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60)))
    df = spark.createDataFrame([("A", datetime(2026, 1, 1) + timedelta(days=i), float(p)) for i, p in enumerate(prices)], "market string, ts timestamp_ntz, close double")
    got = returns.rolling_vol(df, F.date_trunc("week", "ts")).toPandas().sort_values("ts")["rolling_vol"].to_numpy()
    for i in range(60):
        start = max(0, i - 20)
        want = 0.02 if i - start < 2 else np.std(np.diff(np.log(prices[start : i + 1])), ddof=1)
        assert got[i] == pytest.approx(want, rel=1e-9)
    cut = returns.folds(df, F.date_trunc("week", "ts"), n_splits=5, embargo=5, min_train=20, test_size=10).toPandas()
    assert sorted(cut.fold.unique()) == [0, 1, 2]
    for k, g in cut.groupby("fold"):
        train, test = g[g.role == "train"].row_idx, g[g.role == "test"].row_idx
        assert (train.min(), train.max()) == (0, 19 + 10 * k) and (test.min(), test.max()) == (25 + 10 * k, 34 + 10 * k)
    sizes = returns.fold_sizes(spark, 400, min_train=100, test_size=50).collect()
    assert [(r["train_end"], r["test_start"], r["test_end"]) for r in sizes] == [(100 + 50 * k, 105 + 50 * k, 155 + 50 * k) for k in range(5)]


def test_classifier_learns_through_missing_values(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(400):
        x = float(rng.normal())
        hidden = rng.random() < 0.3
        rows.append((i, None if hidden else x, float(rng.normal()), None, int(x > 0) if not hidden else 1))
    df = spark.createDataFrame(rows, "id int, good double, noise double, empty double, target int")
    names = ["good", "noise", "empty"]
    fit = model.train(df, names, maxIter=5, maxDepth=3)
    scored = model.score(fit, df, names).toPandas()
    assert scored.p.between(0, 1).all() and (scored.predicted == scored.target).mean() > 0.9
    ranked = model.importance(spark, fit).toPandas()
    assert ranked.feature.iloc[0] == "good" and set(ranked.feature) == set(names)


def test_training_set_needs_enough_prices(spark):
    rows = [("long", datetime(2026, 1, 1) + timedelta(days=i), float(i)) for i in range(60)] + [("short", datetime(2026, 1, 1) + timedelta(days=i), 1.0) for i in range(40)]
    prices = spark.createDataFrame(rows, "market string, ts timestamp_ntz, close double")
    wide = prices.select("market", "ts", F.col("close").alias("f"))
    got = model.training_set(prices, wide).toPandas()
    assert set(got.market) == {"long"} and len(got) == 55 and (got.target == 1).all()


def test_calendar_folds_do_not_look_ahead(spark):
    """Folds are cut at times all markets share: a market that starts late has no training rows after any test row."""
    day = lambda i: datetime(2026, 1, 1) + timedelta(days=i)
    rows = [("old", day(i), day(i + 5), i % 2) for i in range(100)] + [("new", day(i), day(i + 9), 1) for i in range(50, 100)]
    df = spark.createDataFrame(rows, "market string, ts timestamp_ntz, label_ts timestamp_ntz, target int")
    got = model.calendar_folds(df, n_splits=5, embargo=5, min_train=40, test_size=20).toPandas()
    assert set(got.fold) == {0, 1}
    for k, part in got.groupby("fold"):
        train, test = part[part.role == "train"], part[part.role == "test"]
        end = 40 + 20 * k
        assert test.ts.min() == day(end + 5) and test.ts.max() == day(end + 24)
        assert train.ts.max() < day(end) and train.label_ts.max() < test.ts.min()
        want = {(m, t) for m, t, known, _ in rows if t < day(end) and known < day(end + 5)}
        assert set(zip(train.market, train.ts.dt.to_pydatetime())) == want
        assert len(test) == sum(day(end + 5) <= r[1] <= day(end + 24) for r in rows)
    assert model.calendar_folds(df, min_train=252).count() == 0


def test_experiment_summaries(spark):
    rows = [(i, "a" if i % 2 else "", ["promoted", "rejected", "pending"][i % 3], datetime(2026, 1, 1 + i), ["x", "y"] if i % 2 else ["x"], {"s": str(i)}) for i in range(8)]
    log = spark.createDataFrame(rows, "id int, mutation_type string, promotion_decision string, created_at timestamp_ntz, tags array<string>, results map<string,string>")
    total = experiments.summary(log).first()
    assert (total["total"], total["promoted"], total["rejected"], total["rate"]) == (8, 3, 3, 37.5)
    assert {r["mutation_type"]: r["n"] for r in experiments.mutation_breakdown(log).collect()} == {"a": 4, "unknown": 4}
    assert experiments.latest_promoted(log).first()["id"] == 6
    assert experiments.latest_promoted(log.where("promotion_decision = 'pending'")).count() == 0
    found = experiments.experiments_query(log, ["x", "y"], "2026-01-02", "2026-01-06", outcome="rejected").collect()
    assert [r["id"] for r in found] == [1]
    assert pd.DataFrame(experiments.experiments_query(log, limit=3).collect(), columns=log.columns)["id"].tolist() == [7, 6, 5]


def test_empty_side_gives_no_drift(spark):
    df = spark.createDataFrame([("a", 1.0, False), ("a", 2.0, False), ("b", 1.0, True)], "feature string, x double, is_current boolean")
    for r in drift.feature_drift(df).collect():
        assert (r["psi"], r["ks_stat"], r["ks_drift"], r["drifted"]) == (0.0, 0.0, False, False)


def test_visits_leave_in_small_batches(spark, monkeypatch):
    """A candidate that must see every group is copied a few rows at a time, with the same answer."""
    monkeypatch.setattr(similarity, "COPIES", 7)
    monkeypatch.setattr(similarity, "PART", 5)
    rng = np.random.default_rng(8)
    c, m = rng.normal(size=(40, 12)), rng.normal(size=(60, 12))
    got = similarity.similarity(vector_frame(spark, c, 0), vector_frame(spark, [*m, None], 1000), "id", "v", 0.9, 16).toPandas().set_index("id").sort_index()
    sims = (c @ m.T / np.linalg.norm(c, axis=1)[:, None] / np.linalg.norm(m, axis=1)).max(axis=1)
    np.testing.assert_allclose(got["max_similarity"], sims, atol=1e-6)


def test_similar_dedup_holds_every_vector(spark, sf):
    """The memory of the query leaves no vector of an odd label out."""
    import __spark_entry__ as entry

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    unit = np.stack(rows.embedding.to_numpy()).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    even = (rows.label % 2 == 0).to_numpy()
    got = entry.queries()["c10_similar_dedup"](spark, sf).toPandas().set_index("vec_id").max_similarity
    want = (unit[even] @ unit[~even].T).max(axis=1)
    np.testing.assert_allclose(got[rows.vec_id[even]], want, atol=1e-5)


def test_walk_forward_ledger_has_several_folds(spark, sf):
    """Three folds of sixty bars of every run."""
    import __spark_entry__ as entry

    got = entry.queries()["j6c_walk_forward_ledger"](spark, sf).groupBy("market", "run_id", "fold").count().toPandas()
    assert sorted(set(got.fold)) == [0, 1, 2] and set(got.run_id) == {0, 1, 2, 3} and set(got["count"]) == {60}
