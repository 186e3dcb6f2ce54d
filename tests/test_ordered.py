"""Block-wise ordered operators against plain pandas, with cells and blocks far smaller than a key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import machines
from tidemark.operators.ordered import cumulative_counts, exact_quantiles, framed, index_rows, running


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = []
    # one hot key, one small key, one null key
    for key, n in (("hot", 400), ("cold", 7), (None, 30)):
        for i in range(n):
            value = float(rng.normal())
            rows.append((key, i, None if i % 5 == 0 else value, value))
    rng.shuffle(rows)
    pdf = pd.DataFrame(rows, columns=["k", "i", "gap", "x"])
    df = spark.createDataFrame(
        [(None if r[0] is None else str(r[0]), int(r[1]), None if r[2] is None else float(r[2]), float(r[3])) for r in rows],
        "k string, i int, gap double, x double",
    )
    return pdf.astype({"i": int, "x": float}), df


CELL = F.floor


def expected(pdf, fn):
    parts = [fn(g.sort_values("i")) for _, g in pdf.groupby("k", dropna=False)]
    return pd.concat(parts)


def by_key(pdf):
    return pdf.assign(k=pdf["k"].fillna("~")).sort_values(["k", "i"]).reset_index(drop=True)


def test_running_kinds(series):
    pdf, df = series
    got = running(
        df, ["k"], ["i"], F.floor(F.col("i") / 13),
        {"s": ("sum", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x")), "last": ("last", F.col("gap"))},
    ).toPandas()
    want = expected(pdf, lambda g: g.assign(s=g.x.cumsum(), hi=g.x.cummax(), lo=g.x.cummin(), last=g.gap.astype(float).ffill()))
    a, b = by_key(got), by_key(want)
    for c in ("s", "hi", "lo", "last"):
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=1e-12)


def test_running_without_keys(series):
    pdf, df = series
    hot = df.where("k = 'hot'")
    got = running(hot, [], ["i"], F.floor(F.col("i") / 13), {"s": ("sum", F.col("x"))}).toPandas().sort_values("i")
    want = pdf[pdf.k == "hot"].sort_values("i").x.cumsum()
    np.testing.assert_allclose(got["s"], want, atol=1e-12)


def test_index_rows(series):
    pdf, df = series
    got = by_key(index_rows(df, ["k"], ["i"], F.floor(F.col("i") / 10)).toPandas())
    assert (got["row_idx"] == got["i"]).all()


@pytest.mark.parametrize("block", [6, 17, 1000])
def test_framed_frames_cross_blocks(series, block):
    pdf, df = series
    got = framed(
        df, ["k"], ["i"], F.floor(F.col("i") / 11),
        {
            "prev": lambda f: F.first("x").over(f(-1, -1)),
            "ahead": lambda f: F.first("x").over(f(5, 5)),
            "mean": lambda f: F.avg("x").over(f(-4, 0)),
        },
        before=5, after=5, block_rows=block,
    ).toPandas()
    want = expected(
        pdf, lambda g: g.assign(prev=g.x.shift(1), ahead=g.x.shift(-5), mean=g.x.rolling(5, min_periods=1).mean())
    )
    a, b = by_key(got), by_key(want)
    assert len(a) == len(b)
    for c in ("prev", "ahead", "mean"):
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=1e-12)


@pytest.mark.parametrize("rows", [3, 50, 4096])
def test_exact_quantiles_with_outliers_and_ties(spark, rows):
    rng = np.random.default_rng(5)
    data = {
        "normal": rng.normal(size=501),
        "outlier": np.append(rng.uniform(0, 1, 300), [1e15, -1e9]),
        "ties": np.repeat([1.0, 2.0, 2.0, 3.0], 25),
        "single": np.array([4.5]),
        "zeros": np.zeros(9),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double").repartition(5)
    got = exact_quantiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p95": 0.95}, rows).toPandas().set_index("k")
    for k, vs in data.items():
        for name, p in (("p10", 10), ("p50", 50), ("p95", 95)):
            assert got.loc[k, name] == pytest.approx(np.percentile(vs, p), rel=1e-12, abs=1e-12)
    alone = exact_quantiles(df.where("k = 'normal'"), [], "v", {"m": 0.5}, rows).first()["m"]
    assert alone == pytest.approx(np.median(data["normal"]))


def test_cumulative_counts(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(-20, 20, 400).astype(float)
    df = spark.createDataFrame([("a", float(v), bool(v > 3)) for v in values], "k string, v double, f boolean")
    got = cumulative_counts(df, ["k"], "v", {"n": F.lit(1), "f": F.col("f").cast("int")}, 8).toPandas().sort_values("v")
    for row in got.itertuples():
        assert row.cum_n == (values <= row.v).sum()
        assert row.cum_f == ((values <= row.v) & (values > 3)).sum()


def rollback_loop(flags, sustained=3, recovery=5, cooldown=10):
    armed, bad, good, wait, fired = True, 0, 0, 0, []
    for degraded in flags:
        fire = False
        if wait:
            wait -= 1
        else:
            bad, good = (bad + 1, 0) if degraded else (0, good + 1)
            if armed and bad >= sustained:
                armed, wait, bad, good, fire = False, cooldown, 0, 0, True
            elif not armed and good >= recovery:
                armed, good = True, 0
        fired.append(fire)
    return fired


@pytest.mark.parametrize("block", [7, 1000])
def test_rollback_matches_loop(spark, block, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for model, rate in (("a", 0.6), ("b", 0.3), ("c", 0.95)):
        rows += [(model, i, 0.5 if rng.random() < rate else 1.0, 1.0) for i in range(300)]
    rows += [("zero", i, 0.0, 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "model string, i int, current_fitness double, champion_fitness double")
    original = machines.run_machine
    monkeypatch.setattr(machines, "run_machine", lambda *a, **k: original(*a, **k, block_rows=block))
    got = machines.rollback(df, ["model"], ["i"], F.floor(F.col("i") / 50)).toPandas()
    for model, g in got.groupby("model"):
        g = g.sort_values("i")
        want = rollback_loop((g.champion_fitness > 0) & ((g.champion_fitness - g.current_fitness) > 0.15 * g.champion_fitness))
        assert g.fired.tolist() == want


def test_rollback_fires_on_third_not_second(spark):
    fit = [0.8, 0.8, 1.0, 0.8, 0.8, 0.8, 0.8]
    df = spark.createDataFrame([("m", i, v, 1.0) for i, v in enumerate(fit)], "model string, i int, current_fitness double, champion_fitness double")
    got = machines.rollback(df, ["model"], ["i"], F.lit(0)).orderBy("i").toPandas()
    assert got.fired.tolist() == [False] * 5 + [True, False]


def test_breakers_match_loop(spark):
    rng = np.random.default_rng(9)
    rows = [("m", i, *[float(x) for x in rng.normal(0, 0.03, 4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, a double, b double, c double, d double")
    names = ["max_daily_loss", "max_drawdown", "max_position_size", "max_single_trade_loss"]
    values = dict(zip(names, [F.col("a"), F.col("b"), F.col("c") + 0.06, F.col("d")]))
    for cooldown in (1, 3):
        got = machines.breakers(df, ["k"], ["i"], values, F.floor(F.col("i") / 20), cooldown=cooldown).orderBy("i").toPandas()
        limits = {"max_daily_loss": (-0.02, False), "max_drawdown": (-0.05, False), "max_position_size": (0.10, True), "max_single_trade_loss": (-0.01, False)}
        raw = {n: got[c] + (0.06 if n == "max_position_size" else 0) for n, c in zip(names, "abcd")}
        left = dict.fromkeys(names, 0)
        for i in range(len(got)):
            ok = True
            for n, (bound, upper) in limits.items():
                if left[n]:
                    left[n] -= 1
                    hit = True
                else:
                    hit = raw[n][i] > bound if upper else raw[n][i] < bound
                    left[n] = cooldown if hit else 0
                assert got[f"{n}_triggered"][i] == hit
                ok &= not hit
            assert got["allowed"][i] == ok


def test_running_sums_and_extremes(series):
    from tidemark.operators.ordered import running_sums

    pdf, df = series
    got = by_key(
        running_sums(df, ["k"], ["i"], F.floor(F.col("i") / 9), {"a": F.col("x"), "b": -F.col("x")}, {"a": "max", "b": "min"}).toPandas()
    )
    want = by_key(
        expected(pdf, lambda g: g.assign(a=g.x.cumsum(), a_peak=g.x.cumsum().cummax(), b=(-g.x).cumsum(), b_peak=(-g.x).cumsum().cummin()))
    )
    for c in ("a", "a_peak", "b", "b_peak"):
        np.testing.assert_allclose(got[c], want[c], atol=1e-12)


def test_counted_cells(spark):
    """No cell above its size, whatever the distribution; cells never fall along the order."""
    from datetime import datetime, timedelta

    from tidemark.operators.cells import counted_cells

    rng = np.random.default_rng(2)
    start = datetime(2024, 1, 1)
    crowded = np.where(rng.random(3000) < 0.99, rng.integers(0, 3_600_000_000, 3000), rng.integers(0, 10**15, 3000))
    cases = [
        # 99 % of a key in one hour, a small key, a null key
        ([("hot", start + timedelta(microseconds=int(x)), i) for i, x in enumerate(crowded)]
         + [("cold", start, i) for i in range(9)] + [(None, start, i) for i in range(300)],
         "k string, ts timestamp_ntz, id long", ["k"], ["ts", "id"], 100),
        # all rows at one moment: the tie-break is cut, evenly spread or not
        ([("a", start, i**3) for i in range(900)], "k string, ts timestamp_ntz, id long", ["k"], ["ts", "id"], 70),
        # values near 1e6 and an outlier; values over hundreds of orders of magnitude, of both signs
        ([(float(x),) for x in [*rng.normal(1e6, 1, 900), 1e12, -1e300, float("inf")]], "v double", [], ["v"], 40),
        ([(float(s) * 10.0 ** float(e),) for s, e in zip(rng.choice([-1, 1], 900), rng.uniform(-300, 300, 900))], "v double", [], ["v"], 60),
    ]
    for rows, schema, keys, order, most in cases:
        df = spark.createDataFrame(rows, schema).repartition(5)
        cells = counted_cells(df, keys, order, most)
        got = cells.place(df).toPandas()
        assert not cells.single and len(got) == len(rows)
        parts = got.groupby(keys, dropna=False) if keys else [(None, got)]
        for _, part in parts:
            assert (np.diff(part.sort_values(order)["_cell"]) >= 0).all()
            sizes = part["_cell"].value_counts()
            assert sizes.max() <= most
            assert len(sizes) <= 4 * len(part) / most + 1
    small = counted_cells(df, [], ["v"], 10_000)
    assert small.single and small.place(df).where("_cell <> 0").isEmpty()
    assert counted_cells(df.limit(0), [], ["v"]).single
    # rows that agree in every order column cannot be told apart and stay together; nulls lie in the first cell
    ties = spark.createDataFrame([("a", 1.0)] * 50 + [("a", 2.0)] * 3 + [("a", None)] * 4, "k string, v double")
    got = counted_cells(ties, ["k"], ["v"], 10).place(ties).toPandas()
    assert got[got.v.isna()]["_cell"].max() <= got[got.v == 1.0]["_cell"].min() and got[got.v == 1.0]["_cell"].nunique() == 1


def test_operators_in_counted_cells(series, monkeypatch):
    """The same results from one window and from cells far smaller than a key."""
    from tidemark.operators import cells, ordered

    pdf, df = series
    want = expected(pdf, lambda g: g.assign(s=g.x.cumsum(), prev=g.x.shift(1), last=g.gap.astype(float).ffill()))
    for size in (25, 10_000):
        monkeypatch.setattr(ordered, "counted_cells", lambda d, k, o, n=size: cells.counted_cells(d, k, o, size))
        ran = running(df, ["k"], ["i"], None, {"s": ("sum", F.col("x")), "last": ("last", F.col("gap"))})
        out = framed(ran, ["k"], ["i"], None, {"prev": lambda f: F.first("x").over(f(-1, -1))}, before=1, block_rows=30, index="n")
        a, b = by_key(out.toPandas()), by_key(want)
        for c in ("s", "last", "prev"):
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=1e-12)
        assert (a["n"] == a["i"]).all()


def test_composed_maps_equal_a_loop():
    rng = np.random.default_rng(11)
    table = rng.integers(0, 7, (3, 7)).astype(np.int32)
    for n in (1, 2, 3, 8, 13, 100):
        symbols = rng.integers(0, 3, n)
        levels = machines.composed(table[symbols])
        for start in range(7):
            state, want = start, []
            for s in symbols:
                want.append(state)
                state = int(table[s, state])
            assert machines.states_before(levels, start)[:n].tolist() == want
            assert levels[-1][0][start] == state


@pytest.mark.parametrize("keys", [["k"], []])
def test_large_keys_are_not_cut_for_quantiles(spark, keys, monkeypatch):
    """Bounds from a sketch hold the ranks; cells are counted only where they do not."""
    from tidemark.operators import ordered

    values = np.random.default_rng(11).normal(size=4000)
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    want = pytest.approx(np.percentile(values, [50, 95]), rel=1e-12)
    with monkeypatch.context() as m:
        m.setattr(ordered, "counted_cells", None)
        assert list(exact_quantiles(df, keys, "v", {"m": 0.5, "h": 0.95}, 100).select("m", "h").first()) == want
    bounded = ordered._bounded_ranks
    monkeypatch.setattr(ordered, "_bounded_ranks", lambda *a: bounded(*a).withColumn("_lo_m", F.lit(None).cast("double")))
    assert list(exact_quantiles(df, keys, "v", {"m": 0.5, "h": 0.95}, 100).select("m", "h").first()) == want


def test_blocks_of_a_machine_are_small():
    """What a task holds of the four breakers' product machine stays below 4 MB."""
    import inspect

    rows = inspect.signature(machines.run_machine).parameters["block_rows"].default
    levels = machines.composed(np.zeros((rows, 16), "uint8"))
    assert sum(level.nbytes for level in levels) < 4 << 20 and levels[-1].dtype == np.uint8
