"""Prices, volatilities, slice fits, densities, flows and signals against closed forms."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.black76 import call_iv, put_iv, with_call_price, with_greeks
from tidemark.functions.normal import norm_cdf, norm_cdf_array
from tidemark.operators import chain, density, flows, signals
from tidemark.operators.options_job import option_features


def cdf(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def black(f, k, r, t, s):
    d1 = (math.log(f / k) + 0.5 * s * s * t) / (s * math.sqrt(t))
    return math.exp(-r * t) * (f * cdf(d1) - k * cdf(d1 - s * math.sqrt(t)))


def test_normal_cdf(spark):
    xs = np.linspace(-9, 9, 721)
    want = np.array([cdf(x) for x in xs])
    assert np.abs(norm_cdf_array(xs) - want).max() < 5e-16
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", norm_cdf(F.col("x")).alias("p"))
    got = np.array([r["p"] for r in sorted(df.collect(), key=lambda r: r["x"])])
    assert np.abs(got - want).max() < 5e-16


def test_greeks_closed_form(spark):
    f = k = 100.0
    r, t, s = 0.05, 0.25, 0.30
    d1 = 0.5 * s * math.sqrt(t)
    d2, pdf, disc = d1 - s * math.sqrt(t), math.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi), math.exp(-r * t)
    df = spark.createDataFrame([(True, s), (False, s), (True, 0.0)], "is_call boolean, s double")
    rows = with_greeks(df, F.lit(f), F.lit(k), F.lit(r), F.lit(t), F.col("s"), F.col("is_call")).collect()
    call, put, dead = rows
    assert call["gamma"] == pytest.approx(disc * pdf / (f * s * math.sqrt(t)), abs=1e-12)
    assert call["vega"] == pytest.approx(f * disc * pdf * math.sqrt(t), abs=1e-10)
    assert call["vanna"] == pytest.approx(-disc * pdf * d2 / s, abs=1e-12)
    assert call["charm"] == pytest.approx(-disc * pdf * (2 * r * t - d2 * s * math.sqrt(t)) / (2 * t * s * math.sqrt(t)), abs=1e-10)
    assert call["delta"] - put["delta"] == pytest.approx(disc, abs=1e-12)
    assert all(dead[g] == 0.0 for g in ("gamma", "vanna", "charm", "delta", "vega"))


def test_implied_vol_inverts_and_rejects(spark):
    rows = [(black(100, k, 0.05, 0.25, s), 100.0, float(k), 0.05, 0.25, s) for k in (70, 90, 100, 110, 140) for s in (0.15, 0.6, 2.0)]
    df = spark.createDataFrame(rows, "price double, f double, k double, r double, t double, s double")
    args = [F.col(c) for c in ("price", "f", "k", "r", "t")]
    for row in df.select("s", "price", call_iv(*args).alias("iv")).collect():
        if row["price"] > 1e-9:
            assert row["iv"] == pytest.approx(row["s"], abs=1e-7)
    bad = spark.createDataFrame(
        [(0.0, 100.0, 90.0, 0.05, 0.25), (5.0, 100.0, 90.0, 0.05, 0.25), (99.9, 100.0, 100.0, 0.05, 0.25)], "price double, f double, k double, r double, t double"
    )
    assert [r["iv"] for r in bad.select(call_iv(*args).alias("iv")).collect()] == [None] * 3
    puts = df.withColumn("price", F.col("price") - F.exp(-F.col("r") * F.col("t")) * (F.col("f") - F.col("k")))
    for row in puts.where("k BETWEEN 90 AND 110").select("s", put_iv(*args).alias("iv")).collect():
        assert row["iv"] == pytest.approx(row["s"], abs=1e-7)


def quotes(spark, vol, strikes=range(80, 121, 2), market="HE", oi=100.0, spread=0.05, days=91):
    rows = []
    t = days / 365.0
    for i, k in enumerate(strikes):
        c = black(100, k, 0.05, t, vol(k))
        p = c - math.exp(-0.05 * t) * (100 - k)
        for is_call, price in ((True, c), (False, p)):
            rows.append((market, date(2026, 3, 1), date.fromordinal(date(2026, 3, 1).toordinal() + days), float(k), is_call,
                         price * (1 - spread / 2), price * (1 + spread / 2), oi, len(rows)))
    return spark.createDataFrame(rows, "market string, as_of date, expiry date, strike double, is_call boolean, bid double, ask double, oi double, seq int")


def fitted(df, **settings):
    pairs = chain.pair_sides(chain.best_quotes(df, F.col("seq")))
    ivs = density.with_ivs(pairs, F.lit(100.0), F.lit(0.05), F.datediff("expiry", "as_of") / F.lit(365.0))
    return density.fit_svi(density.slices(ivs, **settings))


def test_log_normal_density_is_recovered(spark):
    fit = fitted(quotes(spark, lambda k: 0.25, range(60, 161, 2))).cache()
    grid = density.density(fit).orderBy("grid_i").toPandas()
    t, s = 91 / 365.0, 0.25
    mu, sd = math.log(100) - s * s * t / 2, s * math.sqrt(t)
    want = np.exp(-((np.log(grid.k) - mu) ** 2) / (2 * sd * sd)) / (grid.k * sd * math.sqrt(2 * math.pi))
    inner = grid.grid_i.between(5, 194)
    assert np.abs(grid.density - want)[inner].max() < 5e-4
    assert (grid.weight * grid.density).sum() == pytest.approx(1.0, abs=1e-9)
    m = density.implied_moments(fit).first()
    assert m["quality"] == "full" and m["implied_mean"] == pytest.approx(100, rel=0.005)
    assert m["implied_variance"] == pytest.approx(100**2 * (math.exp(sd * sd) - 1), rel=0.02)
    assert m["atm_iv"] == pytest.approx(0.25, abs=1e-6) and m["implied_kurtosis"] == pytest.approx(3.3, abs=0.3)


def smile(k):
    x = math.log(k / 100)
    return 0.25 - 0.15 * x + 0.4 * x * x


@pytest.mark.parametrize("vol,limit", [(lambda k: 0.3, 1e-6), (smile, 1e-4), (lambda k: smile(k) + 0.005 * math.sin(7.0 * k), 0.006),
                                       (lambda k: 0.4 - 0.6 * abs(math.log(k / 100)), 0.05)])
def test_svi_error(spark, vol, limit):
    row = fitted(quotes(spark, vol)).first()
    assert row["svi"]["rmse"] < limit
    assert row["svi"]["b"] >= 0 and abs(row["svi"]["rho"]) <= 0.99 + 1e-9


def test_butterfly_flags_concave_slices(spark):
    base = fitted(quotes(spark, smile))
    assert not density.butterfly(base).first()["has_butterfly_arbitrage"]
    bent = base.withColumn("svi", F.col("svi").withField("b", F.lit(-0.1)))
    assert density.butterfly(bent).first()["has_butterfly_arbitrage"]


def test_thin_chains_degrade(spark):
    for df in (quotes(spark, smile, oi=5.0), quotes(spark, smile, range(90, 101, 2)), quotes(spark, smile, spread=0.4)):
        row = density.implied_moments(fitted(df)).first()
        assert row["quality"] == "degraded" and row["implied_mean"] is None and row["atm_iv"] == pytest.approx(0.25, abs=1e-5)
        assert row["warnings"] == ["degraded"]
    few = chain.pair_sides(chain.best_quotes(quotes(spark, smile, (98, 100)), F.col("seq")))
    assert few.count() == 0


def test_flow_by_hand(spark):
    rows = [("HE", 1, float(k), 0.25, 0.1, 0.3, 0.3, 100.0, 50.0) for k in (95, 105)]
    df = spark.createDataFrame(rows, "market string, g int, strike double, t double, spread double, call_iv double, put_iv double, call_oi double, put_oi double")
    thin = flows.greeks_flow(df, F.lit(100.0), F.lit(0.05), F.lit(400.0), ["market"]).first()
    assert thin["quality"] == "degraded" and thin["gex"] == 0.0 and thin["liquid_strike_count"] == 2
    got = flows.greeks_flow(df, F.lit(100.0), F.lit(0.05), F.lit(400.0), ["market"], min_liquid=1).first()
    want = 0.0
    for k in (95, 105):
        d1 = (math.log(100 / k) + 0.5 * 0.09 * 0.25) / 0.15
        gamma = math.exp(-0.0125) * math.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) / (100 * 0.15)
        want += gamma * (100 - 50) * 400 * 100**2 / 100
    assert got["gex"] == pytest.approx(want, rel=1e-12)
    skipped = df.withColumn("t", F.lit(2.5))
    assert flows.greeks_flow(skipped, F.lit(100.0), F.lit(0.05), F.lit(400.0), ["market"], min_liquid=1).first()["gex"] == 0.0


def test_option_job_end_to_end(spark):
    far = quotes(spark, smile, days=182).withColumn("bid", F.col("bid") * 2).withColumn("ask", F.col("ask") * 2)
    stale = quotes(spark, smile, spread=0.9).withColumn("seq", F.col("seq") + 1000)
    lost = quotes(spark, smile, market="XX")
    df = quotes(spark, smile).unionByName(far).unionByName(stale).unionByName(lost)
    spots = spark.createDataFrame([("HE", 100.0), ("XX", 0.0)], "market string, spot double")
    got = {r["feature_name"]: r for r in option_features(df, spots, F.col("seq")).collect()}
    assert len(got) == 8 and {r["market"] for r in got.values()} == {"HE"}
    assert got["implied_mean"]["value"] == pytest.approx(100, rel=0.01) and got["atm_iv"]["value"] == pytest.approx(0.25, abs=1e-5)
    assert {r["quality"] for r in got.values()} == {"full"}


def signal(spark, mean, skew, kurt, score, conf=0.8, quality="full", spot=100.0):
    df = spark.createDataFrame([(mean, spot, skew, kurt, score, conf, quality)], "m double, s double, k double, u double, c double, f double, q string")
    parts = signals.classify(*[F.col(c) for c in ("m", "s", "k", "u", "c", "f", "q")])
    return df.select(*[c.alias(n) for n, c in parts.items()]).first()


@pytest.mark.parametrize(
    "args,kind,direction,bias",
    [
        ((105.0, 0.0, 3.0, -0.5), "options_bullish_sentiment_bearish", 1, "long"),
        ((95.0, 0.0, 3.0, 0.5), "options_bearish_sentiment_bullish", -1, "short"),
        ((100.5, 0.0, 5.0, 0.9), "volatility_play", 0, "vol_play"),
        ((100.5, 0.0, 3.0, 0.9), "sentiment_overreaction", -1, "fade_sentiment"),
        ((105.0, 0.8, 3.0, 0.1), "early_signal", 1, "early_entry"),
        ((95.0, None, None, -0.5), "trend_follow", -1, "trend_follow"),
        ((100.0, None, None, 0.0), "neutral", 0, "neutral"),
        ((None, 0.0, 3.0, -0.5), "neutral", 0, "neutral"),
    ],
)
def test_divergence_rules(spark, args, kind, direction, bias):
    got = signal(spark, *args)
    assert (got["divergence_type"], got["direction"], got["suggested_bias"]) == (kind, direction, bias)


def test_divergence_confidence(spark):
    full, half = signal(spark, 105.0, 0.0, 3.0, -0.5), signal(spark, 105.0, 0.0, 3.0, -0.5, quality="degraded")
    assert full["confidence"] == pytest.approx(0.8 * 0.3) and half["confidence"] == pytest.approx(full["confidence"] / 2)
    assert signal(spark, None, 0.0, 3.0, -0.5)["magnitude"] == 0.0


def test_sentiment_extremes(spark):
    hist = [float(v) for v in np.linspace(-5000, 5000, 52)]
    oi = [float(v) for v in np.linspace(50000, 150000, 52)]
    df = spark.createDataFrame([(5000.0, 150000.0, hist, oi), (-5000.0, 100000.0, hist, oi), (1.0, 1.0, hist[:3], oi[:3])],
                               "net double, oi double, h array<double>, o array<double>")
    parts = signals.sentiment_columns(F.col("net"), F.col("oi"), F.col("h"), F.col("o"))
    top, bottom, short = df.select(*[c.alias(n) for n, c in parts.items()]).collect()
    assert top["sentiment_score"] == 1.0 and bottom["sentiment_score"] == pytest.approx(2 / 52 - 1)
    assert (short["sentiment_score"], short["sentiment_confidence"]) == (0.0, 0.0)
    assert top["sentiment_confidence"] == pytest.approx(0.6 + 0.4 * 5 * 5000 / 150000)


def test_signal_features_parity(spark):
    df = spark.createDataFrame([(1.0, 2.0, 101.0, 0.0, 3.0, 0.9, 0.9)], "cot_managed_money_net double, cot_total_oi double, implied_mean double, implied_skew double, implied_kurtosis double, sentiment_score double, sentiment_confidence double")
    row = signals.signal_features(df, parity=True).first()
    assert (row["sentiment_score"], row["divergence_magnitude"], row["divergence_direction"]) == (0.0, 0.0, 0.0)
    real = signals.signal_features(df, F.lit(100.0)).first()
    assert real["divergence_magnitude"] == pytest.approx(0.01 - 0.09) and real["sentiment_score"] == 0.9


def test_call_price_matches(spark):
    df = spark.createDataFrame([(90.0, 0.2), (110.0, 0.6)], "k double, s double")
    for r in with_call_price(df, F.lit(100.0), F.col("k"), F.lit(0.05), F.lit(0.5), F.col("s"), "p").collect():
        assert r["p"] == pytest.approx(black(100, r["k"], 0.05, 0.5, r["s"]), abs=1e-12)


def test_second_derivative_of_slices_of_any_length(spark):
    """Each slice has its own number of points; a slice of one point has no derivative."""
    rng = np.random.default_rng(5)
    curves = {f"S{n}": rng.normal(size=n) for n in (1, 2, 3, 13, 21)}
    rows = [(s, i, float(v), 2.0, len(c)) for s, c in curves.items() for i, v in enumerate(c)]
    df = spark.createDataFrame(rows, "s string, grid_i int, v double, h double, points int")
    found = density.second_derivative(df, "v", "d2", ["s"], F.col("points")).orderBy("s", "grid_i").collect()
    for s, c in curves.items():
        got = [r.d2 for r in found if r.s == s]
        if len(c) == 1:
            assert got == [None]
        else:
            assert np.allclose(got, np.gradient(np.gradient(c, 2.0), 2.0))
