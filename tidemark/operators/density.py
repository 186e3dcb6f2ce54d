"""Implied volatility slices -> SVI fit -> implied density -> moments.

Everything is keyed by slice = (market, as_of, expiry).  Quotes are grouped by
slice once.  Grids are exploded from slices already clustered by key, so the
derivative windows and the moments need no exchange of grid rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config
from tidemark.functions.black76 import call_iv, put_iv, with_call_price
from tidemark.operators.chain import SLICE, liquid
from tidemark.session import durable, task_count

# --- fixed values: calibration grid and bounds
GRID_M = np.linspace(-1.0, 1.0, 41)
GRID_SIGMA = np.geomspace(0.01, 5.0, 40)
REFINE_STEPS = 10
A_BOUND, B_MAX, RHO_MAX = 1.0, 5.0, 0.99
SIGMA_BOUNDS = (0.01, 5.0)
FLAT = 1e-12


def with_ivs(pairs: DataFrame, spot: Column, rate: Column, t: Column) -> DataFrame:
    """H3/H4 on both sides of every strike."""
    # F.col names reach the UDF as attributes, see call_iv
    staged = pairs.withColumn("spot", spot).withColumn("rate", rate).withColumn("t", t)
    args = (F.col("spot"), F.col("strike"), F.col("rate"), F.col("t"))
    return staged.withColumn("call_iv", call_iv(F.col("call_mid"), *args)).withColumn(
        "put_iv", put_iv(F.col("put_mid"), *args)
    )


def slices(
    ivs: DataFrame,
    min_liquid: int = config.MIN_LIQUID_STRIKES,
    max_spread: float = config.MAX_SPREAD_PCT,
    min_oi: float = config.MIN_OI,
) -> DataFrame:
    """H7, first half: liquidity, ATM volatility and quality per slice, with its fit points.

    The collected arrays hold one entry per distinct strike of a slice.
    """
    ok = liquid(F.col("combined_oi"), F.col("spread"), min_oi, max_spread)
    valid = ok & (F.col("call_iv") > 0)
    # the fit that follows is heavy per slice and light in bytes
    clustered = ivs.repartition(task_count(ivs), *SLICE)
    grouped = clustered.groupBy(*SLICE).agg(
        *[F.first(c).alias(c) for c in ("spot", "rate", "t")],  # constant within a slice
        F.count_if(ok).alias("_liquid"),
        F.count_if(valid).alias("_valid"),
        F.min_by("call_iv", F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))).alias("atm_iv"),
        F.collect_list(F.when(valid, F.log(F.col("strike") / F.col("spot")))).alias("ks"),
        F.collect_list(F.when(valid, F.col("call_iv"))).alias("vols"),
        F.min(F.when(valid, F.col("strike"))).alias("k_low"),
        F.max(F.when(valid, F.col("strike"))).alias("k_high"),
    )
    enough, usable = F.col("_liquid") >= min_liquid, F.col("_valid") >= min_liquid
    return (
        grouped.withColumn("quality", F.when(enough & usable, "full").otherwise("degraded"))
        .withColumn(
            "liquid_strike_count",
            F.when(enough & ~usable, F.col("_valid")).otherwise(F.col("_liquid")),
        )
        .drop("_liquid", "_valid")
    )


def _solve(k, w, m, sigma):
    """Best cell among (m, sigma) pairs; the other three parameters follow by least squares.

    With y = (k - m)/sigma and z = sqrt(y^2 + 1) total variance is a + d y + c z.
    Three candidates per cell: the free solution, and the two edges of the
    correlation bound where d is a fixed multiple of c.  A flat smile competes too.
    """
    y = (k[None, :] - m[:, None]) / sigma[:, None]
    z = np.sqrt(y * y + 1.0)
    ym, zm, wm = y.mean(1), z.mean(1), w.mean()
    yc, zc, wc = y - ym[:, None], z - zm[:, None], w - wm
    syy, szz, syz = (yc * yc).mean(1), (zc * zc).mean(1), (yc * zc).mean(1)
    syw, szw, sww = yc @ wc / len(w), zc @ wc / len(w), float((wc * wc).mean())
    best = (sww, float(np.clip(wm, -A_BOUND, A_BOUND)), 0.0, 0.0, 0.0, 0.5)
    if not 0 < sww:
        return best
    with np.errstate(all="ignore"):
        det = syy * szz - syz * syz
        solid = det > FLAT * syy * szz
        candidates = [((syw * szz - szw * syz) / det, (szw * syy - syw * syz) / det, solid)]
        for edge in (RHO_MAX, -RHO_MAX):
            var = szz + 2 * edge * syz + edge * edge * syy
            c = (szw + edge * syw) / var
            candidates.append((edge * c, c, var > FLAT))
        for d, c, usable in candidates:
            a, b, rho = wm - d * ym - c * zm, c / sigma, d / c
            sse = sww - 2 * (d * syw + c * szw) + d * d * syy + 2 * c * d * syz + c * c * szz
            fits = usable & (c > 0) & (b <= B_MAX) & (np.abs(rho) <= RHO_MAX + 1e-12) & (np.abs(a) <= A_BOUND)
            sse = np.where(fits, sse, np.inf)
            i = int(np.argmin(sse))
            if sse[i] < best[0]:
                best = (float(sse[i]), float(a[i]), float(b[i]), float(rho[i]), float(m[i]), float(sigma[i]))
    return best


_M0, _S0 = (g.ravel() for g in np.meshgrid(GRID_M, GRID_SIGMA, indexing="ij"))
_STEP = np.arange(-REFINE_STEPS, REFINE_STEPS + 1) / REFINE_STEPS
_DM, _DS = (g.ravel() for g in np.meshgrid(_STEP, _STEP, indexing="ij"))
M_STEP = float(GRID_M[1] - GRID_M[0])
S_RATIO = float((GRID_SIGMA[-1] / GRID_SIGMA[0]) ** (1.0 / (len(GRID_SIGMA) - 1)))


_FIT_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("a", "b", "rho", "m", "sigma", "rmse")])


@F.pandas_udf(_FIT_TYPE)
def _fit(ks: pd.Series, vols: pd.Series, t: pd.Series) -> pd.DataFrame:
    rows = []
    for k, iv, years in zip(ks, vols, t):
        if k is None or len(k) == 0 or not years > 0:
            rows.append((None,) * 6)
            continue
        k, iv = np.asarray(k, dtype="float64"), np.asarray(iv, dtype="float64")
        w = iv * iv * years
        coarse = _solve(k, w, _M0, _S0)
        near = _solve(k, w, coarse[4] + _DM * M_STEP, np.clip(coarse[5] * S_RATIO**_DS, *SIGMA_BOUNDS))
        _, a, b, rho, m, sigma = min(coarse, near, key=lambda c: c[0])
        fitted = a + b * (rho * (k - m) + np.sqrt((k - m) ** 2 + sigma * sigma))
        model = np.sqrt(np.maximum(fitted, 1e-12) / years)
        rows.append((a, b, rho, m, sigma, float(np.sqrt(np.mean((model - iv) ** 2)))))
    return pd.DataFrame(rows, columns=["a", "b", "rho", "m", "sigma", "rmse"], dtype="float64")


def fit_svi(sliced: DataFrame) -> DataFrame:
    """H5: raw-SVI parameters and volatility-space error per slice.

    A relational fit would multiply every quote by the 1640 grid cells; here a
    batch of slices goes through one Arrow call and each slice is solved in
    closed form per cell, then once more on a finer grid around the best cell.
    """
    return sliced.withColumn("svi", _fit("ks", "vols", "t"))


def svi_variance(k: Column) -> Column:
    d = k - F.col("svi.m")
    s = F.col("svi.sigma")
    return F.col("svi.a") + F.col("svi.b") * (F.col("svi.rho") * d + F.sqrt(d * d + s * s))


def _gradient(df: DataFrame, value: str, out: str, keys: list[str], last: int | Column) -> DataFrame:
    """First derivative on a uniform grid: central inside, one-sided at both ends."""
    w = Window.partitionBy(*keys).orderBy("grid_i")
    lead, lag = F.lead(value).over(w), F.lag(value).over(w)
    return df.withColumn(
        out,
        F.when(F.col("grid_i") == 0, (lead - F.col(value)) / F.col("h"))
        .when(F.col("grid_i") == last, (F.col(value) - lag) / F.col("h"))
        .otherwise((lead - lag) / (2 * F.col("h"))),
    )


def second_derivative(df: DataFrame, value: str, out: str, keys: list[str], points: int | Column) -> DataFrame:
    """Gradient of the gradient over ``grid_i`` (from 0) with spacing ``h``; null where a slice has one point.

    ``points`` is the number of points of a slice, one for all or a column.
    """
    first = _gradient(df, value, "_g1", keys, points - 1)
    return _gradient(first, "_g1", out, keys, points - 1).drop("_g1")


def _clustered(slices_: DataFrame) -> DataFrame:
    """Spread slices while they are one row each; the grid windows then need no exchange."""
    return slices_.repartition(task_count(slices_), *SLICE)


def butterfly(fitted: DataFrame, points: int = config.ARBITRAGE_GRID) -> DataFrame:
    """Any concave stretch of fitted total variance on [k_min - 0.5, k_max + 0.5]."""
    low = F.array_min("ks") - 0.5
    high = F.array_max("ks") + 0.5
    grid = (
        _clustered(fitted.where(F.col("svi.a").isNotNull()))
        .select(*SLICE, "svi", low.alias("low"), ((high - low) / (points - 1)).alias("h"))
        .withColumn("grid_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("w", svi_variance(F.col("low") + F.col("h") * F.col("grid_i")))
    )
    curved = second_derivative(grid, "w", "d2w", SLICE, points)
    return curved.groupBy(*SLICE).agg(F.bool_or(F.col("d2w") < -1e-10).alias("has_butterfly_arbitrage"))


def density(fitted: DataFrame, points: int = config.DENSITY_GRID) -> DataFrame:
    """H7, second half: normalised density on the strike grid of every full slice."""
    margin = (F.col("k_high") - F.col("k_low")) * 0.05
    grid = (
        _clustered(fitted.where((F.col("quality") == "full") & F.col("svi.a").isNotNull()))
        .withColumn("_low", F.col("k_low") + margin)
        .withColumn("h", (F.col("k_high") - margin - F.col("_low")) / (points - 1))
        .select(*SLICE, "spot", "rate", "t", "svi", "_low", "h")
        .withColumn("grid_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("k", F.col("_low") + F.col("h") * F.col("grid_i"))
        .withColumn("_logk", F.log(F.col("k") / F.col("spot")))
    )
    smooth = grid.withColumn(
        "iv", F.sqrt(F.greatest(svi_variance(F.col("_logk")), F.lit(1e-12)) / F.col("t"))
    )
    priced = with_call_price(
        smooth, F.col("spot"), F.col("k"), F.col("rate"), F.col("t"), F.col("iv"), "call"
    ).withColumn("call", F.greatest("call", F.lit(0.0)))
    curved = second_derivative(priced, "call", "d2c", SLICE, points)
    per_slice = Window.partitionBy(*SLICE)
    weight = F.when(F.col("grid_i").isin(0, points - 1), 0.5).otherwise(1.0) * F.col("h")
    raw = curved.withColumn("_raw", F.exp(F.col("rate") * F.col("t")) * F.col("d2c"))
    clipped = raw.withColumn("f", F.greatest("_raw", F.lit(0.0))).withColumn("weight", weight)
    integral = F.sum(F.col("weight") * F.col("f")).over(per_slice)
    return (
        clipped.withColumn("_mass", integral)
        .withColumn("density", F.when(F.col("_mass") > 1e-12, F.col("f") / F.col("_mass")).otherwise(F.col("f")))
        .withColumn("clipped", F.col("_raw") < 0)
        .select(*SLICE, "spot", "grid_i", "k", "call", "d2c", "weight", "density", "clipped")
    )


def moments(grid: DataFrame) -> DataFrame:
    """D3 per slice: trapezoid mean, variance, skew and raw kurtosis, with density checks."""
    per_slice = Window.partitionBy(*SLICE)
    mass = F.col("weight") * F.col("density")
    centred = grid.withColumn("mean", F.sum(mass * F.col("k")).over(per_slice)).withColumn(
        "_u", F.col("k") - F.col("mean")
    )
    u = F.col("_u")
    raw = centred.groupBy(*SLICE).agg(
        F.first("mean").alias("implied_mean"),
        F.sum(mass * u * u).alias("implied_variance"),
        F.sum(mass * u * u * u).alias("_m3"),
        F.sum(mass * u * u * u * u).alias("_m4"),
        F.sum(mass).alias("integral"),
        F.count_if("clipped").alias("n_clipped"),
        F.first("spot").alias("_forward"),
    )
    var = F.col("implied_variance")
    thin = var < 1e-12
    shape = lambda num, power: F.when(thin, F.lit(0.0)).otherwise(F.col(num) / F.pow(var, F.lit(power)))
    return raw.select(
        *SLICE,
        "implied_mean",
        "implied_variance",
        shape("_m3", 1.5).alias("implied_skew"),
        shape("_m4", 2.0).alias("implied_kurtosis"),
        "integral",
        "n_clipped",
        (F.abs(F.col("integral") - 1.0) > 0.05).alias("integral_off"),
        (F.abs(F.col("implied_mean") - F.col("_forward")) / F.col("_forward") > 0.02).alias("mean_off"),
    )


def implied_moments(fitted: DataFrame) -> DataFrame:
    """H7 + D3 for every slice: degraded slices keep their ATM volatility and null moments.

    Fitted slices (one row each) are read twice and written once, so the fit runs once.
    """
    fitted = durable(fitted)
    found = moments(density(fitted))
    base = fitted.select(*SLICE, "quality", "liquid_strike_count", "atm_iv", F.size("ks").alias("n_points"),
                         F.col("svi.rmse").alias("rmse"))
    joined = base.join(found, SLICE, "left")
    full = F.col("quality") == "full"
    notes = [
        F.when(~full, F.lit("degraded")),
        F.when(full & (F.col("n_points") < 8), F.lit("sparse")),
        F.when(full & (F.col("rmse") > 0.05), F.lit("high_rmse")),
        F.when(F.col("n_clipped") > 0, F.lit("clipped")),
        F.when(F.col("integral_off"), F.lit("integral")),
        F.when(F.col("mean_off"), F.lit("mean")),
        F.when(F.col("implied_variance") < 1e-12, F.lit("flat")),
    ]
    return joined.withColumn("warnings", F.array_compact(F.array(*notes))).drop(
        "integral_off", "mean_off", "n_points"
    )
