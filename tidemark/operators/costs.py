"""Fills: predicted against actual slippage, volumes, order plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.risk import round_to_tick
from tidemark.operators.ordered import exact_quantiles
from tidemark.sources.journals import all_of

MIN_FILLS = 10


def fills_query(fills: DataFrame, order: Sequence[str], symbol: str | None = None, since=None, until=None, limit: int = 1000) -> DataFrame:
    """Filters pushed to the scan, then a top-n by time (no full sort)."""
    conditions: list[Column] = []
    if symbol is not None:
        conditions.append(F.col("symbol") == symbol)
    if since is not None:
        conditions.append(F.col("timestamp") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        conditions.append(F.col("timestamp") <= F.lit(until).cast("timestamp_ntz"))
    return fills.where(all_of(conditions)).orderBy(*[F.desc(c) for c in order]).limit(limit)


def slippage_pairs(fills: DataFrame, order: Sequence[str], symbol: str | None = None, since=None) -> DataFrame:
    """(predicted, actual), newest first."""
    rows = fills
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    if since is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(since).cast("timestamp_ntz"))
    return rows.orderBy(*[F.desc(c) for c in order]).select("symbol", "timestamp", "predicted_slippage", "actual_slippage")


def reconcile(fills: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bias is actual minus predicted; groups with fewer than ten fills give no row.

    Moments are one map-side combined aggregate.  Medians and 95th percentiles
    are exact but rank-based, so no task holds the values of a hot symbol.
    """
    keys = list(keys)
    p, a = F.col("predicted_slippage"), F.col("actual_slippage")
    # from covariance and deviations: corr() divides by zero on a constant side in ANSI mode
    spread = F.stddev_pop(p) * F.stddev_pop(a)
    corr = F.when(spread > 0, F.covar_pop(p, a) / spread).otherwise(F.lit(0.0))
    moments = (
        fills.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_fills"),
            F.avg(p).alias("mean_predicted"),
            F.avg(a).alias("mean_actual"),
            F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
            corr.alias("correlation"),
        )
        .where(F.col("n_fills") >= MIN_FILLS)
        .withColumn("bias", F.col("mean_actual") - F.col("mean_predicted"))
        .withColumn("pessimism_multiplier", F.col("mean_actual") / F.greatest("mean_predicted", F.lit(1e-10)))
    )
    # both sides go through one rank search, keyed by (symbol, side)
    sides = fills.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit("predicted").alias("side"), p.alias("slip")),
                F.struct(F.lit("actual").alias("side"), a.alias("slip")),
            )
        ),
    )
    ranks = exact_quantiles(sides, [*keys, "side"], "slip", {"median": 0.5, "p95": 0.95})
    wide = ranks.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("side") == side, F.col(q))).alias(f"{q}_{side}")
            for q in ("median", "p95")
            for side in ("predicted", "actual")
        ]
    )
    return moments.join(wide, keys)


def calibration_gate(report: DataFrame, max_bias: float | Column = 0.5, min_corr: float | Column = 0.3) -> DataFrame:
    """Small bias and enough correlation, with the first reason that fails."""
    biased, weak = F.abs(F.col("bias")) > max_bias, F.col("correlation") < min_corr
    return report.withColumn("calibrated", ~biased & ~weak).withColumn(
        "reason",
        F.when(biased, "bias exceeds threshold").when(weak, "correlation below threshold").otherwise("Model calibrated"),
    )


def adv_volatility(bars: DataFrame, price: str = "close", n: int = 20) -> DataFrame:
    """Mean volume and population deviation of log returns over the last 20 bars per market.

    ``row_number <= n`` is pushed below the shuffle as a partial group limit,
    so a hot market sends at most n rows per task.
    """
    newest = Window.partitionBy("market").orderBy(F.desc("ts"))
    recent = bars.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n)
    by_time = Window.partitionBy("market").orderBy("ts")  # n rows per market
    logs = recent.withColumn("_lr", F.log(F.col(price)) - F.log(F.lag(price).over(by_time)))
    return logs.groupBy("market").agg(
        F.coalesce(F.avg("volume"), F.lit(500.0)).alias("adv"),
        F.coalesce(F.stddev_pop("_lr"), F.lit(0.02)).alias("volatility"),
    )


def fill_performance(fills: DataFrame, order: Sequence[str], lookback: int = 30) -> DataFrame:
    """Mean over population deviation of the returns of the newest fills per symbol."""
    newest = Window.partitionBy("symbol").orderBy(*[F.desc(c) for c in order])
    ranked = fills.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= lookback)
    change = (F.col("fill_price") - F.col("order_price")) / F.greatest("order_price", F.lit(1e-10))
    rows = ranked.withColumn("_ret", change * F.col("direction")).withColumn(
        "_hit", ((F.col("direction") > 0) == (F.col("_ret") > 0)).cast("double")
    )
    enough = F.count(F.lit(1)) >= 2
    mean, std = F.avg("_ret"), F.stddev_pop("_ret")
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_fills"),
        F.when(enough, mean).otherwise(F.lit(0.0)).alias("mean_return"),
        F.when(enough, std).otherwise(F.lit(0.0)).alias("std_return"),
        F.when(enough, mean / F.greatest(std, F.lit(1e-10))).otherwise(F.lit(0.0)).alias("baseline_sharpe"),
        F.avg("_hit").alias("hit_rate"),
    )


def order_plan(
    orders: DataFrame,
    n_contracts: Column,
    adv: Column,
    mid: Column,
    is_buy: Column,
    threshold: float = 0.01,
    slices: int = 5,
    tick: float = 0.025,
    step_pct: float = 0.001,
) -> DataFrame:
    """Slice sizes and the price ladder mid -> one step -> ten steps toward the market.

    Orders of at least 1 % of daily volume are cut in five; the remainder goes
    to the first slices, which is integer arithmetic on the slice number.
    """
    side = F.when(is_buy, 1.0).otherwise(-1.0)
    size = n_contracts.cast("long")
    parts = F.when(size / F.greatest(adv, F.lit(1.0)) >= threshold, F.lit(slices)).otherwise(F.lit(1))
    staged = orders.withColumn("n_slices", parts).withColumn(
        "slice_no", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1))
    )
    base = F.floor(size / F.col("n_slices"))
    extra = F.when(F.col("slice_no") < size - base * F.col("n_slices"), 1).otherwise(0)
    ladder = lambda steps: round_to_tick(mid + side * mid * (step_pct * steps), tick)
    return (
        staged.withColumn("slice_contracts", (base + extra).cast("long"))
        .withColumn("price_mid", round_to_tick(mid, tick))
        .withColumn("price_step", ladder(1))
        .withColumn("price_cross", ladder(10))
    )
