"""Returns, targets, equity and walk-forward folds over ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators.ordered import Cut, attach, checked_broadcast, framed, index_rows, running, running_sums
from tidemark.session import durable

DEFAULT_VOL = 0.02


def simple_returns(bars: DataFrame, cell: Cut = None, price: str = "close", keys=("market",), order=("ts",)) -> DataFrame:
    """(p_t - p_{t-1}) / p_{t-1}, 0 for the first bar and after a zero price."""
    out = framed(bars, keys, order, cell, {"_prev": lambda f: F.first(price).over(f(-1, -1))}, before=1)
    p = F.col(price)
    return out.withColumn("ret", F.coalesce(F.try_divide(p - F.col("_prev"), F.col("_prev")), F.lit(0.0))).drop("_prev")


def rolling_vol(bars: DataFrame, cell: Cut = None, price: str = "close", window: int = 20, keys=("market",), order=("ts",)) -> DataFrame:
    """Sample deviation of up to 20 log returns ending at the bar; 0.02 for the first two bars.

    The deviation needs the previous price of each of the last 20 bars.  One
    frame of 21 prices gives both: log returns are taken from the collected
    prices instead of a second pass over the order.
    """
    out = framed(
        bars,
        keys,
        order,
        cell,
        {"_prices": lambda f: F.collect_list(price).over(f(-window, 0))},
        before=window,
        index="bar_idx",
    )
    logs = F.transform("_prices", lambda v: F.log(v))
    out = out.withColumn("_logs", logs)
    pairs = F.zip_with(
        F.slice("_logs", 2, F.size("_logs") - 1), F.slice("_logs", 1, F.size("_logs") - 1), lambda b, a: b - a
    )
    out = out.withColumn("_lr", F.when(F.size("_logs") > 2, pairs))
    n = F.size("_lr")
    out = out.withColumn("_mean", F.aggregate("_lr", F.lit(0.0), lambda s, v: s + v) / n)
    ss = F.aggregate("_lr", F.lit(0.0), lambda s, v: s + (v - F.col("_mean")) * (v - F.col("_mean")))
    return out.withColumn(
        "rolling_vol",
        F.when(F.col("bar_idx") < 2, F.lit(DEFAULT_VOL)).otherwise(F.sqrt(ss / (n - 1))),
    ).drop("_prices", "_logs", "_lr", "_mean")


def binary_target(bars: DataFrame, cell: Cut = None, horizon: int = 5, price: str = "close", keys=("market",), order=("ts",)) -> DataFrame:
    """1 if the price ``horizon`` bars ahead is higher, else 0; null for the last bars."""
    out = framed(bars, keys, order, cell, {"_next": lambda f: F.first(price).over(f(horizon, horizon))}, after=horizon)
    return out.withColumn(
        "target", F.when(F.col("_next").isNotNull(), (F.col("_next") > F.col(price)).cast("int"))
    ).drop("_next")


def equity(returns: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Cut = None, ret: str = "ret") -> DataFrame:
    """Compounded equity, running peak and drawdown; the curve has no leading 1."""
    grown = running_sums(returns, keys, order, cell, {"_log": F.log1p(F.col(ret))}, {"_log": "max"})
    return (
        grown.withColumn("equity", F.exp("_log"))
        .withColumn("drawdown", F.exp(F.col("_log") - F.col("_log_peak")) - 1.0)
        .drop("_log", "_log_peak")
    )


def max_drawdown(returns: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Cut = None, ret: str = "ret") -> DataFrame:
    curve = equity(returns, keys, order, cell, ret)
    return curve.groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, initial: float, cell: Cut = None) -> DataFrame:
    """Last known value over rows that have none; ``initial`` before the first."""
    out = running(df, keys, order, cell, {"_last": ("last", F.col(value))})
    return out.withColumn(f"{value}_filled", F.coalesce("_last", F.lit(initial))).drop("_last")


def folds(
    bars: DataFrame,
    cell: Cut = None,
    keys: Sequence[str] = ("market",),
    order: Sequence[str] = ("ts",),
    n_splits: int = config.WALK_FORWARD["n_splits"],
    embargo: int = config.WALK_FORWARD["embargo"],
    min_train: int = config.WALK_FORWARD["min_train"],
    test_size: int = config.WALK_FORWARD["test_size"],
) -> DataFrame:
    """(fold, role) labels; fold k trains on [0, T_k), skips the embargo, tests the next rows.

    A row belongs to at most ``n_splits`` folds, which follow from its index by
    arithmetic: no join with a fold table is needed.  Folds whose test end lies
    beyond the series are left out.
    """
    keys = list(keys)
    numbered = index_rows(bars, keys, order, cell, "row_idx")
    # one row per key: meets the rows by broadcast, so no key is gathered in one task
    sizes = durable(bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    sized = attach(numbered, checked_broadcast(sizes), keys)
    fold = F.col("fold")
    train_end = F.lit(min_train) + fold * test_size
    test_start = train_end + embargo
    role = F.when(F.col("row_idx") < train_end, "train").when(
        (F.col("row_idx") >= test_start) & (F.col("row_idx") < test_start + test_size), "test"
    )
    return (
        sized.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
        .where(test_start + test_size <= F.col("_n"))
        .withColumn("role", role)
        .where(F.col("role").isNotNull())
        .drop("_n")
    )


def fold_sizes(spark: SparkSession, n_samples: int, **sizes) -> DataFrame:
    """Fold bounds for one series length, for planning."""
    w = {**config.WALK_FORWARD, **sizes}
    k = F.col("fold")
    train_end = F.lit(w["min_train"]) + k * w["test_size"]
    return (
        spark.range(w["n_splits"])
        .select(F.col("id").alias("fold"))
        .select(
            "fold",
            train_end.alias("train_end"),
            (train_end + w["embargo"]).alias("test_start"),
            (train_end + w["embargo"] + w["test_size"]).alias("test_end"),
        )
        .where(F.col("test_end") <= n_samples)
    )
