"""Backtest metrics, fitness and promotion as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators.ordered import Cut
from tidemark.operators.returns import max_drawdown

ANNUAL = sqrt(252.0)


def sharpe(ret: Column) -> Column:
    """Annualised mean over sample deviation; 0 with one row or no deviation."""
    std = F.stddev_samp(ret)
    return F.when(F.count(ret) <= 1, F.lit(0.0)).when(std == 0, F.lit(0.0)).otherwise(F.avg(ret) / std * ANNUAL)


def backtest_metrics(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Cut = None,
    ret: str = "ret",
    predicted: str = "predicted",
    actual: str = "actual",
) -> DataFrame:
    """D4 per run.  Only the drawdown depends on order; the rest is one combined aggregate."""
    r = F.col(ret)
    traded = F.when(r != 0, r)
    flat = rows.groupBy(*keys).agg(
        sharpe(r).alias("sharpe_ratio"),
        (F.exp(F.sum(F.log1p(r))) - 1.0).alias("total_return"),
        F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("hit_rate"),
        F.count(traded).alias("n_trades"),
        F.coalesce(F.avg(traded), F.lit(0.0)).alias("avg_return_per_trade"),
    )
    return flat.join(max_drawdown(rows, keys, order, cell, ret), list(keys))


def fold_sharpes(rows: DataFrame, keys: Sequence[str], fold: str, ret: str = "ret") -> DataFrame:
    """D5."""
    return rows.groupBy(*keys, fold).agg(sharpe(F.col(ret)).alias("fold_sharpe"))


def robustness(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of folds with a positive Sharpe ratio."""
    return folds.groupBy(*keys).agg(F.avg((F.col("fold_sharpe") > 0).cast("double")).alias("robustness"))


def brier(rows: DataFrame, keys: Sequence[str], p: str = "p", actual: str = "actual") -> DataFrame:
    """D7."""
    miss = F.col(p) - F.col(actual)
    return rows.groupBy(*keys).agg(F.avg(miss * miss).alias("calibration"))


def simplicity(n_features: Column, n_estimators: Column) -> Column:
    """D8."""
    score = 1.0 / F.log2(n_features * n_estimators + 1.0)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def fitness(metrics: DataFrame, keys: Sequence[str], weights: dict | None = None) -> DataFrame:
    """Weighted sum of clipped min-max scores; null when a metric is missing."""
    table = weights or config.FITNESS
    if abs(sum(w for w, *_ in table.values()) - 1.0) > 1e-6:
        raise ValueError("weights must sum to 1")
    score = None
    parts = []
    for name, (weight, low, high, lower_is_better) in table.items():
        norm = F.least(F.greatest((F.col(name) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
        norm = F.when(F.col(name).isNotNull(), 1.0 - norm if lower_is_better else norm)
        parts.append(norm.alias(f"norm_{name}"))
        score = norm * weight if score is None else score + norm * weight
    return metrics.select(*keys, *parts, score.alias("composite"))


def promotion(
    scores: DataFrame,
    keys: Sequence[str],
    candidate: str = "candidate",
    champion: str = "champion",
    n_windows: int = 5,
    required: int = 3,
    margin: float = 0.0,
) -> DataFrame:
    """Windows won strictly; valid only with exactly ``n_windows`` paired scores."""
    both = F.col(candidate).isNotNull() & F.col(champion).isNotNull()
    won = scores.groupBy(*keys).agg(
        F.count_if(F.col(candidate) > F.col(champion) + margin).alias("windows_won"),
        ((F.count(F.lit(1)) == n_windows) & (F.count_if(both) == n_windows)).alias("valid"),
    )
    return won.withColumn("promoted", F.when(F.col("valid"), F.col("windows_won") >= required)).withColumn(
        "reason",
        F.concat(
            F.lit("Candidate won "),
            F.col("windows_won").cast("string"),
            F.lit(f" of {n_windows} windows (required: {required})"),
        ),
    )
