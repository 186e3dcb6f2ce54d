"""Positioning sentiment and its divergence from option prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import Cut, framed

HISTORY = 52


def percentile_rank(history: Column, value: Column) -> Column:
    """Mean of strict and weak rank (plus the usual half step), as a share in [0, 1]."""
    below = F.size(F.filter(history, lambda h: h < value))
    upto = F.size(F.filter(history, lambda h: h <= value))
    n = F.size(history)
    step = F.when(below < upto, 1).otherwise(0)
    return F.when(n > 0, (below + upto + step) / (2.0 * n))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def sentiment_columns(managed_net: Column, total_oi: Column, net_hist: Column, oi_hist: Column) -> dict[str, Column]:
    """E5 for one row with its history arrays; fewer than four history points give neutral zeros."""
    enough = F.size(net_hist) >= 4
    rank = percentile_rank(net_hist, managed_net)
    oi_rank = percentile_rank(oi_hist, total_oi)
    concentration = F.abs(managed_net) / F.greatest(total_oi, F.lit(1.0))
    confidence = 0.6 * oi_rank + 0.4 * F.least(concentration * 5.0, F.lit(1.0))
    return {
        "sentiment_score": F.when(enough, clip(2.0 * rank - 1.0, -1.0, 1.0)).otherwise(F.lit(0.0)),
        "sentiment_confidence": F.when(enough, clip(confidence, 0.0, 1.0)).otherwise(F.lit(0.0)),
        "pct_rank": F.when(enough, rank),
        "oi_rank": F.when(enough, oi_rank),
        "concentration": F.when(enough, concentration),
    }


def cot_sentiment(reports: DataFrame, weeks: int = HISTORY, cell: Cut = None) -> DataFrame:
    """E5 over whole report tables: each report against the last ``weeks`` reports incl. itself."""
    base = reports.withColumn("_ts", F.col("report_date").cast("timestamp_ntz"))
    windowed = framed(
        base,
        ["market"],
        ["_ts"],
        cell,
        {
            "_nets": lambda f: F.collect_list("managed_money_net").over(f(-(weeks - 1), 0)),
            "_ois": lambda f: F.collect_list("total_oi").over(f(-(weeks - 1), 0)),
        },
        before=weeks,
    )
    scored = sentiment_columns(F.col("managed_money_net"), F.col("total_oi"), F.col("_nets"), F.col("_ois"))
    return windowed.select(*reports.columns, *[c.alias(n) for n, c in scored.items()])


def zscore(
    df: DataFrame, keys: list[str], order: list[str], value: str, cell: Cut = None, window: int = HISTORY
) -> DataFrame:
    """Z-score against the preceding rows (population deviation).

    The raw value stays with fewer than ten preceding rows or a flat history.
    """
    out = framed(
        df,
        keys,
        order,
        cell,
        {
            "_n": lambda f: F.count(value).over(f(-window, -1)),
            "_mean": lambda f: F.avg(value).over(f(-window, -1)),
            "_std": lambda f: F.stddev_pop(value).over(f(-window, -1)),
        },
        before=window,
    )
    usable = (F.col("_n") >= 10) & (F.col("_std") >= 1e-12)
    z = F.when(usable, (F.col(value) - F.col("_mean")) / F.col("_std")).otherwise(F.col(value))
    return out.withColumn("magnitude", z).drop("_n", "_mean", "_std")


def raw_divergence(implied_mean: Column, spot: Column, sentiment: Column) -> Column:
    return F.try_divide(implied_mean - spot, spot) - sentiment / 10.0


def classify(
    implied_mean: Column,
    spot: Column,
    skew: Column,
    kurtosis: Column,
    score: Column,
    score_confidence: Column,
    quality: Column,
    magnitude: Column | None = None,
) -> dict[str, Column]:
    """First matching rule decides type, direction and suggested bias."""
    bias = F.try_divide(implied_mean - spot, spot)
    size, mood = F.abs(bias), F.abs(score)
    known = implied_mean.isNotNull()
    side = F.when(bias > 0, 1).otherwise(-1)
    rules = [
        ((kurtosis > 4.0) & (size < 0.02), "volatility_play", F.lit(0), "vol_play"),
        ((bias > 0.01) & (score < -0.3), "options_bullish_sentiment_bearish", F.lit(1), "long"),
        ((bias < -0.01) & (score > 0.3), "options_bearish_sentiment_bullish", F.lit(-1), "short"),
        ((size < 0.02) & (mood > 0.6), "sentiment_overreaction", F.when(score > 0, -1).otherwise(1), "fade_sentiment"),
        ((size > 0.01) & (F.abs(skew) > 0.5) & (mood < 0.3), "early_signal", side, "early_entry"),
        ((size > 0.01) & (mood > 0.01) & (bias * score > 0), "trend_follow", side, "trend_follow"),
    ]

    def decide(pick, default) -> Column:
        chain = None
        for condition, *result in rules:
            hit = known & F.coalesce(condition, F.lit(False))
            chain = F.when(hit, pick(result)) if chain is None else chain.when(hit, pick(result))
        return chain.otherwise(default)

    raw = raw_divergence(implied_mean, spot, score)
    strength = F.when(known, raw if magnitude is None else magnitude).otherwise(F.lit(0.0))
    penalty = F.when(quality == "full", 1.0).otherwise(0.5)
    effect = F.greatest(F.least(F.abs(strength) / 2.0, F.lit(1.0)), F.lit(0.3))
    return {
        "direction": decide(lambda r: r[1], F.lit(0)),
        "magnitude": strength,
        "divergence_type": decide(lambda r: F.lit(r[0]), F.lit("neutral")),
        "confidence": clip(score_confidence * penalty * effect, 0.0, 1.0),
        "suggested_bias": decide(lambda r: F.lit(r[2]), F.lit("neutral")),
    }


def signal_features(wide: DataFrame, spot: Column | None = None, parity: bool = False) -> DataFrame:
    """Five computed features next to the stored ones; null where inputs are missing.

    ``wide`` is the C2 matrix.  With ``parity`` the sentiment sees a history of
    one point (neutral) and the spot defaults to the implied mean; otherwise the
    columns sentiment_score/sentiment_confidence of E5 and a real spot are used.
    """
    has_cot = F.col("cot_managed_money_net").isNotNull() & F.col("cot_total_oi").isNotNull()
    if parity:
        score = F.when(has_cot, F.lit(0.0))
        confidence = F.when(has_cot, F.lit(0.0))
    else:
        score = F.when(has_cot, F.col("sentiment_score"))
        confidence = F.when(has_cot, F.col("sentiment_confidence"))
    base = wide.withColumn("_score", score).withColumn("_conf", confidence)
    base = base.withColumn("_spot", F.coalesce(spot, F.col("implied_mean")) if spot is not None else F.col("implied_mean"))
    both = F.col("implied_mean").isNotNull() & F.col("_score").isNotNull()
    parts = classify(
        F.col("implied_mean"), F.col("_spot"), F.col("implied_skew"), F.col("implied_kurtosis"),
        F.col("_score"), F.col("_conf"), F.lit("full"),
    )
    return (
        base.withColumn("divergence_direction", F.when(both, parts["direction"].cast("double")))
        .withColumn("divergence_magnitude", F.when(both, parts["magnitude"]))
        .withColumn("divergence_confidence", F.when(both, parts["confidence"]))
        .withColumn("sentiment_score", F.col("_score"))
        .withColumn("sentiment_confidence", F.col("_conf"))
        .drop("_score", "_conf", "_spot")
    )
