"""Data quality: option chains, staleness, overall status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.dates import weekdays_between
from tidemark.operators.chain import SLICE, liquid, parity_error

# --- fixed values: source, threshold in days, count weekdays only
SOURCES = [
    ("futures", config.FUTURES_STALE_DAYS, True),
    ("options", config.OPTIONS_STALE_DAYS, True),
    ("cot", config.COT_STALE_DAYS, False),
]


def options_quality(
    pairs: DataFrame,
    spot: Column,
    min_oi: float = config.MIN_OI,
    max_spread: float = config.MAX_SPREAD_PCT,
    min_liquid: int = config.MIN_LIQUID_STRIKES,
    rate: float = config.RISK_FREE_RATE,
    t: float = 0.25,
) -> DataFrame:
    """Liquid strikes, price monotonicity and parity error, one aggregate per slice.

    The previous price comes from a window over one slice, which holds one row
    per strike.
    """
    ok = liquid(F.col("combined_oi"), F.col("spread"), min_oi, max_spread)
    previous = F.lag("call_mid").over(Window.partitionBy(*SLICE).orderBy("strike"))
    checked = pairs.withColumn("_rising", F.col("call_mid") > previous)
    error = parity_error(F.col("call_mid"), F.col("put_mid"), spot, F.col("strike"), F.lit(rate), F.lit(t))
    report = checked.groupBy(*SLICE).agg(
        F.count_if(ok).alias("liquid_strike_count"),
        F.count(F.lit(1)).alias("total_strikes"),
        F.coalesce(F.bool_or("_rising"), F.lit(False)).alias("has_arbitrage_violation"),
        F.max(error).alias("put_call_parity_max_error"),
    )
    return report.withColumn(
        "warnings",
        F.array_compact(
            F.array(
                F.when(F.col("has_arbitrage_violation"), F.lit("call price arbitrage")),
                F.when(F.col("liquid_strike_count") < min_liquid, F.lit("too few liquid strikes")),
            )
        ),
    )


def staleness(updates: DataFrame, markets: DataFrame, now: Column) -> DataFrame:
    """Per (market, source) time since the last update; no data counts as stale.

    ``updates`` holds (market, source, available_at) rows.  It is reduced to one
    row per (market, source) before it meets the full list of sources.
    """
    last = updates.groupBy("market", "source").agg(F.max("available_at").alias("last_update"))
    rules = F.array(
        *[
            F.struct(F.lit(s).alias("source"), F.lit(d).alias("threshold_days"), F.lit(w).alias("weekdays"))
            for s, d, w in SOURCES
        ]
    )
    expected = markets.select("market").distinct().select("market", F.inline(rules))
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_update").cast("timestamp"))
    gap = F.when(F.col("weekdays"), weekdays_between(F.col("last_update"), now).cast("double")).otherwise(
        seconds / F.lit(86_400_000_000.0)
    )
    return (
        expected.join(last, ["market", "source"], "left")
        .withColumn("days_since_update", F.when(F.col("last_update").isNotNull(), gap))
        .withColumn(
            "is_stale", F.coalesce(F.col("days_since_update") > F.col("threshold_days"), F.lit(True))
        )
        .drop("weekdays")
    )


def cot_freshness(updates: DataFrame, markets: DataFrame, now: Column) -> DataFrame:
    """The report source alone, in calendar days."""
    return staleness(updates.where(F.col("source") == "cot"), markets, now).where(F.col("source") == "cot")


def quality_report(stale: DataFrame, options: DataFrame, min_liquid: int = config.MIN_LIQUID_STRIKES) -> DataFrame:
    """Stale before degraded before healthy, per market."""
    by_market = stale.groupBy("market").agg(
        F.bool_or("is_stale").alias("any_stale"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_stale"), F.col("source")))), ",").alias("stale_sources"),
    )
    chain = options.groupBy("market").agg(
        F.min("liquid_strike_count").alias("liquid_strike_count"),
        F.bool_or("has_arbitrage_violation").alias("has_arbitrage_violation"),
    )
    joined = by_market.join(chain, "market", "left")
    count = F.coalesce("liquid_strike_count", F.lit(0))
    weak = (count < min_liquid) | F.coalesce("has_arbitrage_violation", F.lit(False))
    return joined.withColumn("liquid_strike_count", count).withColumn(
        "overall_status", F.when(F.col("any_stale"), "stale").when(weak, "degraded").otherwise("healthy")
    )
