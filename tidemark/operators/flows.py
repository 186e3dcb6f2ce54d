"""Dealer flows from option sensitivities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.black76 import with_greeks
from tidemark.operators.chain import SLICE


def greeks_flow(
    pairs: DataFrame,
    spot: Column,
    rate: Column,
    multiplier: Column,
    keys: list[str] = SLICE,
    min_liquid: int = config.MIN_LIQUID_STRIKES,
    max_spread: float = config.MAX_SPREAD_PCT,
    min_oi: float = config.MIN_OI,
) -> DataFrame:
    """Signed gamma, vanna and charm exposure per group.

    Input has one row per strike with t, spread, call_iv, put_iv, call_oi,
    put_oi.  Calls count +1, puts -1, over all strikes with T in (0, 2], a
    positive volatility and positive interest.  Fewer than eight liquid strikes
    give zero flows and quality ``degraded``.
    """
    tight = F.col("spread") <= max_spread
    is_liquid = tight & ((F.col("call_oi") >= min_oi) | (F.col("put_oi") >= min_oi))
    flagged = pairs.withColumn("_liquid", is_liquid).withColumn("_spot", spot).withColumn("_mult", multiplier)
    # two legs per strike, then one greek computation for both
    legs = flagged.select(
        *keys,
        "strike",
        "t",
        "_liquid",
        "_spot",
        "_mult",
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("sign"), F.col("call_iv").alias("iv"), F.col("call_oi").alias("oi")),
                F.struct(F.lit(-1).alias("sign"), F.col("put_iv").alias("iv"), F.col("put_oi").alias("oi")),
            )
        ),
    ).withColumn("iv", F.coalesce("iv", F.lit(0.0)))
    s = F.col("_spot")
    rated = with_greeks(legs, s, F.col("strike"), rate, F.col("t"), F.col("iv"), F.col("sign") > 0)
    counts = (F.col("t") > 0) & (F.col("t") <= 2.0) & (F.col("iv") > 0) & (F.col("oi") > 0)
    size = F.col("sign") * F.col("oi") * F.col("_mult")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(counts, value)), F.lit(0.0))

    sums = rated.groupBy(*keys).agg(
        F.count_if(F.col("_liquid") & (F.col("sign") > 0)).alias("liquid_strike_count"),
        total(size * F.col("gamma") * s * s / 100).alias("gex"),
        total(size * F.col("vanna") * s).alias("vanna_flow"),
        total(size * F.col("charm")).alias("charm_flow"),
    )
    full = F.col("liquid_strike_count") >= min_liquid
    return sums.select(
        *keys,
        *[F.when(full, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in ("gex", "vanna_flow", "charm_flow")],
        F.when(full, "full").otherwise("degraded").alias("quality"),
        "liquid_strike_count",
    )
