"""Option features for every (market, date) of a quote table in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import chain, density, flows
from tidemark.operators.chain import SLICE
from tidemark.operators.ordered import checked_broadcast
from tidemark.session import durable

MOMENTS = ["implied_mean", "implied_variance", "implied_skew", "implied_kurtosis", "atm_iv"]
FLOWS = ["gex", "vanna_flow", "charm_flow"]


def option_features(
    quotes: DataFrame,
    spots: DataFrame,
    seq: Column,
    multipliers: DataFrame | None = None,
    rate: float = config.RISK_FREE_RATE,
    multiplier: float = 400.0,
) -> DataFrame:
    """Quotes -> front slice -> best quotes -> pairs -> moments and flows -> long features.

    ``quotes`` needs market, as_of, expiry, strike, is_call, bid, ask, oi;
    ``spots`` (market, spot) the closes visible at the batch date.  Moments use
    the loose liquidity rule, flows the strict one; each keeps its own quality.
    """
    quotes = quotes.where(F.col("strike") > 0)  # missing definitions carry strike 0
    # one row per market and date: counted, then broadcast, so the quotes are not shuffled here
    front = checked_broadcast(durable(chain.front_expiry(quotes)), 200_000)
    in_front = quotes.join(front, SLICE, "left_semi")
    pairs = chain.pair_sides(chain.best_quotes(in_front, seq))
    priced = chain.with_spot(pairs, spots)
    if multipliers is None:
        priced = priced.withColumn("multiplier", F.lit(multiplier))
    else:
        priced = priced.join(multipliers, "market")
    years = F.datediff("expiry", "as_of") / F.lit(365.0)
    # one row per strike is left and two branches read it: written once, so that
    # quotes are scanned and volatilities inverted once
    ivs = durable(density.with_ivs(priced, F.col("spot"), F.lit(rate), years))

    sliced = density.slices(ivs, max_spread=config.DENSITY_MAX_SPREAD_PCT, min_oi=config.DENSITY_MIN_OI)
    moments = density.implied_moments(density.fit_svi(sliced))
    flow = flows.greeks_flow(ivs, F.col("spot"), F.lit(rate), F.col("multiplier"))

    def melt(df: DataFrame, names: list[str]) -> DataFrame:
        return df.select(*SLICE, "quality", *names).unpivot([*SLICE, "quality"], names, "feature_name", "value")

    both = melt(moments, MOMENTS).unionByName(melt(flow, FLOWS)).where(F.col("value").isNotNull())
    stamp = F.col("as_of").cast("timestamp_ntz")
    return both.select(
        "market", "feature_name", stamp.alias("as_of"), stamp.alias("available_at"), "value", "quality"
    )
