"""Option chains: one row per quote, grouped by slice = (market, as_of, expiry)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import quotes as q
from tidemark.operators.ordered import checked_broadcast
from tidemark.session import durable, task_count

SLICE = ["market", "as_of", "expiry"]


def last_per_instrument(df: DataFrame, seq: str) -> DataFrame:
    """Duplicate definition/statistics rows: the last one wins, combined on the map side."""
    rest = [c for c in df.columns if c not in ("instrument_id", seq)]
    return (
        df.groupBy("instrument_id")
        .agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
        .select("instrument_id", "_last.*")
    )


def assemble(quotes: DataFrame, definitions: DataFrame, statistics: DataFrame) -> DataFrame:
    """C4: quotes with definition and open interest; defaults where either is missing."""
    named = last_per_instrument(definitions, "seq").select(
        "instrument_id",
        F.col("strike").cast("double").alias("strike"),
        "expiry",
        (F.upper("instrument_class") == "C").alias("is_call"),
    )
    interest = last_per_instrument(statistics, "seq").select(
        "instrument_id", F.col("open_interest").cast("double").alias("oi")
    )
    return (
        quotes.join(named, "instrument_id", "left")
        .join(interest, "instrument_id", "left")
        .withColumn("strike", F.coalesce("strike", F.lit(0.0)))
        .withColumn("expiry", F.coalesce("expiry", F.lit("")))
        .withColumn("is_call", F.coalesce("is_call", F.lit(True)))
        .withColumn("oi", F.coalesce("oi", F.lit(0.0)))
    )


def with_mid(df: DataFrame) -> DataFrame:
    """Mid and relative spread."""
    bid, ask = F.coalesce("bid", F.lit(0.0)), F.coalesce("ask", F.lit(0.0))
    priced = df.withColumn("mid", q.mid_price(bid, ask))
    return priced.withColumn("spread_pct", q.spread_pct(bid, ask, F.col("mid")))


def liquid(oi: Column, spread: Column, min_oi: float, max_spread: float) -> Column:
    """Enough open interest and a tight enough spread."""
    return (oi >= min_oi) & (spread <= max_spread)


def best_quotes(df: DataFrame, seq: Column) -> DataFrame:
    """Tightest spread per (slice, strike, side); the first seen wins ties.

    ``min_by`` combines on the map side: repeated snapshots of a hot slice
    collapse to one row per strike and side before the shuffle.
    """
    return (
        with_mid(df)
        .groupBy(*SLICE, "strike", "is_call")
        .agg(
            F.min_by(
                F.struct("mid", F.coalesce("oi", F.lit(0.0)).alias("oi"), "spread_pct"),
                F.struct(F.col("spread_pct"), seq.alias("seq")),
            ).alias("_q")
        )
        .select(*SLICE, "strike", "is_call", "_q.*")
    )


def pair_sides(best: DataFrame, min_strikes: int = 3) -> DataFrame:
    """Strikes quoted on both sides; slices with fewer than three such strikes are dropped.

    Combined interest is the larger, spread the tighter of the two sides.
    """
    side = lambda name, call: F.max(F.when(F.col("is_call") == call, F.col(name)))
    paired = (
        best.groupBy(*SLICE, "strike")
        .agg(
            side("mid", True).alias("call_mid"),
            side("mid", False).alias("put_mid"),
            side("oi", True).alias("call_oi"),
            side("oi", False).alias("put_oi"),
            side("spread_pct", True).alias("call_spread"),
            side("spread_pct", False).alias("put_spread"),
            F.count_if("is_call").alias("_calls"),
            F.count_if(~F.col("is_call")).alias("_puts"),
        )
        .where((F.col("_calls") > 0) & (F.col("_puts") > 0))
        .withColumn("combined_oi", F.greatest("call_oi", "put_oi"))
        .withColumn("spread", F.least("call_spread", "put_spread"))
        .drop("_calls", "_puts", "call_spread", "put_spread")
    )
    # One row per strike is left, so a slice is a few hundred rows at most.  The
    # volatility inversion that usually follows is heavy: the task count is explicit.
    clustered = paired.repartition(task_count(paired), *SLICE)
    counted = clustered.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*SLICE)))
    return counted.where(F.col("_n") >= min_strikes).drop("_n")


def common_strikes(df: DataFrame) -> DataFrame:
    """Strikes with both sides, as a set operation."""
    side = lambda call: df.where(F.col("is_call") == call).select(*SLICE, "strike")
    return side(True).intersect(side(False))


def front_expiry(df: DataFrame) -> DataFrame:
    """Nearest expiry strictly after the reference date, per (market, as_of)."""
    return (
        df.where(F.col("expiry") > F.col("as_of"))
        .groupBy("market", "as_of")
        .agg(F.min("expiry").alias("expiry"))
    )


def front_contract(df: DataFrame, month: str, today: Column) -> DataFrame:
    """smallest contract month not before today, else the smallest overall."""
    upcoming = F.min(F.when(F.col(month) >= today, F.col(month)))
    return df.groupBy("market").agg(F.coalesce(upcoming, F.min(month)).alias("front_month"))


def universe(df: DataFrame, price: Column, reach: Column, n_expiries: int = config.CHAIN_EXPIRIES) -> DataFrame:
    """First three expiries per market and strikes within reach of the underlying.

    Expiries are made distinct first, so ranking sees a handful of rows per
    market instead of every quote.
    """
    listed = df.select("market", "expiry").distinct()
    rank = F.row_number().over(Window.partitionBy("market").orderBy("expiry"))
    kept = listed.withColumn("_r", rank).where(F.col("_r") <= n_expiries).drop("_r")
    return df.where(F.abs(F.col("strike") - price) <= reach).join(kept, ["market", "expiry"], "left_semi")


def contract_grid(expiries: DataFrame, strikes: DataFrame) -> DataFrame:
    """Expiry x strike x side per market, as an equi-join on the market."""
    return (
        expiries.join(strikes, "market")
        .withColumn("right", F.explode(F.array(F.lit("C"), F.lit("P"))))
        .select("market", "expiry", "strike", "right")
    )


def with_spot(df: DataFrame, spots: DataFrame) -> DataFrame:
    """Latest visible close per market; chains without a positive spot are dropped.

    ``spots`` has one row per market and is counted before it is broadcast.
    """
    return df.join(checked_broadcast(durable(spots.where(F.col("spot") > 0))), "market")


def oi_summary(df: DataFrame, keys: list[str], min_oi: float = config.MIN_OI) -> DataFrame:
    """Call, put and total interest, put/call ratio, rows with interest >= 50."""
    call = F.coalesce(F.sum(F.when(F.col("is_call"), F.col("oi"))), F.lit(0.0))
    put = F.coalesce(F.sum(F.when(~F.col("is_call"), F.col("oi"))), F.lit(0.0))
    sums = df.groupBy(*keys).agg(
        call.alias("call_oi"), put.alias("put_oi"), F.count_if(F.col("oi") >= min_oi).alias("liquid_strike_count")
    )
    return sums.withColumn("total_oi", F.col("call_oi") + F.col("put_oi")).withColumn(
        "put_call_oi_ratio",
        F.when(F.col("call_oi") > 0, F.col("put_oi") / F.col("call_oi")).otherwise(F.lit(0.0)),
    )


def oi_features(summary: DataFrame) -> DataFrame:
    """D1, persisted form: three long feature rows per (market, as_of), available on the day itself."""
    names = ["put_call_oi_ratio", "total_oi", "liquid_strike_count"]
    day = F.col("as_of").cast("timestamp_ntz")
    cast = summary.select("market", day.alias("as_of"), day.alias("available_at"), *[F.col(n).cast("double").alias(n) for n in names])
    return cast.unpivot(["market", "as_of", "available_at"], names, "feature_name", "value").withColumn(
        "quality", F.lit("normal")
    )


def atm_strike(pairs: DataFrame, spot: Column) -> DataFrame:
    """strike nearest to spot per slice; the lower strike wins ties."""
    distance = F.abs(F.col("strike") - spot)
    return pairs.groupBy(*SLICE).agg(
        F.min_by(F.struct("strike", "call_mid"), F.struct(distance, F.col("strike"))).alias("_a")
    ).select(*SLICE, F.col("_a.strike").alias("atm_strike"), F.col("_a.call_mid").alias("atm_price"))


def call_monotonicity(pairs: DataFrame) -> DataFrame:
    """Call prices must not rise with strike; first violation per slice."""
    w = Window.partitionBy(*SLICE).orderBy("strike")
    steps = pairs.withColumn("prev_price", F.lag("call_mid").over(w)).withColumn(
        "prev_strike", F.lag("strike").over(w)
    )
    bad = F.col("call_mid") > F.col("prev_price")
    return (
        steps.groupBy(*SLICE)
        .agg(
            F.coalesce(F.bool_or(bad), F.lit(False)).alias("has_arbitrage_violation"),
            F.min(F.when(bad, F.col("strike"))).alias("first_violation_strike"),
        )
    )


def parity_error(call: Column, put: Column, forward: Column, strike: Column, rate: Column, t: Column) -> Column:
    """H6: |(C - P) - (F - K) e^{-rT}|."""
    return F.abs((call - put) - (forward - strike) * F.exp(-rate * t))
