"""Per-row quote and price rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_default(value: Column, default: float = 0.0) -> Column:
    """Null or NaN becomes ``default``."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(default))


def usable(price: Column) -> Column:
    return price.isNotNull() & ~F.isnan(price) & (price > 0)


def mid_price(bid: Column, ask: Column) -> Column:
    """Midpoint, 0 when both sides are empty."""
    return F.when(bid + ask > 0, (bid + ask) / 2.0).otherwise(F.lit(0.0))


def spread_pct(bid: Column, ask: Column, mid: Column) -> Column:
    """Spread over mid, 1 when there is no mid."""
    return F.when(mid > 1e-12, (ask - bid) / mid).otherwise(F.lit(1.0))


def first_usable(*prices: Column) -> Column:
    return F.coalesce(*[F.when(usable(p), p) for p in prices])


def underlying_price(last: Column, close: Column, bid: Column, ask: Column) -> Column:
    """Last, then close, then midpoint of a two-sided quote."""
    both = F.when(usable(bid) & usable(ask), (bid + ask) / 2.0)
    return first_usable(last, close, both)


def snapshot_price(bid: Column, ask: Column, last: Column, close: Column) -> Column:
    """B9, order side: midpoint of a two-sided quote, then last, then close."""
    return F.coalesce(
        F.when(usable(bid) & usable(ask), (bid + ask) / 2.0), first_usable(last, close)
    )


def snapshot_spread(bid: Column, ask: Column, price: Column, fallback: float = 0.002) -> Column:
    """Quoted spread, or 0.2 % of the price without a two-sided quote."""
    return F.when(usable(bid) & usable(ask), ask - bid).otherwise(price * fallback)
