"""Cost and sizing rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slippage(
    size: Column, volume: Column, spread: Column, volatility: Column, impact: float = 0.1
) -> Column:
    """Half the spread plus square-root impact."""
    return spread / 2.0 + F.lit(impact) * volatility * F.sqrt(size / F.greatest(volume, F.lit(1.0)))


def kelly(
    win_prob: Column,
    avg_win: Column,
    avg_loss: Column,
    fraction: float = 0.5,
    cap: float = 0.10,
) -> Column:
    """Fraction of the Kelly share, 0 without an edge, capped."""
    valid = (avg_loss > 0) & (win_prob > 0) & (win_prob < 1) & (avg_win > 0)
    ratio = avg_win / F.when(avg_loss > 0, avg_loss)
    share = (win_prob * ratio - (1.0 - win_prob)) / F.when(ratio > 0, ratio)
    return F.when(valid & (share > 0), F.least(share * fraction, F.lit(cap))).otherwise(F.lit(0.0))


def volume_cap(
    share: Column, capital: Column, contract_value: Column, volume: Column, max_share: float = 0.02
) -> Column:
    """Whole contracts from the capital share, at most 2 % of volume."""
    wanted = (share * capital / contract_value).cast("long")  # truncates toward zero
    ceiling = (volume * max_share).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(wanted, ceiling))


def round_to_tick(price: Column, tick: float) -> Column:
    """Half-even rounding to the tick grid; six decimals without a tick."""
    if tick <= 0:
        return F.bround(price, 6)
    return F.bround(F.bround(price / tick, 0) * tick, 10)
