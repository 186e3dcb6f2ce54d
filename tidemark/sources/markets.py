"""The market dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config

SCHEMA = (
    "symbol string, exchange string, cftc_code string, multiplier double, "
    "strike_range double, has_options boolean, tier int"
)


def market_dim(spark: SparkSession) -> DataFrame:
    """Fourteen constant rows: the one table that may always be broadcast."""
    return spark.createDataFrame(config.MARKETS, SCHEMA)


def active_markets(spark: SparkSession, tiers: Sequence[int]) -> DataFrame:
    return market_dim(spark).where(F.col("tier").isin(list(tiers))).orderBy("tier", "symbol")
