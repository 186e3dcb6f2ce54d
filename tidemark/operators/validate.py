"""Row validation: every row gets its list of broken rules, nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAR_RULES = {
    "open<=0": "open <= 0",
    "high<=0": "high <= 0",
    "low<=0": "low <= 0",
    "close<=0": "close <= 0",
    "volume<0": "volume < 0",
    "high<low": "high < low",
    "close_outside_range": "close < low OR close > high",
}
QUOTE_RULES = {
    "strike<=0": "strike <= 0",
    "bid<0": "bid < 0",
    "inverted": "ask < bid AND ask > 0",
}
COT_RULES = {
    f"{c}<0": f"{c} < 0"
    for c in (
        "managed_money_long",
        "managed_money_short",
        "producer_long",
        "producer_short",
        "swap_long",
        "swap_short",
        "total_oi",
    )
}


def with_reasons(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Adds ``reasons``: names of the broken rules, in rule order.

    A row is valid only where every rule is known to hold: a rule that a null leaves undecided is a reason of its own.
    """
    flags = [
        F.when(F.expr(rule), F.lit(name)).when(F.expr(rule).isNull(), F.lit(f"null: {name}"))
        for name, rule in rules.items()
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*flags)))


def split(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and quarantined rows with their reasons."""
    checked = with_reasons(df, rules)
    clean = checked.where(F.size("reasons") == 0).drop("reasons")
    return clean, checked.where(F.size("reasons") > 0)


def summary(df: DataFrame, rules: dict[str, str], keys: list[str]) -> DataFrame:
    """Rows seen, kept and dropped per key, with a count per rule, in one pass."""
    broken = [F.expr(rule) for rule in rules.values()]
    bad: Column = F.coalesce(broken[0], F.lit(True))
    for b in broken[1:]:
        bad = bad | F.coalesce(b, F.lit(True))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~bad).alias("n_valid"),
        F.count_if(bad).alias("n_dropped"),
        *[F.count_if(b).alias("n_" + _slug(name)) for name, b in zip(rules, broken)],
    )


def _slug(name: str) -> str:
    return name.replace("<=0", "_not_positive").replace("<0", "_negative").replace("<", "_below_")
