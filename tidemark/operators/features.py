"""Bitemporal feature store operators: long rows (market, feature_name, as_of, available_at, value)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators.ordered import Cut, running

PRIMARY_KEY = ["market", "feature_name", "as_of"]


def close_features(bars: DataFrame, batch_time: Column | None = None) -> DataFrame:
    """One close observation per bar, visible from the bar time (or the batch time)."""
    when = F.col("ts_event") if batch_time is None else batch_time
    return bars.select(
        "market",
        F.concat(F.lit("futures_close_"), F.col("symbol")).alias("feature_name"),
        when.alias("as_of"),
        when.alias("available_at"),
        F.col("close").alias("value"),
        F.lit("normal").alias("quality"),
    )


def cot_features(reports: DataFrame) -> DataFrame:
    """Four position columns to long rows, as of the report, visible from its release."""
    renamed = reports.select(
        "market",
        F.col("report_date").cast("timestamp_ntz").alias("as_of"),
        "available_at",
        *[F.col(source).alias(name) for name, source in config.COT_FEATURES.items()],
    )
    return renamed.unpivot(
        ["market", "as_of", "available_at"], list(config.COT_FEATURES), "feature_name", "value"
    ).withColumn("quality", F.lit("normal"))


def upsert(df: DataFrame, order: Column) -> DataFrame:
    """A3: last write wins per (market, feature, as_of).

    ``max_by`` combines on the map side, so many rewrites of one key do not
    meet in one task the way a ``row_number`` window would make them.
    """
    rest = [c for c in df.columns if c not in PRIMARY_KEY]
    last = df.groupBy(*PRIMARY_KEY).agg(
        F.max_by(F.struct(*rest), order).alias("_last")
    )
    return last.select(*PRIMARY_KEY, "_last.*")


def lookup(store: DataFrame, at: datetime | Column, market: str | None = None) -> DataFrame:
    """Per feature the visible row with the newest as_of; visible means available_at <= t."""
    t = at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz")
    visible = store.where(F.col("available_at") <= t)
    if market is not None:
        visible = visible.where(F.col("market") == market)
    return visible.groupBy("market", "feature_name").agg(
        F.max_by("value", "as_of").alias("value"), F.max("as_of").alias("as_of")
    )


def history(store: DataFrame, feature: str | None, start, end, market: str | None = None) -> DataFrame:
    """Observations with as_of inside [start, end], ordered."""
    rows = store.where(F.col("as_of").between(start, end))
    if feature is not None:
        rows = rows.where(F.col("feature_name") == feature)
    if market is not None:
        rows = rows.where(F.col("market") == market)
    return rows.orderBy("market", "feature_name", "as_of")


def matrix(
    store: DataFrame,
    probes: DataFrame,
    feature_names: Sequence[str],
    cell: Cut = None,
    tie_break: Column | None = None,
) -> DataFrame:
    """As-of join of (market, ts) probes with every feature, one wide row per probe.

    Observations and probes are merged into one time line per market.  Each
    feature is a running maximum of (as_of, value) over what became available
    so far, so one pass serves all features and there is no range join.  The
    time line of a large market is cut into counted cells (see ``ordered.running``),
    so a market that holds a third of all rows is shared by as many tasks as it has cells.
    Observations sort before probes at equal times: the boundary is visible.
    """
    seq = tie_break if tie_break is not None else F.lit(0)
    observed = store.where(F.col("feature_name").isin(list(feature_names))).select(
        "market",
        F.col("available_at").alias("ts"),
        F.lit(0).alias("is_probe"),
        "feature_name",
        F.struct(F.col("as_of"), seq.alias("seq"), F.col("value").alias("value")).alias("seen"),
    )
    asked = probes.select(
        "market",
        "ts",
        F.lit(1).alias("is_probe"),
        F.lit(None).cast("string").alias("feature_name"),
        F.lit(None).cast(observed.schema["seen"].dataType).alias("seen"),
    ).distinct()
    line = observed.unionByName(asked)
    seen = {name: F.when(F.col("feature_name") == name, F.col("seen")) for name in feature_names}
    return _as_of(line, seen, cell)


def wide_matrix(sources: Sequence[DataFrame], probes: DataFrame, names: Sequence[str], cell: Cut = None) -> DataFrame:
    """C2 from sources that hold several features in a row: (market, as_of, available_at, feature columns).

    A row of a source enters the time line once, whatever the number of its
    features, so nothing is unpivoted.  Each feature still takes the newest as_of
    of its own non-null values, ties to the larger value.
    """
    blank = F.lit(None).cast("struct<as_of: timestamp_ntz, value: double>")
    line = probes.select("market", "ts", F.lit(1).alias("is_probe"), *[blank.alias(f"_s{i}") for i in range(len(names))]).distinct()
    for source in sources:
        as_of = F.col("as_of").cast("timestamp_ntz")
        own = {n: F.when(F.col(n).isNotNull(), F.struct(as_of.alias("as_of"), F.col(n).cast("double").alias("value"))) for n in names if n in source.columns}
        seen = source.select(
            "market", F.col("available_at").alias("ts"), F.lit(0).alias("is_probe"), *[own.get(n, blank).alias(f"_s{i}") for i, n in enumerate(names)]
        )
        line = line.unionByName(seen)
    return _as_of(line, {name: F.col(f"_s{i}") for i, name in enumerate(names)}, cell)


def _as_of(line: DataFrame, seen: dict[str, Column], cell: Cut) -> DataFrame:
    """The running maximum of each feature's (as_of, ..., value) at the probes of a time line."""
    columns = {f"_f{i}": ("max", c) for i, c in enumerate(seen.values())}
    newest = running(line, ["market"], ["ts", "is_probe"], cell, columns)
    return newest.where(F.col("is_probe") == 1).select(
        "market", "ts", *[F.col(f"_f{i}.value").alias(name) for i, name in enumerate(seen)]
    )


def store_stats(store: DataFrame) -> DataFrame:
    """Rows of the store, of each market and of each feature, a row each (kind all, market, feature).

    Rows are counted per pair on the map side first; names stay rows, so no task gathers them.
    """
    pairs = store.groupBy("market", "feature_name").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.grouping("market") == 0, "market").when(F.grouping("feature_name") == 0, "feature").otherwise("all")
    sets = [[F.col("market")], [F.col("feature_name")], []]
    return pairs.groupingSets(sets, "market", "feature_name").agg(
        kind.alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")
    ).select("kind", F.coalesce("market", "feature_name").alias("name"), "n_rows")


def latest(store: DataFrame, market: str | None = None, limit: int = 50) -> DataFrame:
    """Per feature the row with the newest available_at (then as_of, then market)."""
    rows = store if market is None else store.where(F.col("market") == market)
    newest = rows.groupBy("feature_name").agg(
        F.max_by(
            F.struct("value", "quality", "available_at"),
            F.struct("available_at", "as_of", "market"),
        ).alias("_n")
    )
    return (
        newest.select(
            "feature_name",
            F.col("_n.value").alias("value"),
            F.col("_n.quality").alias("quality"),
            F.col("_n.available_at").alias("last_updated"),
        )
        .orderBy(F.desc("last_updated"), "feature_name")
        .limit(limit)
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct sorted values."""
    return df.select(column).distinct().orderBy(column)
