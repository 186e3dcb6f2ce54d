"""Distribution and performance drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import ordered
from tidemark.operators.metrics import sharpe
from tidemark.operators.ordered import CELL_ROWS, Cut, checked_broadcast, cumulative_counts, running
from tidemark.operators.returns import max_drawdown
from tidemark.session import durable

GRID = float(1 << 20)  # steps of the exact part of a CUSUM sum


def value_profile(samples: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Distinct values per feature with exact running counts of both samples.

    PSI and KS are both functions of this one table and read it several times,
    so it is written once and a drift check shuffles the samples once for both.
    """
    current = F.col("is_current")
    return durable(
        cumulative_counts(
            samples, ["feature"], "x", {"n_base": (~current).cast("long"), "n_cur": current.cast("long")}, cell_rows
        )
    )


def psi(
    profile: DataFrame, n_bins: int = config.PSI_BINS, epsilon: float = config.PSI_EPSILON
) -> DataFrame:
    """D12 from a value profile.

    Bin edges are linear-interpolation quantiles of the baseline, read off the
    running counts by rank; bins adapt to the number of distinct baseline
    values; a value falls in the bin given by the interior edges at or below it.
    """
    totals = profile.groupBy("feature").agg(
        F.sum("n_base").alias("_tb"), F.sum("n_cur").alias("_tc"), F.count_if(F.col("n_base") > 0).alias("_unique")
    )
    bins = totals.withColumn(
        "_bins", F.greatest(F.lit(2), F.least(F.lit(n_bins), F.col("_unique") - 1)).cast("int")
    )
    wanted = (
        bins.where(F.col("_tb") > 0)
        .withColumn("edge_no", F.explode(F.sequence(F.lit(1), F.col("_bins") - 1)))
        .withColumn("_pos", F.col("edge_no") / F.col("_bins") * (F.col("_tb") - 1))
    )
    # two order statistics around each quantile position, found by an equi-join
    # on the feature (at most nine edges per feature) and a rank condition
    first = F.col("cum_n_base") - F.col("n_base")
    holds = lambda rank: (F.col("n_base") > 0) & (first <= rank) & (rank < F.col("cum_n_base"))
    edges_in = wanted.groupBy("feature").agg(F.collect_list(F.struct("edge_no", "_pos")).alias("_wanted"))
    low = lambda w: F.floor(w["_pos"])
    high = lambda w: F.ceil(w["_pos"])
    hits = (
        profile.join(checked_broadcast(durable(edges_in)), "feature")
        .withColumn("_w", F.explode(F.filter("_wanted", lambda w: holds(low(w)) | holds(high(w)))))
        .groupBy("feature", F.col("_w.edge_no").alias("edge_no"))
        .agg(
            F.max(F.when(holds(F.floor("_w._pos")), F.col("x"))).alias("_lo"),
            F.max(F.when(holds(F.ceil("_w._pos")), F.col("x"))).alias("_hi"),
            F.max(F.col("_w._pos") - F.floor("_w._pos")).alias("_f"),
        )
    )
    edges = durable(
        hits.groupBy("feature").agg(
            F.sort_array(F.collect_list(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f"))).alias("_edges")
        )
    )
    binned = (
        profile.join(checked_broadcast(edges), "feature")
        .groupBy("feature", F.size(F.filter("_edges", lambda e: e <= F.col("x"))).alias("bin"))
        .agg(F.sum("n_base").alias("b"), F.sum("n_cur").alias("c"))
    )
    every = bins.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)))
    shares = every.join(binned, ["feature", "bin"], "left")
    smooth = lambda n, total: (F.coalesce(F.col(n), F.lit(0)) + epsilon) / (F.col(total) + epsilon * F.col("_bins"))
    b, c = smooth("b", "_tb"), smooth("c", "_tc")
    empty = (F.col("_tb") == 0) | (F.col("_tc") == 0)
    return shares.groupBy("feature").agg(
        F.sum(F.when(empty, F.lit(0.0)).otherwise((c - b) * F.log(c / b))).alias("psi")
    )


def kolmogorov_sf(stat: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample p-value; the series alternates and dies off fast."""
    lam = F.sqrt(n1 * n2 / (n1 + n2)) * stat
    # below 0.2 the series cannot be summed in doubles and the value is 1 anyway
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks(profile: DataFrame, alpha: float = config.KS_ALPHA) -> DataFrame:
    """D13 from a value profile: largest gap of the two distribution functions.

    Fewer than two values on a side give (false, 0, 1).
    """
    totals = profile.groupBy("feature").agg(F.sum("n_base").alias("n_base"), F.sum("n_cur").alias("n_cur"))
    shares = profile.select("feature", "cum_n_base", "cum_n_cur").join(checked_broadcast(durable(totals)), "feature")
    gap = F.abs(F.try_divide("cum_n_base", "n_base") - F.try_divide("cum_n_cur", "n_cur"))
    found = shares.groupBy("feature").agg(
        F.max(gap).alias("_d"), F.first("n_base").alias("n_base"), F.first("n_cur").alias("n_cur")
    )
    enough = (F.col("n_base") >= 2) & (F.col("n_cur") >= 2)
    return (
        found.withColumn("ks_stat", F.when(enough, F.col("_d")).otherwise(F.lit(0.0)))
        .withColumn(
            "ks_pvalue",
            F.when(enough, kolmogorov_sf(F.col("ks_stat"), F.col("n_base"), F.col("n_cur"))).otherwise(F.lit(1.0)),
        )
        .select("feature", "ks_stat", "ks_pvalue", (F.col("ks_pvalue") < alpha).alias("ks_drift"))
    )


def feature_drift(samples: DataFrame, psi_threshold: float = config.PSI_THRESHOLD, alpha: float = config.KS_ALPHA) -> DataFrame:
    """Drifted when PSI reaches the threshold or KS rejects."""
    profile = value_profile(samples)
    return psi(profile).join(ks(profile, alpha), "feature").withColumn(
        "drifted", (F.col("psi") >= psi_threshold) | F.col("ks_drift")
    )


def performance_drift(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    baseline_sharpe: Column,
    cell: Cut = None,
    ret: str = "ret",
    p: str = "p",
    actual: str = "actual",
    sharpe_factor: float = config.SHARPE_DEGRADATION,
    drawdown_limit: float = config.DRAWDOWN_ALERT,
    hit_rate_floor: float = config.HIT_RATE_FLOOR,
) -> DataFrame:
    """Metrics and the three degradation flags per model."""
    predicted = (F.col(p) >= 0.5).cast("int")
    miss = F.col(p) - F.col(actual)
    flat = rows.groupBy(*keys).agg(
        sharpe(F.col(ret)).alias("sharpe_ratio"),
        F.avg((predicted == F.col(actual)).cast("double")).alias("hit_rate"),
        F.avg(miss * miss).alias("calibration"),
    )
    joined = flat.join(max_drawdown(rows, keys, order, cell, ret), list(keys))
    return (
        joined.withColumn("sharpe_degraded", F.col("sharpe_ratio") < baseline_sharpe * sharpe_factor)
        .withColumn("drawdown_alert", F.col("max_drawdown") < drawdown_limit)
        .withColumn("hit_rate_degraded", F.col("hit_rate") < hit_rate_floor)
    )


def cusum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Cut = None,
    x: str = "x",
    target: float = 0.0,
    slack: float = config.CUSUM_SLACK,
    threshold: float = config.CUSUM_THRESHOLD,
) -> DataFrame:
    """Both one-sided sums in closed form."""
    up, down = F.col(x) - target - slack, -(F.col(x) - target) - slack
    return cusum_sums(df, keys, order, up, down, cell).withColumn(
        "alert", beyond(F.col("s_pos"), threshold) | beyond(F.col("s_neg"), threshold)
    )


def cusum_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], up: Column, down: Column, cell: Cut = None) -> DataFrame:
    """``s_pos`` and ``s_neg``: s = max(0, s + step), from 0, for two columns of steps.

    Unrolled this is C - min(0, running min of C) with C the running sum of steps, so a stretch of rows is known by two
    numbers, its sum and its least running sum.  Running windows replace the per-row recursion, and a key is
    shared by as many tasks as it has cells.

    C grows with the number of rows and s does not, so C is summed in two parts: multiples of 2**-20, whose sums are exact
    below 2**33, and the small rest.  Thus s does not depend on how many rows went before or how they were cut.
    """
    cut = ordered.counted_cells(df, keys, order) if cell is None else cell
    steps = {"_u": up, "_d": down}
    parts = {}
    for n, c in steps.items():
        small = F.abs(c) < float(1 << 31)
        coarse = F.when(small, F.rint(c * GRID) / GRID).otherwise(c)
        parts[f"{n}h"], parts[f"{n}l"] = ("sum", coarse), ("sum", F.when(small, c - coarse).when(c.isNotNull(), 0.0))
    sums = running(df, keys, order, cut, parts)
    at = lambda n: F.struct((F.col(f"{n}h") + F.col(f"{n}l")).alias("c"), F.col(f"{n}h").alias("h"), F.col(f"{n}l").alias("l"))
    lows = running(sums, keys, order, cut, {f"{n}m": ("min", F.when(F.col(f"{n}h").isNotNull(), at(n))) for n in steps})

    def over(n: str) -> Column:
        h, low = F.col(f"{n}h"), F.col(f"{n}m")
        rise = F.when(low["c"] < 0, (h - low["h"]) + (F.col(f"{n}l") - low["l"])).otherwise(h + F.col(f"{n}l"))
        return F.when(h.isNotNull(), F.greatest(rise, F.lit(0.0)))

    return lows.withColumn("s_pos", over("_u")).withColumn("s_neg", over("_d")).drop(*parts, *[f"{n}m" for n in steps])


def beyond(s: Column, threshold: float) -> Column:
    """Whether a sum lies above a threshold; a sum equal to it but for rounding (nine digits) does not."""
    return F.round(s, 9) > threshold


def drift_report(performance: DataFrame, features: DataFrame | None, alerts: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """needs_diagnosis is the OR of all flags.

    ``features`` carries (keys, feature, drifted) and ``alerts`` (keys, metric, alert);
    both are reduced to one row per key before the join.
    """
    keys = list(keys)
    report = performance
    if features is not None:
        drifted = features.where("drifted").groupBy(*keys).agg(F.sort_array(F.collect_set("feature")).alias("drifted_features"))
        report = report.join(drifted, keys, "left")
    else:
        report = report.withColumn("drifted_features", F.lit(None).cast("array<string>"))
    if alerts is not None:
        fired = alerts.where("alert").groupBy(*keys).agg(F.sort_array(F.collect_set("metric")).alias("streaming_alerts"))
        report = report.join(fired, keys, "left")
    else:
        report = report.withColumn("streaming_alerts", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<string>")
    report = report.withColumn("drifted_features", F.coalesce("drifted_features", empty)).withColumn(
        "streaming_alerts", F.coalesce("streaming_alerts", empty)
    )
    return report.withColumn(
        "needs_diagnosis",
        F.col("sharpe_degraded")
        | F.col("drawdown_alert")
        | F.col("hit_rate_degraded")
        | (F.size("drifted_features") > 0)
        | (F.size("streaming_alerts") > 0),
    )


def diagnose(report: DataFrame) -> DataFrame:
    """First rule that holds names the cause; evidence lists every raised flag."""
    overfit = F.col("hit_rate_degraded") & (F.col("calibration") > config.BRIER_OVERFIT)
    drawdown_stream = F.exists("streaming_alerts", lambda m: F.lower(m).contains("drawdown"))
    rules = [
        (F.size("drifted_features") >= 3, "feature_distribution_drift", 0.8),
        (F.col("sharpe_degraded") & overfit, "overfitting", 0.7),
        (F.col("sharpe_degraded"), "performance_degradation", 0.7),
        (F.col("drawdown_alert") & drawdown_stream, "regime_change", 0.6),
        (overfit, "overfitting", 0.7),
    ]
    cause = F.when(rules[0][0], rules[0][1])
    confidence = F.when(rules[0][0], rules[0][2])
    for condition, name, weight in rules[1:]:
        cause, confidence = cause.when(condition, name), confidence.when(condition, weight)
    said = config.EVIDENCE
    measured = {"sharpe_degraded": "sharpe_ratio", "drawdown_alert": "max_drawdown", "hit_rate_degraded": "hit_rate"}
    first_five = F.array_join(F.slice("drifted_features", 1, 5), ", ")
    evidence = F.concat(
        F.array_compact(
            F.array(
                *[F.when(F.col(flag), F.format_string(said[flag], F.col(value))) for flag, value in measured.items()],
                F.when(F.size("drifted_features") > 0, F.format_string(said["drifted_features"], F.size("drifted_features"), first_five)),
            )
        ),
        F.transform("streaming_alerts", lambda m: F.format_string(said["streaming_alerts"], m)),
    )
    mutations = F.create_map(
        *[c for k, v in config.CAUSE_MUTATIONS.items() for c in (F.lit(k), F.array(*[F.lit(x) for x in v]))]
    )
    return (
        report.withColumn("primary_cause", cause.otherwise("performance_degradation"))
        .withColumn("confidence", confidence.otherwise(0.5))
        .withColumn("evidence", evidence)
        .withColumn("recommended", F.element_at(mutations, F.col("primary_cause")))
        .withColumn(
            "reasoning",
            F.concat(
                F.format_string(config.REASONING[0], F.col("primary_cause"), F.col("confidence")),
                F.when(F.size("evidence") > 0, F.format_string(config.REASONING[1], F.array_join("evidence", "; "))).otherwise(config.REASONING[2]),
            ),
        )
    )
