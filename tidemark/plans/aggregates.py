"""Group D: aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import chain, costs, drift, experiments, features, flows, metrics, quality
from tidemark.operators.density import with_ivs
from tidemark.plans.joins import MARKET_VALUES, paired
from tidemark.plans.landing import store
from tidemark.plans.registry import query, r6
from tidemark.sources import journals, markets, tables


def spot() -> Column:
    return F.lit(tables.CHAIN_FORWARD)


def rate() -> Column:
    return F.lit(tables.CHAIN_RATE)


@query(
    "d1_oi_summary",
    """SELECT market, as_of, round(sum(oi) FILTER (is_call), 4) AS call_oi, round(sum(oi) FILTER (NOT is_call), 4) AS put_oi,
              count(*) FILTER (oi >= 50) AS liquid_strike_count, round(sum(oi), 4) AS total_oi,
              round(CASE WHEN sum(oi) FILTER (is_call) > 0 THEN sum(oi) FILTER (NOT is_call) / sum(oi) FILTER (is_call) ELSE 0 END, 6) AS put_call_oi_ratio
       FROM v_chain GROUP BY market, as_of""",
)
def d1(spark, d):
    found = chain.oi_summary(tables.chain(spark, d), ["market", "as_of"])
    return found.select(
        "market", "as_of", r6(F.col("call_oi"), 4).alias("call_oi"), r6(F.col("put_oi"), 4).alias("put_oi"),
        "liquid_strike_count", r6(F.col("total_oi"), 4).alias("total_oi"), r6(F.col("put_call_oi_ratio")).alias("put_call_oi_ratio"),
    )


@query(
    "d1b_oi_features",
    """WITH s AS (SELECT market, as_of, sum(oi) AS total_oi, count(*) FILTER (oi >= 50)::DOUBLE AS liquid_strike_count,
                  CASE WHEN sum(oi) FILTER (is_call) > 0 THEN sum(oi) FILTER (NOT is_call) / sum(oi) FILTER (is_call) ELSE 0 END AS put_call_oi_ratio
               FROM v_chain GROUP BY market, as_of)
       SELECT market, CAST(as_of AS TIMESTAMP) AS as_of, CAST(as_of AS TIMESTAMP) AS available_at, feature_name, round(value, 6) AS value, 'normal' AS quality
       FROM s UNPIVOT (value FOR feature_name IN (put_call_oi_ratio, total_oi, liquid_strike_count))""",
)
def d1b(spark, d):
    """D1 as stored: three features a market and day, available on the day."""
    found = chain.oi_features(chain.oi_summary(tables.chain(spark, d), ["market", "as_of"]))
    return found.withColumn("value", r6(F.col("value")))


def implied(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with both implied volatilities and the multiplier of a registered market."""
    names = F.array(*[F.lit(r[0]) for r in config.MARKETS])
    number = F.substring("market", 2, 20).cast("int")
    pairs = paired(spark, d).withColumn("symbol", F.element_at(names, (F.pmod(number, F.lit(14)) + 1).cast("int")))
    dim = markets.market_dim(spark).select("symbol", "multiplier")
    priced = pairs.join(F.broadcast(dim), "symbol")
    t = F.datediff("expiry", "as_of") / F.lit(365.0)
    return with_ivs(priced, spot(), rate(), t)


_PDF = "0.3989422804014327 * exp(-d1 * d1 / 2.0)"
_FLOW_SQL = f"""
WITH base AS (SELECT p.*, m.multiplier,
        (ln(100.0::double / strike) + 0.5 * sigma * sigma * t) / (sigma * sqrt(t)) AS d1,
        (ln(100.0::double / strike) + 0.5 * sigma * sigma * t) / (sigma * sqrt(t)) - sigma * sqrt(t) AS d2
     FROM v_pairs p JOIN {MARKET_VALUES} ON m.symbol = [{', '.join(repr(r[0]) for r in config.MARKETS)}][CAST(substr(market, 2) AS INTEGER) % 14 + 1]),
g AS (SELECT *, exp(-0.05 * t) * {_PDF} / (100.0 * sigma * sqrt(t)) AS gamma, -exp(-0.05 * t) * {_PDF} * d2 / sigma AS vanna,
             -exp(-0.05 * t) * {_PDF} * (2 * 0.05 * t - d2 * sigma * sqrt(t)) / (2 * t * sigma * sqrt(t)) AS charm FROM base),
s AS (SELECT market, as_of, expiry, count(*) FILTER ((call_oi >= 50 OR put_oi >= 50) AND spread <= 0.20) AS liquid_strike_count,
             sum(gamma * (call_oi - put_oi) * multiplier * 100.0) AS gex, sum(vanna * (call_oi - put_oi) * multiplier * 100.0) AS vanna_flow,
             sum(charm * (call_oi - put_oi) * multiplier) AS charm_flow FROM g GROUP BY 1, 2, 3)
"""


@query(
    "d2_greeks_flow",
    _FLOW_SQL
    + """SELECT market, as_of, expiry, liquid_strike_count, CASE WHEN liquid_strike_count >= 8 THEN 'full' ELSE 'degraded' END AS quality,
           round(CASE WHEN liquid_strike_count >= 8 THEN gex ELSE 0 END, 2) + 0.0 AS gex,
           round(CASE WHEN liquid_strike_count >= 8 THEN vanna_flow ELSE 0 END, 2) + 0.0 AS vanna_flow,
           round(CASE WHEN liquid_strike_count >= 8 THEN charm_flow ELSE 0 END, 2) + 0.0 AS charm_flow FROM s""",
)
def d2(spark, d):
    found = flows.greeks_flow(implied(spark, d), spot(), rate(), F.col("multiplier"))
    return found.select(
        *chain.SLICE, "liquid_strike_count", "quality", *[r6(F.col(c), 2).alias(c) for c in ("gex", "vanna_flow", "charm_flow")]
    )


_BACK = """
WITH p AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted FROM v_predictions),
e AS (SELECT model, exp(sum(ln(1 + ret)) OVER (PARTITION BY model ORDER BY ts, event_id)) AS equity, ts, event_id FROM p),
dd AS (SELECT model, min(equity / peak - 1) AS max_drawdown FROM (SELECT model, equity, max(equity) OVER (PARTITION BY model ORDER BY ts, event_id) AS peak FROM e) GROUP BY model),
"""


@query(
    "d4_backtest_metrics",
    _BACK
    + """f AS (SELECT model, avg(ret) / stddev_samp(ret) * sqrt(252.0) AS sharpe_ratio, exp(sum(ln(1 + ret))) - 1 AS total_return,
             avg(CASE WHEN predicted = actual THEN 1.0 ELSE 0.0 END) AS hit_rate, count(*) FILTER (ret <> 0) AS n_trades,
             avg(ret) FILTER (ret <> 0) AS avg_return_per_trade FROM p GROUP BY model)
       SELECT model, round(sharpe_ratio, 5) AS sharpe_ratio, round(total_return, 5) AS total_return, round(hit_rate, 6) AS hit_rate,
              n_trades, round(avg_return_per_trade, 8) + 0.0 AS avg_return_per_trade, round(max_drawdown, 5) AS max_drawdown
       FROM f JOIN dd USING (model)""",
)
def d4(spark, d):
    found = metrics.backtest_metrics(predicted(spark, d), ["model"], ["ts", "event_id"])
    return found.select(
        "model", r6(F.col("sharpe_ratio"), 5).alias("sharpe_ratio"), r6(F.col("total_return"), 5).alias("total_return"),
        r6(F.col("hit_rate")).alias("hit_rate"), "n_trades", r6(F.col("avg_return_per_trade"), 8).alias("avg_return_per_trade"),
        r6(F.col("max_drawdown"), 5).alias("max_drawdown"),
    )


def predicted(spark: SparkSession, d: str) -> DataFrame:
    return tables.predictions(spark, d).withColumn("predicted", (F.col("p") >= 0.5).cast("int"))


@query(
    "d5_fold_sharpes",
    """SELECT model, "window", round(avg(ret) / stddev_samp(ret) * sqrt(252.0), 5) + 0.0 AS fold_sharpe FROM v_predictions GROUP BY model, "window" """,
)
def d5(spark, d):
    return metrics.fold_sharpes(tables.predictions(spark, d), ["model"], "window").withColumn(
        "fold_sharpe", r6(F.col("fold_sharpe"), 5)
    )


@query(
    "d6_robustness",
    """SELECT model, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS robustness
       FROM (SELECT model, "window", avg(ret - 0.0001::double) AS s FROM v_predictions GROUP BY 1, 2) GROUP BY model""",
)
def d6(spark, d):
    """Returns less a basis point, so that some folds fall below zero."""
    rows = tables.predictions(spark, d).withColumn("ret", F.col("ret") - 0.0001)
    return metrics.robustness(metrics.fold_sharpes(rows, ["model"], "window"), ["model"])


@query("d7_brier", "SELECT model, round(avg((p - actual) * (p - actual)), 6) AS calibration FROM v_predictions GROUP BY model")
def d7(spark, d):
    return metrics.brier(tables.predictions(spark, d), ["model"]).withColumn("calibration", r6(F.col("calibration")))


@query(
    "d8_simplicity",
    """SELECT event_id, round(least(greatest(1.0 / log2((event_id % 17 + 1) * (user_id + 1) + 1.0::double), 0.0), 1.0), 6) AS simplicity FROM events""",
)
def d8(spark, d):
    events = tables.table(spark, d, "events")
    score = metrics.simplicity(F.pmod("event_id", F.lit(17)) + 1, F.col("user_id") + 1)
    return events.select("event_id", r6(score).alias("simplicity"))


@query(
    "d9_composite_fitness",
    _BACK
    + """f AS (SELECT model, avg(ret) / stddev_samp(ret) * sqrt(252.0) AS sharpe, exp(sum(ln(1 + ret))) - 1 AS tr, avg((p - actual) * (p - actual)) AS brier FROM p GROUP BY model),
       r AS (SELECT model, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS robustness FROM (SELECT model, "window", avg(ret) AS s FROM p GROUP BY 1, 2) GROUP BY model),
       n AS (SELECT model, least(greatest((sharpe + 1) / 4, 0), 1) AS a, least(greatest((max_drawdown + 0.5) / 0.5, 0), 1) AS b,
                    1 - least(greatest(brier / 0.5, 0), 1) AS c, robustness AS r, least(greatest((tr + 0.5) / 1.5, 0), 1) AS t, 1 / log2(1701.0::double) AS s
             FROM f JOIN dd USING (model) JOIN r USING (model))
       SELECT model, round(0.25 * a + 0.20 * b + 0.15 * c + 0.15 * r + 0.15 * t + 0.10 * s, 5) AS composite, round(c, 5) AS norm_calibration FROM n""",
)
def d9(spark, d):
    rows = predicted(spark, d)
    back = metrics.backtest_metrics(rows, ["model"], ["ts", "event_id"])
    solid = metrics.robustness(metrics.fold_sharpes(rows, ["model"], "window"), ["model"])
    raw = back.join(solid, "model").join(metrics.brier(rows, ["model"]), "model").select(
        "model", F.col("sharpe_ratio").alias("sharpe"), F.col("max_drawdown").alias("drawdown"), "calibration", "robustness",
        F.col("total_return").alias("slippage_adjusted_return"), metrics.simplicity(F.lit(17), F.lit(100)).alias("simplicity"),
    )
    return metrics.fitness(raw, ["model"]).select(
        "model", r6(F.col("composite"), 5).alias("composite"), r6(F.col("norm_calibration"), 5).alias("norm_calibration")
    )


_REC = """
WITH rec AS (SELECT symbol, count(*) AS n_fills, avg(predicted_slippage) AS mean_predicted, avg(actual_slippage) AS mean_actual,
    avg(actual_slippage) - avg(predicted_slippage) AS bias, sqrt(avg((actual_slippage - predicted_slippage) * (actual_slippage - predicted_slippage))) AS rmse,
    quantile_cont(predicted_slippage, 0.5) AS median_predicted, quantile_cont(actual_slippage, 0.5) AS median_actual,
    corr(predicted_slippage, actual_slippage) AS correlation, avg(actual_slippage) / greatest(avg(predicted_slippage), 1e-10) AS pessimism_multiplier,
    quantile_cont(actual_slippage, 0.95) AS p95_actual, quantile_cont(predicted_slippage, 0.95) AS p95_predicted
    FROM v_fills GROUP BY symbol HAVING count(*) >= 10)
"""
_REC_COLUMNS = [
    "mean_predicted", "mean_actual", "bias", "rmse", "median_predicted", "median_actual", "correlation",
    "pessimism_multiplier", "p95_actual", "p95_predicted",
]


@query(
    "d10_slippage_reconcile",
    _REC + f"SELECT symbol, n_fills, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in _REC_COLUMNS)} FROM rec",
)
def d10(spark, d):
    return costs.reconcile(tables.fills(spark, d)).select(
        "symbol", "n_fills", *[r6(F.col(c), 5).alias(c) for c in _REC_COLUMNS]
    )


_GATE = """SELECT symbol, {b} AS max_bias, abs(bias) <= {b} AND correlation >= {c} AS calibrated,
    CASE WHEN abs(bias) > {b} THEN 'bias exceeds threshold' WHEN correlation < {c} THEN 'correlation below threshold' ELSE 'Model calibrated' END AS reason FROM rec"""


@query(
    "d11_calibration_gate",
    _REC + _GATE.format(b="0.5::double", c=0.3) + " UNION ALL " + _GATE.format(b="10.0::double", c=0.01),
)
def d11(spark, d):
    """Default thresholds, and a looser pair that shows the other answer."""
    pairs = F.array(*[F.struct(F.lit(bias).alias("max_bias"), F.lit(corr).alias("min_corr")) for bias, corr in ((0.5, 0.3), (10.0, 0.01))])
    report = costs.reconcile(tables.fills(spark, d)).select("*", F.inline(pairs))  # both from one reading
    found = costs.calibration_gate(report, F.col("max_bias"), F.col("min_corr"))
    return found.select("symbol", "max_bias", "calibrated", "reason")


_EDGES = ", ".join(f"quantile_cont(x, {i / 10!r}) FILTER (NOT is_current) AS e{i}" for i in range(1, 10))
_BIN = " + ".join(f"CAST(x >= e{i} AS INTEGER)" for i in range(1, 10))
_PSI = f"""
edges AS (SELECT feature, {_EDGES}, count(*) FILTER (NOT is_current) AS tb, count(*) FILTER (is_current) AS tc FROM v_drift GROUP BY feature),
cells AS (SELECT feature, {_BIN} AS bin, count(*) FILTER (NOT is_current) AS b, count(*) FILTER (is_current) AS c, any_value(tb) AS tb, any_value(tc) AS tc
          FROM v_drift JOIN edges USING (feature) GROUP BY feature, bin),
full_cells AS (SELECT feature, bin, coalesce(b, 0) AS b, coalesce(c, 0) AS c, e.tb, e.tc FROM (SELECT feature, tb, tc, unnest(range(0, 10)) AS bin FROM edges) e LEFT JOIN (SELECT feature, bin, b, c FROM cells) USING (feature, bin)),
shares AS (SELECT feature, (b + 0.0001) / (tb + 0.001) AS bp, (c + 0.0001) / (tc + 0.001) AS cp FROM full_cells),
psi AS (SELECT feature, sum((cp - bp) * ln(cp / bp)) AS psi FROM shares GROUP BY feature)"""
_KS = """
uniq AS (SELECT feature, x, count(*) FILTER (NOT is_current) AS b, count(*) FILTER (is_current) AS c FROM v_drift GROUP BY 1, 2),
cum AS (SELECT feature, sum(b) OVER (PARTITION BY feature ORDER BY x)::double AS cb, sum(c) OVER (PARTITION BY feature ORDER BY x)::double AS cc,
               sum(b) OVER (PARTITION BY feature)::double AS nb, sum(c) OVER (PARTITION BY feature)::double AS nc FROM uniq),
stat AS (SELECT feature, max(abs(cb / nb - cc / nc)) AS ks_stat, any_value(nb) AS nb, any_value(nc) AS nc FROM cum GROUP BY feature),
ks AS (SELECT feature, ks_stat, CASE WHEN sqrt(nb * nc / (nb + nc)) * ks_stat < 0.2 THEN 1.0 ELSE least(greatest(
         list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * nb * nc / (nb + nc) * ks_stat * ks_stat))), 0.0), 1.0) END AS ks_pvalue FROM stat)"""


@query("d12_psi", f"WITH {_PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def d12(spark, d):
    return drift.psi(drift.value_profile(tables.drift_samples(spark, d))).withColumn("psi", r6(F.col("psi")))


@query(
    "d13_ks_test",
    f"WITH {_KS} SELECT feature, round(ks_stat, 6) AS ks_stat, round(ks_pvalue, 5) AS ks_pvalue, ks_pvalue < 0.05 AS ks_drift FROM ks",
)
def d13(spark, d):
    found = drift.ks(drift.value_profile(tables.drift_samples(spark, d)))
    return found.select("feature", r6(F.col("ks_stat")).alias("ks_stat"), r6(F.col("ks_pvalue"), 5).alias("ks_pvalue"), "ks_drift")


# the hit-rate, drawdown and Sharpe flags need a baseline per model
_BASELINE = {"click": 4.0, "view": 0.1, "signup": 4.0, "purchase": 0.1, "error": 0.1}
_BASE_SQL = "CASE model " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _BASELINE.items()) + " END"
_PERF = (
    _BACK
    + f"""perf AS (SELECT model, avg(ret) / stddev_samp(ret) * sqrt(252.0) AS sharpe_ratio, max_drawdown,
        avg(CASE WHEN predicted = actual THEN 1.0 ELSE 0.0 END) AS hit_rate, avg((p - actual) * (p - actual)) AS calibration,
        {_BASE_SQL} AS baseline FROM p JOIN dd USING (model) GROUP BY model, max_drawdown),
     flags AS (SELECT *, sharpe_ratio < baseline * 0.5 AS sharpe_degraded, max_drawdown < -0.15 AS drawdown_alert, hit_rate < 0.45 AS hit_rate_degraded FROM perf)"""
)


def performance(spark: SparkSession, d: str) -> DataFrame:
    baseline = F.lit(None).cast("double")
    for k, v in _BASELINE.items():
        baseline = F.when(F.col("model") == k, v).otherwise(baseline)
    return drift.performance_drift(
        tables.predictions(spark, d), ["model"], ["ts", "event_id"], baseline
    )


@query(
    "d14_perf_drift",
    _PERF
    + """ SELECT model, round(sharpe_ratio, 5) AS sharpe_ratio, round(max_drawdown, 5) AS max_drawdown, round(hit_rate, 6) AS hit_rate,
              round(calibration, 6) AS calibration, sharpe_degraded, drawdown_alert, hit_rate_degraded FROM flags""",
)
def d14(spark, d):
    return performance(spark, d).select(
        "model", r6(F.col("sharpe_ratio"), 5).alias("sharpe_ratio"), r6(F.col("max_drawdown"), 5).alias("max_drawdown"),
        r6(F.col("hit_rate")).alias("hit_rate"), r6(F.col("calibration")).alias("calibration"),
        "sharpe_degraded", "drawdown_alert", "hit_rate_degraded",
    )


@query(
    "d15_feature_drift",
    f"""WITH {_PSI}, {_KS} SELECT feature, round(psi, 6) AS psi, round(ks_stat, 6) AS ks_stat, ks_pvalue < 0.05 AS ks_drift,
        psi >= 0.25 OR ks_pvalue < 0.05 AS drifted FROM psi JOIN ks USING (feature)""",
)
def d15(spark, d):
    return drift.feature_drift(tables.drift_samples(spark, d)).select(
        "feature", r6(F.col("psi")).alias("psi"), r6(F.col("ks_stat")).alias("ks_stat"), "ks_drift", "drifted"
    )


CUSUM_SQL = """
c AS (SELECT *, sum(x - 0.5) OVER w AS cp, sum(-x - 0.5) OVER w AS cn FROM v_metric WINDOW w AS (PARTITION BY metric ORDER BY ts, event_id)),
cusum AS (SELECT metric, ts, event_id, cp - least(0.0, min(cp) OVER w) AS s_pos, cn - least(0.0, min(cn) OVER w) AS s_neg
          FROM c WINDOW w AS (PARTITION BY metric ORDER BY ts, event_id))"""


def report(spark: SparkSession, d: str) -> DataFrame:
    """All models watch the same features; the stream of a model is its own metric."""
    feats = drift.feature_drift(tables.drift_samples(spark, d)).withColumn("model", F.col("feature"))
    stream = drift.cusum(tables.metric_stream(spark, d), ["metric"], ["ts", "event_id"])
    alerts = stream.groupBy("metric").agg(F.bool_or("alert").alias("alert")).select(F.col("metric").alias("model"), "metric", "alert")
    return drift.drift_report(performance(spark, d), feats, alerts, ["model"])


_REPORT = f"""{_PERF}, {_PSI}, {_KS}, {CUSUM_SQL},
alerts AS (SELECT metric AS model, bool_or(s_pos > 5 OR s_neg > 5) AS alert FROM cusum GROUP BY metric),
rep AS (SELECT f.*, k.psi >= 0.25 OR k.ks_pvalue < 0.05 AS drifted, alert FROM flags f
        JOIN (SELECT feature AS model, psi, ks_pvalue FROM psi JOIN ks USING (feature)) k USING (model) JOIN alerts USING (model))"""


@query(
    "d16_drift_report",
    _REPORT
    + """ SELECT model, sharpe_degraded, drawdown_alert, hit_rate_degraded, CASE WHEN drifted THEN model ELSE '' END AS drifted_features,
        CASE WHEN alert THEN model ELSE '' END AS streaming_alerts, sharpe_degraded OR drawdown_alert OR hit_rate_degraded OR drifted OR alert AS needs_diagnosis FROM rep""",
)
def d16(spark, d):
    return report(spark, d).select(
        "model", "sharpe_degraded", "drawdown_alert", "hit_rate_degraded", F.array_join("drifted_features", ",").alias("drifted_features"),
        F.array_join("streaming_alerts", ",").alias("streaming_alerts"), "needs_diagnosis",
    )


@query(
    "d17_diagnose",
    _REPORT
    + """, cls AS (SELECT *, CASE WHEN sharpe_degraded AND hit_rate_degraded AND calibration > 0.3 THEN 'overfitting'
             WHEN sharpe_degraded THEN 'performance_degradation' WHEN drawdown_alert AND alert AND contains(model, 'drawdown') THEN 'regime_change'
             WHEN hit_rate_degraded AND calibration > 0.3 THEN 'overfitting' ELSE 'performance_degradation' END AS primary_cause,
             CASE WHEN sharpe_degraded OR (hit_rate_degraded AND calibration > 0.3) THEN 0.7 ELSE 0.5 END::double AS confidence FROM rep)
       SELECT model, primary_cause, confidence, concat_ws('; ',
          CASE WHEN sharpe_degraded THEN 'Sharpe ratio degraded (current: ' || printf('%.3f', sharpe_ratio) || ')' END,
          CASE WHEN drawdown_alert THEN 'Drawdown alert triggered (max drawdown: ' || printf('%.3f', max_drawdown) || ')' END,
          CASE WHEN hit_rate_degraded THEN 'Hit rate degraded (current: ' || printf('%.3f', hit_rate) || ')' END,
          CASE WHEN drifted THEN '1 features drifted: ' || model END,
          CASE WHEN alert THEN 'Streaming alert for ' || model END) AS evidence,
          'hyperparameter,feature_remove' AS recommended FROM cls""",
)
def d17(spark, d):
    return drift.diagnose(report(spark, d)).select(
        "model", "primary_cause", F.col("confidence").cast("double").alias("confidence"), F.array_join("evidence", "; ").alias("evidence"),
        F.array_join("recommended", ",").alias("recommended"),
    )


@query(
    "d18_promotion_vote",
    """WITH s AS (SELECT model, "window", avg(p) AS score FROM v_predictions GROUP BY 1, 2),
       c AS (SELECT s.model, s."window", s.score AS candidate, t.score AS champion FROM s JOIN s t ON t.model = 'view' AND t."window" = s."window" WHERE s.model <> 'view')
       SELECT model, count(*) FILTER (candidate > champion) AS windows_won, count(*) = 5 AS valid, count(*) FILTER (candidate > champion) >= 3 AS promoted,
              'Candidate won ' || count(*) FILTER (candidate > champion) || ' of 5 windows (required: 3)' AS reason FROM c GROUP BY model""",
)
def d18(spark, d):
    """Every model challenges the view model on mean score."""
    scores = tables.predictions(spark, d).groupBy("model", "window").agg(F.avg("p").alias("score"))
    champion = scores.where(F.col("model") == "view").select("window", F.col("score").alias("champion"))
    pairs = scores.where(F.col("model") != "view").withColumnRenamed("score", "candidate").join(champion, "window")
    return metrics.promotion(pairs, ["model"])


@query(
    "d19_experiment_summary",
    """SELECT count(*) AS total, count(*) FILTER (promotion_decision = 'promoted') AS promoted, count(*) FILTER (promotion_decision = 'rejected') AS rejected,
              round_even(count(*) FILTER (promotion_decision = 'promoted') / count(*) * 100, 1) AS rate FROM v_experiments""",
)
def d19(spark, d):
    return experiments.summary(tables.experiments(spark, d))


@query(
    "d20_mutation_breakdown",
    """SELECT coalesce(CASE WHEN id % 9 = 0 THEN NULL WHEN id % 9 = 1 THEN NULL ELSE mutation_type END, 'unknown') AS mutation_type, count(*) AS n FROM v_experiments GROUP BY 1""",
)
def d20(spark, d):
    third = F.pmod("id", F.lit(9))
    holes = tables.experiments(spark, d).withColumn(
        "mutation_type", F.when(third == 0, None).when(third == 1, "").otherwise(F.col("mutation_type"))
    )
    return experiments.mutation_breakdown(holes)


@query(
    "d21_feature_stats",
    """SELECT CASE WHEN grouping(market) = 0 THEN 'market' WHEN grouping(feature_name) = 0 THEN 'feature' ELSE 'all' END AS kind, coalesce(market, feature_name) AS name, count(*) AS n_rows
       FROM v_store GROUP BY GROUPING SETS ((market), (feature_name), ())""",
)
def d21(spark, d):
    return features.store_stats(store(spark, d))


@query(
    "d22_latest_features",
    """SELECT feature_name, arg_max(value, (available_at, as_of, market)) AS value, 'normal' AS quality, max(available_at) AS last_updated
       FROM v_store GROUP BY feature_name ORDER BY last_updated DESC, feature_name LIMIT 50""",
)
def d22(spark, d):
    return features.latest(store(spark, d).withColumn("quality", F.lit("normal")))


@query(
    "d23_journal_counts",
    "SELECT 'fills' AS journal, count(*) AS n FROM v_fills UNION ALL SELECT 'experiments', count(*) FROM v_experiments",
)
def d23(spark, d):
    return experiments.journal_counts(tables.fills(spark, d), tables.experiments(spark, d))


@query(
    "d24_latest_promoted",
    """SELECT id, CAST(json_extract_string(results, '$.k') AS BIGINT) AS k, created_at FROM v_experiments
       WHERE promotion_decision = 'promoted' ORDER BY created_at DESC, id DESC LIMIT 1""",
)
def d24(spark, d):
    log = journals.decode_experiments(tables.experiments(spark, d))
    return experiments.latest_promoted(log).select("id", F.col("results")["k"].cast("long").alias("k"), "created_at")


_OPTQ = """
oq AS (SELECT market, as_of, expiry, count(*) FILTER (combined_oi >= 50 AND spread <= 0.0801) AS liquid_strike_count, count(*) AS total_strikes,
      coalesce(bool_or(call_mid > prev), false) AS has_arbitrage_violation, max(abs((call_mid - put_mid) - (100.0 - strike) * exp(-0.05::double * 0.25))) AS parity
      FROM (SELECT *, lag(call_mid) OVER (PARTITION BY market, as_of, expiry ORDER BY strike) AS prev FROM v_pairs) GROUP BY 1, 2, 3)"""


def options_report(spark: SparkSession, d: str) -> DataFrame:
    # the spread bound lies between the quoted widths, so float noise cannot flip a strike
    return quality.options_quality(paired(spark, d), spot(), max_spread=0.0801)


@query(
    "d25_options_quality",
    f"""WITH {_OPTQ} SELECT market, as_of, expiry, liquid_strike_count, total_strikes, has_arbitrage_violation,
        round(parity, 6) AS put_call_parity_max_error, concat_ws(',', CASE WHEN has_arbitrage_violation THEN 'call price arbitrage' END,
        CASE WHEN liquid_strike_count < 8 THEN 'too few liquid strikes' END) AS warnings FROM oq""",
)
def d25(spark, d):
    return options_report(spark, d).select(
        *chain.SLICE, "liquid_strike_count", "total_strikes", "has_arbitrage_violation",
        r6(F.col("put_call_parity_max_error")).alias("put_call_parity_max_error"), F.array_join("warnings", ",").alias("warnings"),
    )


def updates(spark: SparkSession, d: str) -> DataFrame:
    """Segments are markets; the three flag families of the feature table are the sources."""
    source = (
        F.when(F.col("feature_name").isin("AF", "AO"), "futures").when(F.col("feature_name").isin("NF", "NO"), "options").otherwise("cot")
    )
    return store(spark, d).select("market", source.alias("source"), "available_at")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """The market dimension: a segment without any update is stale, not absent."""
    return tables.table(spark, d, "customer").select(F.col("c_mktsegment").alias("market"))


NOW = "2001-11-05 12:00:00"
_STALE = f"""
upd AS (SELECT market, CASE WHEN feature_name IN ('AF','AO') THEN 'futures' WHEN feature_name IN ('NF','NO') THEN 'options' ELSE 'cot' END AS source, available_at FROM v_store),
last AS (SELECT market, source, max(available_at) AS last_update FROM upd GROUP BY 1, 2),
src AS (SELECT market, source, threshold_days FROM (SELECT DISTINCT c_mktsegment AS market FROM customer), (VALUES ('futures', 1), ('options', 1), ('cot', 7)) AS t(source, threshold_days)),
gaps AS (SELECT src.*, last_update, CASE WHEN last_update IS NULL THEN NULL WHEN source = 'cot' THEN date_diff('second', last_update, TIMESTAMP '{NOW}') / 86400.0::double
         ELSE (SELECT count(*)::double FROM (SELECT unnest(range(last_update + INTERVAL 1 DAY, TIMESTAMP '{NOW}' + INTERVAL 1 SECOND, INTERVAL 1 DAY)) AS dd) WHERE isodow(dd) < 6) END AS days_since_update
         FROM src LEFT JOIN last USING (market, source)),
stale AS (SELECT *, coalesce(days_since_update > threshold_days, true) AS is_stale FROM gaps)"""


def stale(spark: SparkSession, d: str) -> DataFrame:
    rows = updates(spark, d)
    return quality.staleness(rows, segments(spark, d), F.lit(NOW).cast("timestamp_ntz"))


@query("d26_staleness", f"WITH {_STALE} SELECT market, source, threshold_days, last_update, round(days_since_update, 6) AS days_since_update, is_stale FROM stale")
def d26(spark, d):
    return stale(spark, d).select(
        "market", "source", "threshold_days", "last_update", r6(F.col("days_since_update")).alias("days_since_update"), "is_stale"
    )


@query("d27_cot_freshness", f"WITH {_STALE} SELECT market, last_update, round(days_since_update, 6) AS days_since_update, is_stale FROM stale WHERE source = 'cot'")
def d27(spark, d):
    rows = updates(spark, d)
    found = quality.cot_freshness(rows, segments(spark, d), F.lit(NOW).cast("timestamp_ntz"))
    return found.select("market", "last_update", r6(F.col("days_since_update")).alias("days_since_update"), "is_stale")


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "d28_quality_report",
    f"""WITH {_STALE}, {_OPTQ}, o AS (SELECT [{', '.join(repr(s) for s in _SEG)}][CAST(substr(market, 2) AS INTEGER) % 5 + 1] AS market, min(liquid_strike_count) AS liquid_strike_count,
            bool_or(has_arbitrage_violation) AS has_arb FROM oq GROUP BY 1),
        s AS (SELECT market, bool_or(is_stale) AS any_stale, coalesce(string_agg(source, ',' ORDER BY source) FILTER (is_stale), '') AS stale_sources FROM stale GROUP BY market)
        SELECT market, any_stale, stale_sources, coalesce(liquid_strike_count, 0) AS liquid_strike_count,
               CASE WHEN any_stale THEN 'stale' WHEN coalesce(liquid_strike_count, 0) < 8 OR coalesce(has_arb, false) THEN 'degraded' ELSE 'healthy' END AS overall_status
        FROM s LEFT JOIN o USING (market)""",
)
def d28(spark, d):
    """Chains are assigned to segments by number."""
    names = F.array(*[F.lit(s) for s in _SEG])
    number = F.substring("market", 2, 20).cast("int")
    chains = options_report(spark, d).withColumn("market", F.element_at(names, (F.pmod(number, F.lit(5)) + 1).cast("int")))
    return quality.quality_report(stale(spark, d), chains).select(
        "market", "any_stale", "stale_sources", "liquid_strike_count", "overall_status"
    )


@query(
    "d29_adv_volatility",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ts DESC) AS k FROM v_bars),
       l AS (SELECT market, volume, ln(close / lag(close) OVER (PARTITION BY market ORDER BY ts)) AS lr FROM r WHERE k <= 20)
       SELECT market, round(avg(volume), 6) AS adv, round(stddev_pop(lr), 6) AS volatility FROM l GROUP BY market""",
)
def d29(spark, d):
    found = costs.adv_volatility(tables.bars(spark, d))
    return found.select("market", r6(F.col("adv")).alias("adv"), r6(F.col("volatility")).alias("volatility"))


@query(
    "d30_fill_performance",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC, order_id DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM v_fills),
       f AS (SELECT symbol, direction, (fill_price - order_price) / greatest(order_price, 1e-10) * direction AS ret FROM r WHERE k <= 30)
       SELECT symbol, count(*) AS n_fills, round(avg(ret), 8) + 0.0 AS mean_return, round(stddev_pop(ret), 8) AS std_return,
              round(avg(ret) / greatest(stddev_pop(ret), 1e-10), 5) + 0.0 AS baseline_sharpe, round(avg(CASE WHEN (direction > 0) = (ret > 0) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
       FROM f GROUP BY symbol""",
)
def d30(spark, d):
    found = costs.fill_performance(tables.fills(spark, d), tables.FILL_ORDER)
    return found.select(
        "symbol", "n_fills", r6(F.col("mean_return"), 8).alias("mean_return"), r6(F.col("std_return"), 8).alias("std_return"),
        r6(F.col("baseline_sharpe"), 5).alias("baseline_sharpe"), r6(F.col("hit_rate")).alias("hit_rate"),
    )


@query(
    "d31_slippage_pairs",
    """SELECT symbol, timestamp, round(predicted_slippage, 9) AS predicted_slippage, round(actual_slippage, 9) + 0.0 AS actual_slippage
       FROM v_fills WHERE timestamp >= TIMESTAMP '1998-01-01'""",
)
def d31(spark, d):
    found = costs.slippage_pairs(tables.fills(spark, d), tables.FILL_ORDER, since="1998-01-01")
    return found.select(
        "symbol", "timestamp", r6(F.col("predicted_slippage"), 9).alias("predicted_slippage"),
        r6(F.col("actual_slippage"), 9).alias("actual_slippage"),
    )
