"""Groups E, F and G: ordered computations, top-n and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import chain, costs, density, drift, experiments, features, machines, returns, signals
from tidemark.plans.aggregates import CUSUM_SQL
from tidemark.plans.joins import paired
from tidemark.plans.landing import _LISTED, listed, reports, store
from tidemark.plans.registry import query, r6
from tidemark.sources import journals, tables

@query("e1_simple_return", "SELECT market, ts, round(ret, 6) + 0.0 AS ret FROM v_returns")
def e1(spark, d):
    return returns.simple_returns(tables.bars(spark, d)).select("market", "ts", r6(F.col("ret")).alias("ret"))


@query(
    "e2_rolling_vol",
    """WITH l AS (SELECT market, ts, row_number() OVER w - 1 AS bar_idx, ln(close) - ln(lag(close) OVER w) AS lr FROM v_bars WINDOW w AS (PARTITION BY market ORDER BY ts))
       SELECT market, ts, round(CASE WHEN bar_idx < 2 THEN 0.02 ELSE stddev_samp(lr) OVER (PARTITION BY market ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END, 6) AS rolling_vol FROM l""",
)
def e2(spark, d):
    return returns.rolling_vol(tables.bars(spark, d)).select("market", "ts", r6(F.col("rolling_vol")).alias("rolling_vol"))


@query(
    "e3_binary_target",
    """SELECT market, ts, CASE WHEN nxt IS NULL THEN NULL WHEN nxt > close THEN 1 ELSE 0 END AS target
       FROM (SELECT *, lead(close, 5) OVER (PARTITION BY market ORDER BY ts) AS nxt FROM v_bars)""",
)
def e3(spark, d):
    return returns.binary_target(tables.bars(spark, d)).select("market", "ts", "target")


@query(
    "e4_equity_drawdown",
    """WITH e AS (SELECT model, ts, event_id, sum(ln(1 + ret)) OVER (PARTITION BY model ORDER BY ts, event_id) AS lg FROM v_predictions)
       SELECT model, ts, event_id, round(exp(lg), 5) AS equity, round(exp(lg - max(lg) OVER (PARTITION BY model ORDER BY ts, event_id)) - 1, 5) + 0.0 AS drawdown FROM e""",
)
def e4(spark, d):
    curve = returns.equity(tables.predictions(spark, d), ["model"], ["ts", "event_id"])
    return curve.select(
        "model", "ts", "event_id", r6(F.col("equity"), 5).alias("equity"), r6(F.col("drawdown"), 5).alias("drawdown")
    )


SENTIMENT_SQL = """
hist AS (SELECT market, report_date, managed_money_net, total_oi, list(managed_money_net) OVER w AS nets, list(total_oi) OVER w AS ois
         FROM v_reports WINDOW w AS (PARTITION BY market ORDER BY report_date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)),
cnt AS (SELECT *, len(nets) AS n, len(list_filter(nets, lambda v: v < managed_money_net)) AS lo, len(list_filter(nets, lambda v: v <= managed_money_net)) AS hi,
               len(list_filter(ois, lambda v: v < total_oi)) AS olo, len(list_filter(ois, lambda v: v <= total_oi)) AS ohi FROM hist),
rnk AS (SELECT market, report_date, n, (lo + hi + CASE WHEN lo < hi THEN 1 ELSE 0 END) / (2.0 * n) AS pr, (olo + ohi + CASE WHEN olo < ohi THEN 1 ELSE 0 END) / (2.0 * n) AS orank,
               abs(managed_money_net) / greatest(total_oi, 1.0) AS conc FROM cnt),
sentiment AS (SELECT market, report_date, CASE WHEN n < 4 THEN 0.0 ELSE least(greatest(2.0 * pr - 1.0, -1.0), 1.0) END AS sentiment_score,
               CASE WHEN n < 4 THEN 0.0 ELSE least(greatest(0.6 * orank + 0.4 * least(conc * 5.0, 1.0), 0.0), 1.0) END AS sentiment_confidence FROM rnk)"""


@query(
    "e5_cot_sentiment",
    f"""WITH {SENTIMENT_SQL} SELECT market, report_date, round(sentiment_score, 6) + 0.0 AS sentiment_score, round(sentiment_confidence, 6) AS sentiment_confidence FROM sentiment""",
)
def e5(spark, d):
    return signals.cot_sentiment(reports(spark, d)).select(
        "market", "report_date", r6(F.col("sentiment_score")).alias("sentiment_score"),
        r6(F.col("sentiment_confidence")).alias("sentiment_confidence"),
    )


@query(
    "e6_divergence_zscore",
    """WITH r AS (SELECT market, ts, (close - open) / open AS raw FROM v_bars),
       z AS (SELECT *, count(raw) OVER w AS n, avg(raw) OVER w AS m, stddev_pop(raw) OVER w AS s FROM r WINDOW w AS (PARTITION BY market ORDER BY ts ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING))
       SELECT market, ts, round(CASE WHEN n >= 10 AND s >= 1e-12 THEN (raw - m) / s ELSE raw END, 5) + 0.0 AS magnitude FROM z""",
)
def e6(spark, d):
    rows = tables.bars(spark, d).select("market", "ts", ((F.col("close") - F.col("open")) / F.col("open")).alias("raw"))
    return signals.zscore(rows, ["market"], ["ts"], "raw").select("market", "ts", r6(F.col("magnitude"), 5).alias("magnitude"))


@query(
    "e7_call_monotonicity",
    """WITH p AS (SELECT market, as_of, expiry, strike, call_mid + CASE WHEN CAST(strike AS INTEGER) % 14 = CAST(substr(market, 2) AS INTEGER) % 20 THEN 3 ELSE 0 END AS call_mid FROM v_pairs),
       s AS (SELECT *, lag(call_mid) OVER (PARTITION BY market, as_of, expiry ORDER BY strike) AS prev FROM p)
       SELECT market, as_of, expiry, coalesce(bool_or(call_mid > prev), false) AS has_arbitrage_violation, min(strike) FILTER (call_mid > prev) AS first_violation_strike FROM s GROUP BY 1, 2, 3""",
)
def e7(spark, d):
    """Some strikes are lifted so that violations occur."""
    number = F.pmod(F.substring("market", 2, 20).cast("int"), F.lit(20))
    lift = F.when(F.pmod(F.col("strike").cast("int"), F.lit(14)) == number, 3.0).otherwise(0.0)
    return chain.call_monotonicity(paired(spark, d).withColumn("call_mid", F.col("call_mid") + lift))


@query(
    "e8_cusum_batch",
    f"WITH {CUSUM_SQL} SELECT metric, ts, event_id, round(s_pos, 6) + 0.0 AS s_pos, round(s_neg, 6) + 0.0 AS s_neg, s_pos > 5 OR s_neg > 5 AS alert FROM cusum",
)
def e8(spark, d):
    found = drift.cusum(tables.metric_stream(spark, d), ["metric"], ["ts", "event_id"])
    return found.select("metric", "ts", "event_id", r6(F.col("s_pos")).alias("s_pos"), r6(F.col("s_neg")).alias("s_neg"), "alert")


@query(
    "e9_walk_forward_folds",
    """WITH b AS (SELECT market, ts, row_number() OVER (PARTITION BY market ORDER BY ts) - 1 AS row_idx, count(*) OVER (PARTITION BY market) AS n FROM v_bars),
       f AS (SELECT *, 252 + 63 * fold AS te FROM b, (SELECT unnest(range(0, 5)) AS fold))
       SELECT market, ts, row_idx, CAST(fold AS INTEGER) AS fold, CASE WHEN row_idx < te THEN 'train' ELSE 'test' END AS role FROM f
       WHERE te + 68 <= n AND (row_idx < te OR (row_idx >= te + 5 AND row_idx < te + 68))""",
)
def e9(spark, d):
    return returns.folds(tables.bars(spark, d)).select("market", "ts", "row_idx", "fold", "role")


@query(
    "e10_equity_ffill",
    """SELECT metric, ts, event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY metric ORDER BY ts, event_id), 1.0) AS v_filled
       FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN x END AS v FROM v_metric)""",
)
def e10(spark, d):
    sparse = tables.metric_stream(spark, d).withColumn("v", F.when(F.pmod("event_id", F.lit(3)) == 0, F.col("x")))
    return returns.carry_forward(sparse, ["metric"], ["ts", "event_id"], "v", 1.0).select(
        "metric", "ts", "event_id", "v_filled"
    )


def _gradient_sql(value: str, last: str, h: str = "2.0") -> str:
    return (
        f"CASE WHEN grid_i = 0 THEN (lead({value}) OVER w - {value}) / {h} WHEN grid_i = {last} THEN ({value} - lag({value}) OVER w) / {h} "
        f"ELSE (lead({value}) OVER w - lag({value}) OVER w) / (2 * {h}) END"
    )


@query(
    "e11_second_derivative",
    f"""WITH g AS (SELECT market, as_of, expiry, strike, call_mid, CAST((strike - min(strike) OVER s) / 2 AS INTEGER) AS grid_i, count(*) OVER s - 1 AS top
              FROM v_pairs WINDOW s AS (PARTITION BY market, as_of, expiry)),
        a AS (SELECT *, {_gradient_sql('call_mid', 'top')} AS g1 FROM g WINDOW w AS (PARTITION BY market, as_of, expiry ORDER BY grid_i))
        SELECT market, as_of, expiry, strike, round({_gradient_sql('g1', 'top')}, 6) + 0.0 AS d2 FROM a WINDOW w AS (PARTITION BY market, as_of, expiry ORDER BY grid_i)""",
)
def e11(spark, d):
    """Every slice on its own grid: from its lowest strike, in steps of 2."""
    own = Window.partitionBy(*chain.SLICE)
    grid = paired(spark, d).withColumns(
        {
            "grid_i": ((F.col("strike") - F.min("strike").over(own)) / 2).cast("int"),
            "points": F.count(F.lit(1)).over(own),
            "h": F.lit(2.0),
        }
    )
    return density.second_derivative(grid, "call_mid", "d2", chain.SLICE, F.col("points")).select(*chain.SLICE, "strike", r6(F.col("d2")).alias("d2"))


@query(
    "e12_best_quote",
    """WITH two AS (SELECT market, as_of, expiry, strike, is_call, bid, ask, oi, quote_id AS seq FROM v_chain
           UNION ALL SELECT market, as_of, expiry, strike, is_call, CASE WHEN quote_id % 3 = 0 THEN bid * 1.001 WHEN quote_id % 3 = 1 THEN bid * 0.99 ELSE bid END, ask, oi + 1, quote_id + 1000000 FROM v_chain),
       s AS (SELECT *, (bid + ask) / 2 AS mid, (ask - bid) / ((bid + ask) / 2) AS sp FROM two)
       SELECT market, as_of, expiry, strike, is_call, round(mid, 6) + 0.0 AS mid, oi FROM s
       QUALIFY row_number() OVER (PARTITION BY market, as_of, expiry, strike, is_call ORDER BY sp, seq) = 1""",
)
def e12(spark, d):
    """Two snapshots: the second is tighter, wider or equal depending on the quote."""
    first = tables.chain(spark, d).select(*chain.SLICE, "strike", "is_call", "bid", "ask", "oi", F.col("quote_id").alias("seq"))
    kind = F.pmod("seq", F.lit(3))
    second = first.withColumn(
        "bid", F.when(kind == 0, F.col("bid") * 1.001).when(kind == 1, F.col("bid") * 0.99).otherwise(F.col("bid"))
    ).withColumn("oi", F.col("oi") + 1).withColumn("seq", F.col("seq") + 1_000_000)
    best = chain.best_quotes(first.unionByName(second), F.col("seq"))
    return best.select(*chain.SLICE, "strike", "is_call", r6(F.col("mid")).alias("mid"), "oi")


@query(
    "e13_front_expiry",
    f"""WITH listed AS ({_LISTED}), a AS (SELECT *, CAST(DATE '1998-01-01' + CAST(90 * (instrument_id % 8) AS INTEGER) AS DATE) AS as_of FROM listed)
        SELECT market, as_of, min(expiry) AS expiry FROM a WHERE expiry > as_of GROUP BY market, as_of""",
)
def e13(spark, d):
    dated = listed(spark, d).withColumn(
        "as_of", F.date_add(F.lit("1998-01-01").cast("date"), (F.pmod("instrument_id", F.lit(8)) * 90).cast("int"))
    )
    return chain.front_expiry(dated)


@query(
    "e14_rollback_hysteresis",
    """WITH RECURSIVE s AS (SELECT model, ts, event_id, CASE WHEN (0.5 - p) / 0.5 > 0.15 THEN 1 ELSE 0 END AS degraded, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS rn FROM v_predictions),
       f AS (SELECT model, CAST(0 AS BIGINT) AS rn, true AS armed, 0 AS dc, 0 AS hc, 0 AS cd, false AS fired FROM (SELECT DISTINCT model FROM s)
             UNION ALL
             SELECT model, rn, CASE WHEN cd0 > 0 THEN armed0 WHEN fire THEN false WHEN NOT armed0 AND h1 >= 5 THEN true ELSE armed0 END,
                    CASE WHEN cd0 > 0 THEN dc0 WHEN fire THEN 0 ELSE d1 END, CASE WHEN cd0 > 0 THEN hc0 WHEN fire OR (NOT armed0 AND h1 >= 5) THEN 0 ELSE h1 END,
                    CASE WHEN cd0 > 0 THEN cd0 - 1 WHEN fire THEN 10 ELSE 0 END, fire
             FROM (SELECT *, cd0 = 0 AND armed0 AND d1 >= 3 AS fire FROM (
                SELECT s.model, s.rn, f.armed AS armed0, f.dc AS dc0, f.hc AS hc0, f.cd AS cd0, CASE WHEN degraded = 1 THEN f.dc + 1 ELSE 0 END AS d1,
                       CASE WHEN degraded = 1 THEN 0 ELSE f.hc + 1 END AS h1 FROM f JOIN s ON s.model = f.model AND s.rn = f.rn + 1)))
       SELECT s.model, s.ts, s.event_id, s.degraded, f.fired FROM s JOIN f USING (model, rn)""",
)
def e14(spark, d):
    rows = tables.predictions(spark, d).select(
        "model", "ts", "event_id", F.col("p").alias("current_fitness"), F.lit(0.5).alias("champion_fitness")
    )
    return machines.rollback(rows, ["model"], ["ts", "event_id"]).select(
        "model", "ts", "event_id", "degraded", "fired"
    )


def _breaker_sql() -> str:
    """With one cooldown bar a breaker fires on every second bar of a run of breaches."""
    breaches = {
        "max_daily_loss": "ret * 4 < -0.02", "max_drawdown": "p - 0.1 < -0.05",
        "max_position_size": "p * 0.2 > 0.10", "max_single_trade_loss": "ret * 1.5 < -0.01",
    }
    marks = ", ".join(f"{expr} AS b_{n}" for n, expr in breaches.items())
    runs = ", ".join(f"rn - coalesce(max(CASE WHEN NOT b_{n} THEN rn END) OVER w, 0) AS k_{n}" for n in breaches)
    fires = ", ".join(f"b_{n} AND k_{n} % 2 = 1 AS f_{n}" for n in breaches)
    hits = ", ".join(f"f_{n} OR coalesce(lag(f_{n}) OVER w, false) AS {n}_triggered" for n in breaches)
    return f"""WITH a AS (SELECT model, ts, event_id, {marks}, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS rn FROM v_predictions),
        b AS (SELECT *, {runs} FROM a WINDOW w AS (PARTITION BY model ORDER BY rn)),
        c AS (SELECT model, ts, event_id, rn, {fires} FROM b), h AS (SELECT model, ts, event_id, {hits} FROM c WINDOW w AS (PARTITION BY model ORDER BY rn))
        SELECT *, NOT ({' OR '.join(f'{n}_triggered' for n in breaches)}) AS allowed FROM h"""


@query("e15_breaker_state", _breaker_sql())
def e15(spark, d):
    rows = tables.predictions(spark, d)
    values = {
        "max_daily_loss": F.col("ret") * 4, "max_drawdown": F.col("p") - 0.1,
        "max_position_size": F.col("p") * 0.2, "max_single_trade_loss": F.col("ret") * 1.5,
    }
    out = machines.breakers(rows, ["model"], ["ts", "event_id"], values)
    return out.select("model", "ts", "event_id", *[f"{n}_triggered" for n in values], "allowed")


@query(
    "f1_newest_n",
    """SELECT * FROM (SELECT timestamp, symbol, order_id, l_linenumber FROM v_fills ORDER BY timestamp DESC, order_id DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 1000)
       UNION ALL SELECT * FROM (SELECT created_at, mutation_type, id, NULL FROM v_experiments ORDER BY created_at DESC, id DESC LIMIT 100)""",
)
def f1(spark, d):
    newest = costs.fills_query(tables.fills(spark, d), tables.FILL_ORDER).select("timestamp", "symbol", "order_id", "l_linenumber")
    log = journals.decode_experiments(tables.experiments(spark, d))
    runs = experiments.experiments_query(log).select(
        F.col("created_at").alias("timestamp"), F.col("mutation_type").alias("symbol"), F.col("id").alias("order_id"),
        F.lit(None).cast("int").alias("l_linenumber"),
    )
    return newest.unionByName(runs)


@query(
    "f2_atm_strike",
    """SELECT market, as_of, expiry, arg_min(strike, (abs(strike - 99.0), strike)) AS atm_strike, round(arg_min(call_mid, (abs(strike - 99.0), strike)), 6) AS atm_price
       FROM v_pairs GROUP BY 1, 2, 3""",
)
def f2(spark, d):
    """A spot half-way between two strikes: the lower one wins."""
    return chain.atm_strike(paired(spark, d), F.lit(99.0)).withColumn("atm_price", r6(F.col("atm_price")))


@query(
    "f3_front_contract",
    """SELECT market, coalesce(min(expiry) FILTER (expiry >= CASE WHEN market < 'P' THEN '1999-05-01' ELSE '2009-01-01' END), min(expiry)) AS front_month FROM v_defs GROUP BY market""",
)
def f3(spark, d):
    """Later markets have no contract left, so the smallest overall is taken."""
    rows = tables.definitions(spark, d)
    today = F.when(F.col("market") < "P", "1999-05-01").otherwise("2009-01-01")
    return chain.front_contract(rows, "expiry", today)


@query(
    "g1_activity_feed",
    """WITH a AS (SELECT timestamp, 'Fill' AS type, CASE WHEN direction = 1 THEN 'BUY' ELSE 'SELL' END || printf(' %dx %s @ %.4f', n_contracts, symbol, fill_price) AS summary,
                printf('slippage %.4f', actual_slippage) AS status FROM v_fills ORDER BY timestamp DESC, order_id DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 5),
       b AS (SELECT created_at AS timestamp, 'Experiment' AS type, mutation_type || ' mutation' AS summary, promotion_decision AS status FROM v_experiments ORDER BY created_at DESC, id DESC LIMIT 5)
       SELECT * FROM a UNION ALL SELECT * FROM b ORDER BY timestamp DESC LIMIT 10""",
)
def g1(spark, d):
    return experiments.activity_feed(tables.fills(spark, d), tables.FILL_ORDER, tables.experiments(spark, d))


@query(
    "g2_strike_intersection",
    """SELECT market, as_of, expiry, strike FROM v_chain WHERE is_call INTERSECT SELECT market, as_of, expiry, strike FROM v_chain WHERE NOT is_call""",
)
def g2(spark, d):
    return chain.common_strikes(tables.chain(spark, d))


@query(
    "g3_distinct_lists",
    """SELECT 'market' AS list, market AS value FROM v_store UNION SELECT 'feature', feature_name FROM v_store UNION SELECT 'expiry', CAST(expiry AS VARCHAR) FROM v_chain""",
)
def g3(spark, d):
    rows = store(spark, d)
    tagged = lambda df, column, name: features.distinct_values(df, column).select(
        F.lit(name).alias("list"), F.col(column).cast("string").alias("value")
    )
    return (
        tagged(rows, "market", "market")
        .unionByName(tagged(rows, "feature_name", "feature"))
        .unionByName(tagged(tables.chain(spark, d), "expiry", "expiry"))
    )

