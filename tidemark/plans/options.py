"""Group H (and D3): prices, volatilities, densities, signals, sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import dates, risk
from tidemark.functions.black76 import call_iv, put_iv, with_call_price, with_greeks
from tidemark.operators import chain, costs, density, features, signals
from tidemark.operators.chain import SLICE
from tidemark.operators.options_job import FLOWS, MOMENTS, option_features
from tidemark.plans import svi_sql
from tidemark.plans.aggregates import _FLOW_SQL, rate, spot
from tidemark.plans.joins import paired, weekly_probes
from tidemark.plans.landing import reports
from tidemark.plans.registry import query, r6
from tidemark.plans.windows import SENTIMENT_SQL
from tidemark.session import durable
from tidemark.sources import tables


def full_iv(spark: SparkSession, d: str) -> DataFrame:
    """Slices with fit points under the loose liquidity rule."""
    years = F.datediff("expiry", "as_of") / F.lit(365.0)
    ivs = density.with_ivs(paired(spark, d), spot(), rate(), years)
    return density.slices(ivs, max_spread=0.50, min_oi=10)


@query(
    "d3_implied_moments",
    f"""WITH {svi_sql.MOMENTS} SELECT market, as_of, expiry, quality, liquid_strike_count, round(atm_iv, 5) AS atm_iv, round(implied_mean, 3) AS implied_mean,
        round(implied_variance, 2) AS implied_variance, round(implied_skew, 4) AS implied_skew, round(implied_kurtosis, 4) AS implied_kurtosis FROM mom""",
)
def d3(spark, d):
    found = density.implied_moments(density.fit_svi(full_iv(spark, d)))
    return found.select(
        *SLICE, "quality", "liquid_strike_count", r6(F.col("atm_iv"), 5).alias("atm_iv"), r6(F.col("implied_mean"), 3).alias("implied_mean"),
        r6(F.col("implied_variance"), 2).alias("implied_variance"), r6(F.col("implied_skew"), 4).alias("implied_skew"),
        r6(F.col("implied_kurtosis"), 4).alias("implied_kurtosis"),
    )


@query("h1_black76_price", "SELECT quote_id, round(call_fair, 6) + 0.0 AS price FROM v_chainfair")
def h1(spark, d):
    quotes = tables.chain(spark, d)
    priced = with_call_price(quotes, spot(), F.col("strike"), rate(), F.col("t"), F.col("sigma"), "price")
    return priced.select("quote_id", r6(F.col("price")).alias("price"))


@query(
    "h2_black76_greeks",
    """WITH g AS (SELECT *, exp(-0.05::double * t) * 0.3989422804014327 * exp(-d1 * d1 / 2.0) AS pd,
           (call_fair / exp(-0.05::double * t) + strike * n2) / 100.0 AS n1 FROM (SELECT *, """
    + svi_sql.sql_norm_cdf("d2")
    + """ AS n2 FROM v_chainfair))
       SELECT quote_id, round(pd / (100.0 * sigma * sqrt(t)), 6) AS gamma, round(-pd * d2 / sigma, 6) + 0.0 AS vanna,
              round(-pd * (2 * 0.05 * t - d2 * sigma * sqrt(t)) / (2 * t * sigma * sqrt(t)), 6) + 0.0 AS charm,
              round(exp(-0.05::double * t) * CASE WHEN is_call THEN n1 ELSE n1 - 1 END, 6) + 0.0 AS delta, round(100.0 * pd * sqrt(t), 5) AS vega FROM g""",
)
def h2(spark, d):
    rated = with_greeks(tables.chain(spark, d), spot(), F.col("strike"), rate(), F.col("t"), F.col("sigma"), F.col("is_call"))
    return rated.select(
        "quote_id", *[r6(F.col(c)).alias(c) for c in ("gamma", "vanna", "charm", "delta")], r6(F.col("vega"), 5).alias("vega")
    )


def _mid(spark: SparkSession, d: str, calls: bool) -> DataFrame:
    return chain.with_mid(tables.chain(spark, d).where(F.col("is_call") == calls)).withColumn("rate", rate())


@query("h3_implied_vol", "SELECT quote_id, round(sigma, 6) AS iv FROM v_chain WHERE is_call")
def h3(spark, d):
    iv = call_iv(F.col("mid"), F.col("spot"), F.col("strike"), F.col("rate"), F.col("t"))
    return _mid(spark, d, True).select("quote_id", r6(iv).alias("iv"))


@query("h4_put_iv", "SELECT quote_id, round(sigma, 6) AS iv FROM v_chain WHERE NOT is_call")
def h4(spark, d):
    iv = put_iv(F.col("mid"), F.col("spot"), F.col("strike"), F.col("rate"), F.col("t"))
    return _mid(spark, d, False).select("quote_id", r6(iv).alias("iv"))


@query(
    "h5_svi_fit",
    f"""WITH {svi_sql.FIT} SELECT f.market, f.as_of, f.expiry, n_points, round(rmse, 6) AS rmse, round(k, 9) + 0.0 AS k, round(fitted_iv, 5) AS fitted_iv
        FROM fitted f JOIN rms USING (market, as_of, expiry)""",
)
def h5(spark, d):
    fitted = density.fit_svi(full_iv(spark, d)).where(F.col("quality") == "full")
    rows = fitted.select(*SLICE, "t", "svi", F.size("ks").alias("n_points"), F.explode("ks").alias("k"))
    iv = F.sqrt(F.greatest(density.svi_variance(F.col("k")), F.lit(1e-12)) / F.col("t"))
    return rows.select(
        *SLICE, F.col("n_points").cast("long").alias("n_points"), r6(F.col("svi.rmse")).alias("rmse"), r6(F.col("k"), 9).alias("k"), r6(iv, 5).alias("fitted_iv")
    )


@query(
    "h6_parity_error",
    """SELECT market, as_of, expiry, round(max(abs((call_mid - put_mid) - (100.0 - strike) * exp(-0.05::double * t))), 6) + 0.0 AS matched,
              round(max(abs((call_mid - put_mid) - (100.0 - strike) * exp(-0.05::double * 0.25))), 6) AS fixed_t FROM v_pairs GROUP BY 1, 2, 3""",
)
def h6(spark, d):
    rows = paired(spark, d).withColumn("t", F.datediff("expiry", "as_of") / F.lit(365.0))
    err = lambda t: F.max(chain.parity_error(F.col("call_mid"), F.col("put_mid"), spot(), F.col("strike"), rate(), t))
    return rows.groupBy(*SLICE).agg(r6(err(F.col("t"))).alias("matched"), r6(err(F.lit(0.25))).alias("fixed_t"))


@query("h7_implied_density", f"WITH {svi_sql.DENSITY} SELECT market, as_of, expiry, CAST(grid_i AS INTEGER) AS grid_i, round(k, 6) AS k, round(density, 5) + 0.0 AS density FROM dens")
def h7(spark, d):
    grid = density.density(density.fit_svi(full_iv(spark, d)))
    return grid.select(*SLICE, "grid_i", r6(F.col("k")).alias("k"), r6(F.col("density"), 5).alias("density"))


@query(
    "h8_trading_days_between",
    """WITH r AS (SELECT DISTINCT o_orderdate + to_hours(o_orderkey % 24) AS s, l_shipdate + INTERVAL 12 HOUR AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
       SELECT s AS start_ts, e AS end_ts, len(list_filter(range(s + INTERVAL 1 DAY, e + INTERVAL 1 SECOND, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS n_days FROM r""",
)
def h8(spark, d):
    orders = tables.table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.pmod("o_orderkey", F.lit(24)).cast("int"))).alias("start_ts")
    )
    lines = tables.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_shipdate") + F.expr("INTERVAL 12 HOUR")).alias("end_ts"))
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("start_ts", "end_ts").distinct()
    return pairs.withColumn("n_days", dates.weekdays_between(F.col("start_ts"), F.col("end_ts")))


@query(
    "h9_release_time",
    """SELECT DISTINCT o_orderdate AS report_date, CAST(CAST(o_orderdate AS DATE) + CAST(CASE WHEN (12 - isodow(o_orderdate)) % 7 = 0 THEN 7 ELSE (12 - isodow(o_orderdate)) % 7 END AS INTEGER) AS TIMESTAMP)
              + INTERVAL 20 HOUR + INTERVAL 30 MINUTE AS available_at FROM orders""",
)
def h9(spark, d):
    days = tables.table(spark, d, "orders").select(F.col("o_orderdate").alias("report_date")).distinct()
    return days.withColumn("available_at", dates.release_time(F.col("report_date")))


@query(
    "h10_expiry_parse",
    """SELECT instrument_id, CASE instrument_id % 3 WHEN 2 THEN NULL ELSE CAST(expiry AS DATE) END AS expiry_date,
              round(CASE instrument_id % 3 WHEN 2 THEN NULL ELSE date_diff('day', DATE '1998-06-01', CAST(expiry AS DATE)) / 365.0::double END, 6) + 0.0 AS t FROM v_defs""",
)
def h10(spark, d):
    """Two spellings and one that fits neither."""
    kind = F.pmod("instrument_id", F.lit(3))
    text = F.when(kind == 0, F.concat(F.lit(" "), F.col("expiry"))).when(kind == 1, F.replace(F.col("expiry"), F.lit("-"))).otherwise("JUN98")
    parsed = tables.definitions(spark, d).select("instrument_id", dates.parse_date(text).alias("expiry_date"))
    return parsed.withColumn("t", r6(dates.year_fraction(F.lit("1998-06-01").cast("date"), F.col("expiry_date"))))


_BEND_SQL = "CASE WHEN CAST(substr(market, 2) AS INTEGER) % 3 = 1 THEN -1.0::double ELSE 1.0::double END"


def _slope(v: str) -> str:
    return (
        f"CASE WHEN i = 0 THEN (lead({v}) OVER o - {v}) / h WHEN i = 499 THEN ({v} - lag({v}) OVER o) / h "
        f"ELSE (lead({v}) OVER o - lag({v}) OVER o) / (2 * h) END"
    )


@query(
    "h11_butterfly_check",
    f"""WITH {svi_sql.FIT},
        edge AS (SELECT {svi_sql.KEY}, min(k) - 0.5 AS lo, (max(k) - min(k) + 1.0) / 499 AS h FROM pts GROUP BY ALL),
        curve AS (SELECT {svi_sql.KEY}, i, h, p.m AS m, p.s AS s, p.rho AS rho, p.a AS a, {_BEND_SQL} * p.b AS b, lo + h * i AS x
                  FROM edge JOIN fit USING ({svi_sql.KEY}), (SELECT unnest(range(0, 500)) AS i)),
        w AS (SELECT *, a + b * (rho * (x - m) + sqrt((x - m) * (x - m) + s * s)) AS w FROM curve),
        g AS (SELECT *, {_slope('w')} AS g1 FROM w WINDOW o AS (PARTITION BY {svi_sql.KEY} ORDER BY i)),
        c AS (SELECT *, {_slope('g1')} AS g2 FROM g WINDOW o AS (PARTITION BY {svi_sql.KEY} ORDER BY i))
        SELECT market, as_of, expiry, bool_or(g2 < -1e-10) AS has_butterfly_arbitrage FROM c GROUP BY ALL""",
)
def h11(spark, d):
    """A fitted slice with non-negative wing slope is convex; every third market's slope is turned round, so its slices are not."""
    fitted = density.fit_svi(full_iv(spark, d)).where(F.col("quality") == "full")
    number = F.substring("market", 2, 20).cast("int")
    bent = F.when(F.pmod(number, F.lit(3)) == 1, -F.col("svi.b")).otherwise(F.col("svi.b"))
    return density.butterfly(fitted.withColumn("svi", F.col("svi").withField("b", bent)))


_DIV_SQL = """
src AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 100.0::double * (1 + (value - 50.0) / 2000.0::double) END AS im,
        CASE WHEN event_id % 13 <> 0 THEN (event_id % 7 - 3) / 4.0::double END AS sk, CASE WHEN event_id % 3 = 0 THEN 3.0 + (event_id % 5) * 0.5 ELSE 3.0 END::double AS ku,
        (user_id % 21 - 10) / 10.0::double AS sc, (user_id % 10) / 10.0::double AS co, CASE WHEN event_id % 4 = 0 THEN 'degraded' ELSE 'full' END AS q FROM events),
b AS (SELECT *, (im - 100.0) / 100.0 AS bias, (im - 100.0) / 100.0 - sc / 10.0 AS raw FROM src),
t AS (SELECT *, CASE WHEN im IS NULL THEN 0 WHEN ku > 4 AND abs(bias) < 0.02 THEN 1 WHEN bias > 0.01 AND sc < -0.3 THEN 2 WHEN bias < -0.01 AND sc > 0.3 THEN 3
        WHEN abs(bias) < 0.02 AND abs(sc) > 0.6 THEN 4 WHEN abs(bias) > 0.01 AND abs(sk) > 0.5 AND abs(sc) < 0.3 THEN 5
        WHEN abs(bias) > 0.01 AND abs(sc) > 0.01 AND bias * sc > 0 THEN 6 ELSE 0 END AS k FROM b)"""


@query(
    "h12_divergence_class",
    f"""WITH {_DIV_SQL} SELECT event_id, CASE k WHEN 2 THEN 1 WHEN 3 THEN -1 WHEN 4 THEN CASE WHEN sc > 0 THEN -1 ELSE 1 END WHEN 5 THEN CASE WHEN bias > 0 THEN 1 ELSE -1 END
          WHEN 6 THEN CASE WHEN bias > 0 THEN 1 ELSE -1 END ELSE 0 END AS direction, round(CASE WHEN im IS NULL THEN 0 ELSE raw END, 6) + 0.0 AS magnitude,
          ['neutral','volatility_play','options_bullish_sentiment_bearish','options_bearish_sentiment_bullish','sentiment_overreaction','early_signal','trend_follow'][k + 1] AS divergence_type,
          ['neutral','vol_play','long','short','fade_sentiment','early_entry','trend_follow'][k + 1] AS suggested_bias,
          round(least(greatest(co * CASE WHEN q = 'full' THEN 1.0 ELSE 0.5 END * greatest(least(abs(CASE WHEN im IS NULL THEN 0 ELSE raw END) / 2.0, 1.0), 0.3), 0.0), 1.0), 6) AS confidence FROM t""",
)
def h12(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    rows = tables.table(spark, d, "events").select(
        "event_id",
        F.when(e % 11 != 0, 100.0 * (1 + (F.col("value") - 50.0) / 2000.0)).alias("im"),
        F.when(e % 13 != 0, (e % 7 - 3) / 4.0).alias("sk"),
        F.when(e % 3 == 0, 3.0 + (e % 5) * 0.5).otherwise(3.0).alias("ku"),
        ((u % 21 - 10) / 10.0).alias("sc"),
        ((u % 10) / 10.0).alias("co"),
        F.when(e % 4 == 0, "degraded").otherwise("full").alias("q"),
    )
    parts = signals.classify(*[F.col(c) for c in ("im",)], F.lit(100.0), *[F.col(c) for c in ("sk", "ku", "sc", "co", "q")])
    return rows.select(
        "event_id", parts["direction"].alias("direction"), r6(parts["magnitude"]).alias("magnitude"),
        parts["divergence_type"].alias("divergence_type"), parts["suggested_bias"].alias("suggested_bias"), r6(parts["confidence"]).alias("confidence"),
    )


@query(
    "h13_slippage_cost",
    """SELECT timestamp, order_id, l_linenumber, l_partkey, l_suppkey, round(l.spread / 2.0 + 0.1::double * l.vol * sqrt(n_contracts / greatest(l.volume, 1.0)), 7) AS cost
       FROM (SELECT *, order_price * 0.002::double AS spread, 0.01::double + (l_linenumber % 5) / 100.0::double AS vol, (l_partkey % 50) * 20.0::double AS volume FROM v_fills) l""",
)
def h13(spark, d):
    """Volume is zero for some rows: participation then counts against one contract."""
    fills = tables.fills(spark, d)
    cost = risk.slippage(
        F.col("n_contracts"), F.pmod("l_partkey", F.lit(50)) * 20.0, F.col("spread_at_fill"), 0.01 + (F.col("l_linenumber") % 5) / 100.0
    )
    return fills.select("timestamp", "order_id", "l_linenumber", "l_partkey", "l_suppkey", r6(cost, 7).alias("cost"))


@query(
    "h14_kelly_size",
    """SELECT event_id, round(CASE WHEN loss <= 0 OR p <= 0 OR p >= 1 OR win <= 0 THEN 0 WHEN (p * (win / loss) - (1 - p)) / (win / loss) <= 0 THEN 0
              ELSE least(0.5 * (p * (win / loss) - (1 - p)) / (win / loss), 0.10) END, 9) + 0.0 AS kelly
       FROM (SELECT event_id, p, 0.01::double + (event_id % 7) / 1000.0::double AS win, (event_id % 6) / 500.0::double AS loss FROM v_predictions)""",
)
def h14(spark, d):
    e = F.col("event_id")
    share = risk.kelly(F.col("p"), 0.01 + (e % 7) / 1000.0, (e % 6) / 500.0)
    return tables.predictions(spark, d).select("event_id", r6(share, 9).alias("kelly"))


@query(
    "h15_volume_cap",
    """SELECT event_id, greatest(0, least(CAST(trunc(p / 10 * 100000.0 / 1000.0) AS BIGINT), CAST(trunc(0.02::double * (event_id % 600)) AS BIGINT))) AS n_contracts FROM v_predictions""",
)
def h15(spark, d):
    lots = risk.volume_cap(F.col("p") / 10, F.lit(100_000.0), F.lit(1000.0), F.pmod("event_id", F.lit(600)))
    return tables.predictions(spark, d).select("event_id", lots.alias("n_contracts"))


@query(
    "h16_order_plan",
    """WITH o AS (SELECT timestamp, order_id, l_linenumber, l_partkey, l_suppkey, n_contracts, order_price, direction, CASE WHEN n_contracts / 2000.0::double >= 0.01 THEN 5 ELSE 1 END AS n_slices FROM v_fills),
       s AS (SELECT *, unnest(range(0, n_slices)) AS slice_no, CASE WHEN direction = 1 THEN 1.0 ELSE -1.0 END::double AS side FROM o)
       SELECT timestamp, order_id, l_linenumber, l_partkey, l_suppkey, n_slices, CAST(slice_no AS INTEGER) AS slice_no,
              n_contracts // n_slices + CASE WHEN slice_no < n_contracts % n_slices THEN 1 ELSE 0 END AS slice_contracts,
              round_even(round_even(order_price / 0.025::double, 0) * 0.025::double, 10) AS price_mid,
              round_even(round_even((order_price + side * order_price * (0.001::double * 1)) / 0.025::double, 0) * 0.025::double, 10) AS price_step,
              round_even(round_even((order_price + side * order_price * (0.001::double * 10)) / 0.025::double, 0) * 0.025::double, 10) AS price_cross FROM s""",
)
def h16(spark, d):
    orders = tables.fills(spark, d).select(*tables.FILL_ORDER, "n_contracts", "order_price", "direction")
    plan = costs.order_plan(orders, F.col("n_contracts"), F.lit(2000.0), F.col("order_price"), F.col("direction") == 1)
    return plan.select(*tables.FILL_ORDER, "n_slices", "slice_no", "slice_contracts", "price_mid", "price_step", "price_cross")


def chain_spots(quotes: DataFrame) -> DataFrame:
    """Closes of the chain markets through the feature store: the newest one is not yet visible."""
    markets = quotes.select("market").distinct()
    days = F.inline(
        F.array(
            *[
                F.struct(F.lit(day).cast("timestamp_ntz").alias("as_of"), F.lit(px).alias("value"))
                for day, px in (("2024-02-28", 95.0), ("2024-02-29", tables.CHAIN_FORWARD), ("2024-03-04", 130.0))
            ]
        )
    )
    closes = markets.select("market", F.concat(F.lit("futures_close_"), F.col("market")).alias("feature_name"), days)
    seen = features.lookup(closes.withColumn("available_at", F.col("as_of")), F.lit(tables.CHAIN_DAY).cast("timestamp_ntz"))
    return seen.select("market", F.col("value").alias("spot"))


def job_features(spark: SparkSession, d: str) -> DataFrame:
    quotes = durable(tables.chain(spark, d))  # stands for the landed quote table
    return option_features(
        quotes, chain_spots(quotes), F.col("quote_id"), implied_multipliers(quotes), tables.CHAIN_RATE
    )


def implied_multipliers(quotes: DataFrame) -> DataFrame:
    number = F.substring("market", 2, 20).cast("int")
    sizes = F.array(*[F.lit(r[3]) for r in config.MARKETS])
    rows = quotes.select("market").distinct()
    return rows.withColumn("multiplier", F.element_at(sizes, (F.pmod(number, F.lit(14)) + 1).cast("int")))


_DIGITS = {"implied_mean": 3, "implied_variance": 2, "implied_skew": 4, "implied_kurtosis": 4, "atm_iv": 5, "gex": 2, "vanna_flow": 2, "charm_flow": 2}


def _job_sql() -> str:
    flow = _FLOW_SQL.strip()[5:]
    moments = " UNION ALL ".join(
        f"SELECT market, '{n}' AS feature_name, as_of, quality, round({n}, {_DIGITS[n]}) + 0.0 AS value FROM mom WHERE {n} IS NOT NULL" for n in MOMENTS
    )
    flows = " UNION ALL ".join(
        f"SELECT market, '{n}', as_of, CASE WHEN liquid_strike_count >= 8 THEN 'full' ELSE 'degraded' END, round(CASE WHEN liquid_strike_count >= 8 THEN {n} ELSE 0 END, 2) + 0.0 FROM s"
        for n in FLOWS
    )
    return f"WITH {svi_sql.MOMENTS}, {flow} SELECT market, feature_name, CAST(as_of AS TIMESTAMP) AS as_of, quality, value FROM ({moments} UNION ALL {flows})"


@query("h17_options_features_job", _job_sql())
def h17(spark, d):
    found = job_features(spark, d)
    value = F.lit(None).cast("double")
    for name, digits in _DIGITS.items():
        value = F.when(F.col("feature_name") == name, r6(F.col("value"), digits)).otherwise(value)
    return found.select("market", "feature_name", "as_of", "quality", value.alias("value"))


_SEGMENT = {"ECONOMY": "AUTOMOBILE", "LARGE": "BUILDING", "MEDIUM": "FURNITURE", "PROMO": "HOUSEHOLD"}
SEGMENT_SQL = "CASE market " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEGMENT.items()) + " ELSE market END"
_SEGMENTS_SQL = ", ".join(f"'{v}'" for v in _SEGMENT.values())


DIRECTION_SQL = """CASE WHEN ku > 4 AND abs(bias) < 0.02 THEN 0 WHEN bias > 0.01 AND sc < -0.3 THEN 1 WHEN bias < -0.01 AND sc > 0.3 THEN -1
               WHEN abs(bias) < 0.02 AND abs(sc) > 0.6 THEN CASE WHEN sc > 0 THEN -1 ELSE 1 END
               WHEN abs(bias) > 0.01 AND abs(sk) > 0.5 AND abs(sc) < 0.3 THEN CASE WHEN bias > 0 THEN 1 ELSE -1 END
               WHEN abs(bias) > 0.01 AND abs(sc) > 0.01 AND bias * sc > 0 THEN CASE WHEN bias > 0 THEN 1 ELSE -1 END ELSE 0 END"""


def segment_rows(spark: SparkSession, d: str) -> DataFrame:
    """Option features and closes from all bars, a row each: of four segments (the fifth has none) and of two markets without reports."""
    segment: Column = F.col("market")
    for k, v in _SEGMENT.items():
        segment = F.when(F.col("market") == k, v).otherwise(segment)
    spread = F.col("high") - F.col("low")
    return tables.bars(spark, d).select(
        segment.alias("market"), F.col("ts").alias("as_of"), F.col("ts").alias("available_at"),
        (F.col("close") * (1 + (F.col("open") - F.col("low")) / F.col("high") / 20 - 0.02)).alias("implied_mean"),
        ((F.col("open") - F.col("close")) / F.col("high")).alias("implied_skew"),
        (3 + 2 * F.col("low") / F.col("close")).alias("implied_kurtosis"),
        F.col("close").alias("spot"),
        (spread * spread).alias("implied_variance"),
        (spread / F.col("close")).alias("atm_iv"),
        (F.col("volume") * (F.col("close") - F.col("open"))).alias("gex"),
        (F.col("volume") * (F.col("high") - F.col("close"))).alias("vanna_flow"),
        # dealers' charm is known for every third week only
        F.when(F.pmod(F.unix_date(F.col("ts").cast("date")), F.lit(21)) == 0, F.col("volume") * (F.col("open") - F.col("low"))).alias("charm_flow"),
    )


def feature_sources(spark: SparkSession, d: str, options: DataFrame | None = None) -> list[DataFrame]:
    """Reports with their sentiment, and option features: what the stored features come from, in wide rows."""
    mood = signals.cot_sentiment(reports(spark, d)).select(
        "market", F.col("report_date").cast("timestamp_ntz").alias("as_of"), "available_at",
        *[F.col(source).cast("double").alias(name) for name, source in config.COT_FEATURES.items()], "sentiment_score", "sentiment_confidence",
    )
    return [mood, segment_rows(spark, d) if options is None else options]


@query(
    "h18_signal_features",
    f"""WITH {SENTIMENT_SQL},
        opt AS (SELECT {SEGMENT_SQL} AS market, ts, close * (1 + (open - low) / high / 20 - 0.02) AS im, (open - close) / high AS sk, 3 + 2 * low / close AS ku, close AS spot FROM v_bars),
        probes AS (SELECT market, CAST(report_date AS TIMESTAMP) AS ts FROM v_cot UNION ALL SELECT market, ts FROM opt WHERE market NOT IN ({_SEGMENTS_SQL})),
        cot AS (SELECT r.market, r.available_at, s.sentiment_score AS sc, s.sentiment_confidence AS co FROM v_reports r JOIN sentiment s USING (market, report_date)),
        j AS (SELECT p.market, p.ts, sc, co FROM probes p ASOF LEFT JOIN cot c ON p.market = c.market AND p.ts >= c.available_at),
        k AS (SELECT j.market, j.ts, sc, co, im, sk, ku, spot FROM j ASOF LEFT JOIN opt o ON j.market = o.market AND j.ts >= o.ts),
        b AS (SELECT *, (im - spot) / spot AS bias, (im - spot) / spot - sc / 10.0 AS raw, im IS NOT NULL AND sc IS NOT NULL AS both_in FROM k),
        t AS (SELECT *, {DIRECTION_SQL} AS dir FROM b)
        SELECT market, ts, round(sc, 6) + 0.0 AS sentiment_score, round(co, 6) + 0.0 AS sentiment_confidence, CASE WHEN both_in THEN dir END::double AS divergence_direction,
               round(CASE WHEN both_in THEN raw END, 6) + 0.0 AS divergence_magnitude,
               round(CASE WHEN both_in THEN least(greatest(co * greatest(least(abs(raw) / 2.0, 1.0), 0.3), 0.0), 1.0) END, 6) + 0.0 AS divergence_confidence FROM t""",
)
def h18(spark, d):
    """Sentiment joins as features with release times; a real spot replaces the implied mean.

    Markets without reports are probed at their bars: their sentiment is null.
    """
    names = [
        "cot_managed_money_net", "cot_total_oi", "implied_mean", "implied_skew", "implied_kurtosis", "spot", "sentiment_score", "sentiment_confidence",
    ]
    others = tables.bars(spark, d).where(~F.col("market").isin(list(_SEGMENT))).select("market", "ts")
    wide = features.wide_matrix(feature_sources(spark, d), weekly_probes(spark, d).unionByName(others), names)
    out = signals.signal_features(wide, F.col("spot"))
    return out.select(
        "market", "ts", "divergence_direction",
        *[r6(F.col(c)).alias(c) for c in ("sentiment_score", "sentiment_confidence", "divergence_magnitude", "divergence_confidence")],
    )

