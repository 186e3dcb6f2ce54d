"""Groups A and B: sources, sinks, table maintenance, validation and row rules."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import quotes as q
from tidemark.operators import chain, costs, experiments, features, ingest, validate
from tidemark.plans.registry import query, r6
from tidemark.sources import journals, lake, markets, tables, vendor
from tidemark.streaming.ingest import scratch


def canonical_bars(spark: SparkSession, d: str) -> DataFrame:
    return tables.bars(spark, d).select(
        "market", "open", "high", "low", "close", "volume", F.col("market").alias("symbol"), F.col("ts").alias("ts_event")
    )


def _values_sql() -> str:
    return ", ".join(
        f"('{s}', '{e}', '{c}', {m}::double, {k}::double, {str(o).lower()}, {t})"
        for s, e, c, m, k, o, t in config.MARKETS
    )


MARKET_VALUES = (
    f"(VALUES {_values_sql()}) AS m(symbol, exchange, cftc_code, multiplier, strike_range, has_options, tier)"
)


@query(
    "a1_lake_append",
    """SELECT 'futures' AS data_type, market, strftime(date_trunc('quarter', ts), '%Y') AS year,
              strftime(date_trunc('quarter', ts), '%m') AS month,
              2 * count(*) AS n_rows, 2 * CAST(sum(volume) AS BIGINT) AS volume
       FROM v_bars GROUP BY 1, 2, 3, 4""",
)
def a1(spark, d):
    """Two appends of one batch, dated by quarter: both survive, under the right partitions."""
    root = scratch(spark, "lake")
    bars = canonical_bars(spark, d)
    for _ in range(2):
        lake.append(bars, root, "futures", F.date_trunc("quarter", F.col("ts_event")))
    return spark.read.schema(
        "volume long, data_type string, market string, year string, month string"
    ).parquet(root).groupBy("data_type", "market", "year", "month").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("volume").alias("volume")
    )


@query(
    "a2_lake_scan",
    """SELECT market, ts AS ts_event, close, volume FROM v_bars
       WHERE market = 'PROMO' AND strftime(date_trunc('quarter', ts), '%Y%m') BETWEEN '199611' AND '199802'""",
)
def a2(spark, d):
    root = scratch(spark, "lake")
    lake.append(canonical_bars(spark, d), root, "futures", F.date_trunc("quarter", F.col("ts_event")))
    found = lake.scan(spark, root, "futures", "PROMO", date(1996, 11, 20), date(1998, 2, 1))
    return found.select("market", "ts_event", "close", "volume")


@query(
    "a3_feature_upsert",
    "SELECT market, feature_name, as_of, available_at, value FROM v_store",
)
def a3(spark, d):
    return store(spark, d)


def store(spark: SparkSession, d: str) -> DataFrame:
    """Feature table with unique keys, from the raw writes."""
    raw = tables.features(spark, d).drop("quality")
    return features.upsert(raw, F.col("seq")).drop("seq")


@query(
    "a4_bars_normalize",
    """SELECT market, open, high, low, close,
              volume, CASE WHEN market < 'M' THEN market || '.FUT' ELSE market END AS symbol, ts AS ts_event
       FROM v_bars""",
)
def a4(spark, d):
    bars = tables.bars(spark, d)
    exchange = bars.where(F.col("market") < "M").withColumnRenamed("ts", "ts_event").withColumn(
        "symbol", F.lit(None).cast("string")
    )
    broker = bars.where(F.col("market") >= "M").withColumn("date", F.date_format("ts", "yyyyMMdd")).drop("ts")
    both = vendor.exchange_bars(exchange).unionByName(vendor.broker_bars(broker), allowMissingColumns=True)
    return both.select("market", "open", "high", "low", "close", "volume", "symbol", "ts_event")


# segments stand for the first contracts of the registry; MACHINERY has no registered code
_CODES = {"AUTOMOBILE": "054642", "BUILDING": "057642", "FURNITURE": "061641", "HOUSEHOLD": "052641"}
_SYMBOLS = {"AUTOMOBILE": "HE", "BUILDING": "LE", "FURNITURE": "GF", "HOUSEHOLD": "DC"}


def raw_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports as a vendor would land them: padded codes, three date spellings, some bad dates."""
    cot = tables.cot_reports(spark, d)
    code = F.lit("999999")
    for segment, c in _CODES.items():
        code = F.when(F.col("market") == segment, F.lit(c)).otherwise(code)
    week = F.datediff("report_date", F.lit("1995-01-03")) / 7
    kind = F.pmod(week.cast("int"), F.lit(4))
    spelled = (
        F.when(kind == 0, F.date_format("report_date", "yyyy-MM-dd"))
        .when(kind == 1, F.date_format("report_date", "yyMMdd"))
        .when(kind == 2, F.date_format("report_date", "yyMMdd").cast("int").cast("string"))
        .otherwise(F.lit("n/a"))
    )
    return cot.select(
        F.concat(F.lit(" "), code, F.lit("  ")).alias("CFTC Contract Market Code"),
        spelled.alias("As_of_Date_In_Form_YYMMDD"),
        F.col("managed_money_long").alias("M_Money_Positions_Long_ALL"),
        F.col("managed_money_short").alias("M_Money_Positions_Short_All"),
        F.col("producer_long").alias("Prod_Merc_Positions_Long_All"),
        F.col("producer_short").alias("Prod_Merc_Positions_Short_ALL"),
        F.col("swap_long").alias("Swap__Positions_Long_All"),
        F.col("swap_short").alias("Swap__Positions_Short_All"),
        F.col("total_oi").alias("Open_Interest_All"),
    )


_COT_OUT = [
    "managed_money_long", "managed_money_short", "managed_money_net", "producer_long", "producer_short", "producer_net",
    "swap_long", "swap_short", "swap_net", "total_oi",
]


@query(
    "a5_cot_normalize",
    f"""SELECT CASE market {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _SYMBOLS.items())} END AS market,
               report_date, available_at, {', '.join(f'round({c}, 2) + 0.0 AS {c}' for c in _COT_OUT)},
               report_date >= DATE '2001-07-31' - 28 AS is_revision_window
        FROM v_reports WHERE market <> 'MACHINERY' AND (date_diff('day', DATE '1995-01-03', report_date) // 7 + 4) % 4 <> 3""",
)
def a5(spark, d):
    found = vendor.cot_normalize(raw_reports(spark, d), markets.market_dim(spark), F.lit("2001-07-31").cast("date"))
    return found.select(
        "market", "report_date", "available_at", *[r6(F.col(c), 2).alias(c) for c in _COT_OUT], "is_revision_window"
    )


@query(
    "a6_close_features",
    """SELECT market, 'futures_close_' || market AS feature_name, ts AS as_of, ts AS available_at,
              close AS value, 'normal' AS quality FROM v_bars""",
)
def a6(spark, d):
    return features.close_features(canonical_bars(spark, d))


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Report table of the engine's shape for every segment."""
    return vendor.cot_enrich(tables.cot_reports(spark, d), F.lit("2001-07-31").cast("date"))


@query(
    "a7_cot_features",
    """SELECT market, feature_name, as_of, available_at, round(value, 2) + 0.0 AS value, 'normal' AS quality FROM v_cotlong""",
)
def a7(spark, d):
    return features.cot_features(reports(spark, d)).withColumn("value", r6(F.col("value"), 2))


@query(
    "a8_fills_append",
    """SELECT row_number() OVER (ORDER BY timestamp, order_id, l_linenumber, l_partkey, l_suppkey) AS id,
              timestamp, symbol, order_id, direction, n_contracts, fill_price FROM v_fills""",
)
def a8(spark, d):
    root = scratch(spark, "fills")
    rows = tables.fills(spark, d)
    journals.append_rows(rows, root)
    stored = spark.read.schema(rows.schema).parquet(root)
    return journals.with_fill_ids(stored, tables.FILL_ORDER).select(
        "id", "timestamp", "symbol", "order_id", "direction", "n_contracts", "fill_price"
    )


@query(
    "a9_experiments_append",
    """SELECT id, created_at, mutation_type, '{"v":"' || CAST(user_id AS VARCHAR) || '"}' AS config_diff,
              '["' || tag1 || '","' || tag2 || '"]' AS tags, promotion_decision FROM v_experiments""",
)
def a9(spark, d):
    root = scratch(spark, "experiments")
    encoded = journals.encode_experiments(journals.decode_experiments(tables.experiments(spark, d)))
    journals.append_rows(encoded, root)
    return spark.read.schema(encoded.schema).parquet(root).select(
        "id", "created_at", "mutation_type", "config_diff", "tags", "promotion_decision"
    )


@query(
    "a10_experiments_read",
    """SELECT id, CAST(json_extract_string(results, '$.k') AS BIGINT) AS k, tag1, tag2, promotion_decision,
              CAST(user_id AS BIGINT) AS v FROM v_experiments""",
)
def a10(spark, d):
    log = journals.decode_experiments(tables.experiments(spark, d))
    return log.select(
        "id",
        F.col("results")["k"].cast("long").alias("k"),
        F.col("tags")[0].alias("tag1"),
        F.col("tags")[1].alias("tag2"),
        "promotion_decision",
        F.col("config_diff")["v"].cast("long").alias("v"),
    )


_BAR_OK = (
    "(open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND high >= low AND close >= low AND close <= high)"
)


@query(
    "a11_multi_market_ingest",
    f"""SELECT market, count(*) FILTER ({_BAR_OK}) AS n_clean, count(*) FILTER (NOT {_BAR_OK}) AS n_quarantined,
               count(*) FILTER ({_BAR_OK}) AS n_features FROM v_trades GROUP BY market""",
)
def a11(spark, d):
    raw = tables.trades(spark, d).withColumn("symbol", F.col("market")).withColumnRenamed("ts", "ts_event")
    root = scratch(spark, "ingest")
    ingest.ingest(
        raw, validate.BAR_RULES, root, "futures", F.date_trunc("year", F.col("ts_event")), features.close_features,
        ["open", "high", "low", "close", "volume", "symbol", "ts_event"],
    )
    count = lambda df, name: df.groupBy("market").agg(F.count(F.lit(1)).alias(name))
    kept = count(lake.scan(spark, f"{root}/lake", "futures"), "n_clean")
    bad = count(spark.read.schema("market string").parquet(f"{root}/quarantine/futures"), "n_quarantined")
    feats = count(spark.read.schema("market string").parquet(f"{root}/features"), "n_features")
    return kept.join(bad, "market", "full").join(feats, "market", "full")


@query(
    "a12_history_backfill",
    """SELECT market, 'futures_close_' || market AS feature_name, ts AS as_of, ts AS available_at,
              close AS value, 'normal' AS quality
       FROM v_bars WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'""",
)
def a12(spark, d):
    """Run twice over the same two years, first with closes at the high: the second write lowers them and stays, once per key."""
    root = scratch(spark, "backfill")
    bars = canonical_bars(spark, d)
    args = ("ts_event", "1997-01-01", "1998-12-31", validate.BAR_RULES, root, features.close_features)
    ingest.backfill(bars.withColumn("close", F.col("high")), *args)
    return ingest.backfill(bars, *args)


@query(
    "a13_market_dim",
    f"""SELECT m.symbol, m.exchange, m.multiplier, m.tier, count(p_partkey) AS n_instruments
        FROM {MARKET_VALUES} LEFT JOIN part ON p_partkey % 14 = CAST(list_position(
            [{', '.join(repr(r[0]) for r in config.MARKETS)}], m.symbol) AS BIGINT) - 1
        WHERE m.tier IN (1, 2) GROUP BY ALL""",
)
def a13(spark, d):
    """Active markets with the instruments assigned to each by key."""
    names = F.array(*[F.lit(r[0]) for r in config.MARKETS])
    parts = tables.table(spark, d, "part").select(
        F.element_at(names, (F.pmod("p_partkey", F.lit(14)) + 1).cast("int")).alias("symbol")
    )
    counts = parts.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    active = markets.active_markets(spark, [1, 2])
    return active.join(counts, "symbol", "left").select(
        "symbol", "exchange", "multiplier", "tier", F.coalesce("n", F.lit(0)).alias("n_instruments")
    )


@query(
    "b1_validate_bars",
    f"""SELECT market, count(*) AS n_rows, count(*) FILTER ({_BAR_OK}) AS n_valid, count(*) FILTER (NOT {_BAR_OK}) AS n_dropped,
               count(*) FILTER (open <= 0) AS n_open_not_positive, count(*) FILTER (high <= 0) AS n_high_not_positive,
               count(*) FILTER (low <= 0) AS n_low_not_positive, count(*) FILTER (close <= 0) AS n_close_not_positive,
               count(*) FILTER (volume < 0) AS n_volume_negative, count(*) FILTER (high < low) AS n_high_below_low,
               count(*) FILTER (close < low OR close > high) AS n_close_outside_range
        FROM v_trades GROUP BY market""",
)
def b1(spark, d):
    return validate.summary(tables.trades(spark, d), validate.BAR_RULES, ["market"])


def assembled(spark: SparkSession, d: str) -> DataFrame:
    """Every quote; each tenth instrument has no definition and each seventh no statistics."""
    known = tables.definitions(spark, d).where(F.pmod("instrument_id", F.lit(10)) != 0)
    return chain.assemble(tables.quotes(spark, d), known, tables.statistics(spark, d))


_ASSEMBLED = """v_quotes LEFT JOIN (SELECT * FROM v_defs WHERE instrument_id % 10 <> 0) USING (instrument_id) LEFT JOIN v_stats USING (instrument_id)"""


@query(
    "b2_validate_quotes",
    f"""SELECT l_shipdate, l_orderkey, l_linenumber, instrument_id, l_suppkey,
               concat_ws(',', CASE WHEN coalesce(strike, 0) <= 0 THEN 'strike<=0' END, CASE WHEN bid < 0 THEN 'bid<0' END,
                         CASE WHEN ask < bid AND ask > 0 THEN 'inverted' END) AS reasons
        FROM (SELECT * REPLACE (ask - l_linenumber AS ask) FROM {_ASSEMBLED})
        WHERE coalesce(strike, 0) <= 0 OR bid < 0 OR (ask < bid AND ask > 0)""",
)
def b2(spark, d):
    """Quarantined quotes with their reasons; the ask is lowered so that inverted markets occur."""
    lowered = assembled(spark, d).withColumn("ask", F.col("ask") - F.col("l_linenumber"))
    _, broken = validate.split(lowered, validate.QUOTE_RULES)
    return broken.select(
        "l_shipdate", "l_orderkey", "l_linenumber", "instrument_id", "l_suppkey", F.array_join("reasons", ",").alias("reasons")
    )


@query(
    "b3_validate_cot",
    """SELECT market, report_date, round(managed_money_long - 100000, 2) + 0.0 AS managed_money_long, round(total_oi, 2) AS total_oi
       FROM v_cot WHERE managed_money_long - 100000 >= 0 AND managed_money_short >= 0 AND producer_long >= 0
         AND producer_short >= 0 AND swap_long >= 0 AND swap_short >= 0 AND total_oi >= 0""",
)
def b3(spark, d):
    shifted = tables.cot_reports(spark, d).withColumn("managed_money_long", F.col("managed_money_long") - 100000)
    clean, _ = validate.split(shifted, validate.COT_RULES)
    return clean.select(
        "market", "report_date", r6(F.col("managed_money_long"), 2).alias("managed_money_long"),
        r6(F.col("total_oi"), 2).alias("total_oi"),
    )


@query(
    "b4_liquid_quotes",
    """SELECT market, expiry, count(*) AS n_quotes, count(*) FILTER (oi >= 50 AND sp <= 0.0801) AS n_liquid,
              count(*) FILTER (oi >= 10 AND sp <= 0.50) AS n_loose
       FROM (SELECT *, (ask - bid) / ((bid + ask) / 2) AS sp FROM v_chain) GROUP BY market, expiry""",
)
def b4(spark, d):
    priced = chain.with_mid(tables.chain(spark, d))
    # thresholds lie between the quoted widths, so float noise cannot flip a row
    tight = chain.liquid(F.col("oi"), F.col("spread_pct"), config.MIN_OI, 0.0801)
    loose = chain.liquid(F.col("oi"), F.col("spread_pct"), config.DENSITY_MIN_OI, config.DENSITY_MAX_SPREAD_PCT)
    return priced.groupBy("market", "expiry").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count_if(tight).alias("n_liquid"), F.count_if(loose).alias("n_loose")
    )


_FILL_COLUMNS = ["timestamp", "symbol", "order_id", "l_linenumber", "l_partkey", "l_suppkey", "n_contracts"]


@query(
    "b5_fills_query",
    f"""SELECT {', '.join(_FILL_COLUMNS)} FROM v_fills
        WHERE symbol = 'SMALL' AND timestamp >= TIMESTAMP '1996-01-01' AND timestamp <= TIMESTAMP '1999-12-31'
        ORDER BY timestamp DESC, order_id DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 1000""",
)
def b5(spark, d):
    return costs.fills_query(
        tables.fills(spark, d), tables.FILL_ORDER, "SMALL", "1996-01-01", "1999-12-31"
    ).select(*_FILL_COLUMNS)


@query(
    "b6_experiments_query",
    """SELECT id, created_at, mutation_type, promotion_decision FROM v_experiments
       WHERE (tag1 = 'click' OR tag2 = 'click') AND (tag1 = 'u3' OR tag2 = 'u3')
         AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
         AND mutation_type = 'click' AND promotion_decision = 'rejected'
       ORDER BY created_at DESC, id DESC LIMIT 100""",
)
def b6(spark, d):
    log = journals.decode_experiments(tables.experiments(spark, d))
    return experiments.experiments_query(
        log, ["click", "u3"], "2024-01-05", "2024-01-25", "click", "rejected"
    ).select("id", "created_at", "mutation_type", "promotion_decision")


@query("b7_experiment_by_id", "SELECT id, created_at, mutation_type, tag1, tag2 FROM v_experiments WHERE id = 777")
def b7(spark, d):
    log = journals.decode_experiments(tables.experiments(spark, d))
    return experiments.experiment_by_id(log, 777).select(
        "id", "created_at", "mutation_type", F.col("tags")[0].alias("tag1"), F.col("tags")[1].alias("tag2")
    )


@query(
    "b8_mid_spread",
    """SELECT quote_id, round((bid + ask) / 2, 6) + 0.0 AS mid, round((ask - bid) / ((bid + ask) / 2), 6) AS spread_pct FROM v_chain""",
)
def b8(spark, d):
    return chain.with_mid(tables.chain(spark, d)).select(
        "quote_id", r6(F.col("mid")).alias("mid"), r6(F.col("spread_pct")).alias("spread_pct")
    )


_SNAP = """SELECT l_shipdate, l_orderkey, l_linenumber, instrument_id, l_suppkey,
                  CASE WHEN l_linenumber % 3 <> 0 THEN bid END AS bid, CASE WHEN l_linenumber % 2 = 0 THEN ask ELSE 'nan'::double END AS ask,
                  CASE WHEN l_suppkey % 5 = 0 THEN -1.0 WHEN l_suppkey % 5 = 1 THEN NULL ELSE bid + 1 END AS last,
                  CASE WHEN l_suppkey % 4 = 0 THEN 'nan'::double ELSE bid + 2 END AS close FROM v_quotes"""


@query(
    "b9_price_fallback",
    f"""WITH snap AS ({_SNAP}), marked AS (
          SELECT *, bid > 0 AND ask > 0 AND NOT isnan(ask) AS two, last > 0 AS has_last, close > 0 AND NOT isnan(close) AS has_close FROM snap)
        SELECT l_shipdate, l_orderkey, l_linenumber, instrument_id, l_suppkey,
               CASE WHEN has_last THEN last WHEN has_close THEN close WHEN two THEN (bid + ask) / 2 END AS underlying,
               CASE WHEN two THEN (bid + ask) / 2 WHEN has_last THEN last WHEN has_close THEN close END AS price,
               CASE WHEN two THEN ask - bid WHEN has_last THEN last * 0.002::double WHEN has_close THEN close * 0.002::double END + 0.0 AS spread
        FROM marked""",
)
def b9(spark, d):
    snap = snapshots(spark, d)
    price = q.snapshot_price(F.col("bid"), F.col("ask"), F.col("last"), F.col("close"))
    return snap.select(
        "l_shipdate", "l_orderkey", "l_linenumber", "instrument_id", "l_suppkey",
        q.underlying_price(F.col("last"), F.col("close"), F.col("bid"), F.col("ask")).alias("underlying"),
        price.alias("price"),
        (q.snapshot_spread(F.col("bid"), F.col("ask"), price) + 0.0).alias("spread"),
    )


@query(
    "b9b_snapshot_bars",
    f"""WITH snap AS ({_SNAP}), priced AS (SELECT *, CASE WHEN last > 0 THEN last WHEN close > 0 AND NOT isnan(close) THEN close END AS price FROM snap)
        SELECT CAST(instrument_id AS VARCHAR) AS market, CASE WHEN bid > 0 THEN bid ELSE price END AS open, CASE WHEN ask > 0 AND NOT isnan(ask) THEN ask ELSE price END AS high,
               CASE WHEN l_suppkey % 3 = 0 AND bid > 0 THEN bid ELSE price END AS low, price AS close, CAST(CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE l_suppkey END AS BIGINT) AS volume,
               CAST(instrument_id AS VARCHAR) AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts_event FROM priced WHERE price IS NOT NULL""",
)
def b9b(spark, d):
    """Bars from snapshots: prices and volumes are missing, NaN or sentinels for some."""
    raw = snapshots(spark, d).select(
        F.col("instrument_id").cast("string").alias("market"), F.col("bid").alias("open"), F.col("ask").alias("high"),
        F.when(F.col("l_suppkey") % 3 == 0, F.col("bid")).alias("low"), "last", "close",
        F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey").cast("double")).otherwise(F.lit(float("nan"))).alias("volume"), "l_shipdate",
    )
    return vendor.snapshot_bars(raw, F.col("l_shipdate"))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Quotes with missing, NaN and sentinel values."""
    nan, line, supp = F.lit(float("nan")), F.col("l_linenumber"), F.col("l_suppkey")
    return tables.quotes(spark, d).select(
        "l_shipdate", "l_orderkey", "l_linenumber", "instrument_id", "l_suppkey",
        F.when(line % 3 != 0, F.col("bid")).alias("bid"),
        F.when(line % 2 == 0, F.col("ask")).otherwise(nan).alias("ask"),
        F.when(supp % 5 == 0, F.lit(-1.0)).when(supp % 5 != 1, F.col("bid") + 1).alias("last"),
        F.when(supp % 4 == 0, nan).otherwise(F.col("bid") + 2).alias("close"),
    )


@query(
    "b10_nan_default",
    f"""WITH snap AS ({_SNAP})
        SELECT l_linenumber, l_suppkey, count(*) AS n, round(sum(coalesce(bid, 0)), 2) + 0.0 AS bid,
               round(sum(CASE WHEN isnan(ask) THEN 0 ELSE ask END), 2) + 0.0 AS ask,
               round(sum(CASE WHEN isnan(close) THEN -5.0 ELSE close END), 2) AS close
        FROM snap GROUP BY 1, 2""",
)
def b10(spark, d):
    total = lambda name, default=0.0: r6(F.sum(q.nan_default(F.col(name), default)), 2).alias(name)
    return snapshots(spark, d).groupBy("l_linenumber", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), total("bid"), total("ask"), total("close", -5.0)
    )


_LISTED = """SELECT instrument_id, market, strike, CAST(expiry AS DATE) AS expiry, is_call FROM v_defs"""


def listed(spark: SparkSession, d: str) -> DataFrame:
    return tables.definitions(spark, d).select(
        "instrument_id", "market", "strike", F.col("expiry").cast("date").alias("expiry"),
        (F.col("instrument_class") == "C").alias("is_call"),
    )


@query(
    "b11_chain_universe",
    f"""WITH listed AS ({_LISTED}),
        ranked AS (SELECT *, dense_rank() OVER (PARTITION BY market ORDER BY expiry) AS r FROM listed)
        SELECT instrument_id, market, strike, expiry FROM ranked WHERE r <= 3 AND abs(strike - 950.0) <= 15.0""",
)
def b11(spark, d):
    return chain.universe(listed(spark, d), F.lit(950.0), F.lit(config.CHAIN_STRIKE_RANGE)).select(
        "instrument_id", "market", "strike", "expiry"
    )


@query(
    "b12_chain_grid",
    f"""WITH listed AS ({_LISTED}),
        e AS (SELECT DISTINCT market, expiry FROM (SELECT *, dense_rank() OVER (PARTITION BY market ORDER BY expiry) AS r FROM listed) WHERE r <= 3),
        s AS (SELECT DISTINCT market, strike FROM listed WHERE abs(strike - 950.0) <= 15.0)
        SELECT market, expiry, strike, "right" FROM e JOIN s USING (market), (VALUES ('C'), ('P')) AS t("right")""",
)
def b12(spark, d):
    rows = listed(spark, d)
    near = rows.where(F.abs(F.col("strike") - 950.0) <= config.CHAIN_STRIKE_RANGE)
    front = chain.universe(rows, F.lit(0.0), F.lit(float("inf")))
    return chain.contract_grid(
        front.select("market", "expiry").distinct(), near.select("market", "strike").distinct()
    )


@query(
    "b13_revision_window",
    """SELECT market, report_date, report_date >= DATE '2001-06-05' - 28 AS is_revision_window FROM v_cot""",
)
def b13(spark, d):
    rows = vendor.cot_enrich(tables.cot_reports(spark, d), F.lit("2001-06-05").cast("date"))
    return rows.select("market", "report_date", "is_revision_window")
