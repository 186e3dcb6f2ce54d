"""Readers for the star-schema tables and the views built on them.

Each view gives a table of the engine's own shape (bars, reports, quotes, ...)
derived by Spark from the whole source table, so its size follows the data.
Only the columns a view needs reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.black76 import with_call_price
from tidemark.functions.risk import slippage

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
CHAIN_FORWARD = 100.0
CHAIN_RATE = 0.05
CHAIN_DAY = "2024-03-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly OHLCV bars per part type."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("market"))
    priced = (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "market",
            F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("ts"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            "l_quantity",
            F.struct(*LINE_ORDER).alias("seq"),
        )
    )
    return priced.groupBy("market", "ts").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-trade bars, one per line item, with some rows broken on purpose for validation.

    The discount and tax columns shift high, low and volume so that each
    validation rule is met by some rows of the whole table.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("market"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "market",
            F.col("l_shipdate").alias("ts"),
            *[F.col(c) for c in LINE_ORDER[1:]],
            (price * (F.col("l_tax") * 100 - 1)).alias("open"),
            (price * (1 + F.col("l_discount") - F.col("l_tax"))).alias("high"),
            (price * (1 - F.col("l_discount"))).alias("low"),
            price.alias("close"),
            (F.col("l_quantity") - 3).cast("long").alias("volume"),
        )
    )


def cot_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly positions per customer segment, dated on Tuesdays."""
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("market")
    )
    group = F.substring("o_orderpriority", 1, 1)
    price = F.col("o_totalprice")
    is_long, is_short = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"

    def held(members: list[str], side) -> Column:
        return F.coalesce(F.sum(F.when(group.isin(members) & side, price)), F.lit(0.0))

    return (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn(
            "report_date", F.date_add(F.date_trunc("week", "o_orderdate").cast("date"), 1)
        )
        .groupBy("market", "report_date")
        .agg(
            held(["1", "2"], is_long).alias("managed_money_long"),
            held(["1", "2"], is_short).alias("managed_money_short"),
            held(["3"], is_long).alias("producer_long"),
            held(["3"], is_short).alias("producer_short"),
            held(["4", "5"], is_long).alias("swap_long"),
            held(["4", "5"], is_short).alias("swap_short"),
            F.sum(price).alias("total_oi"),
        )
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal observations with repeated primary keys; ``seq`` is the write order."""
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("market")
    )
    orders = (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "market", "o_orderdate")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "market",
            F.concat("l_returnflag", "l_linestatus").alias("feature_name"),
            F.least("o_orderdate", "l_shipdate").alias("as_of"),
            F.greatest("o_orderdate", "l_shipdate").alias("available_at"),
            F.col("l_extendedprice").alias("value"),
            F.lit("normal").alias("quality"),
            F.struct(*LINE_ORDER).alias("seq"),
        )
    )


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option quotes with a known volatility per row, 42 quotes per market."""
    key = F.col("p_partkey")
    slot = F.pmod(key, F.lit(42))
    market = F.floor(key / 42)
    strike = F.lit(80.0) + 2.0 * F.floor(slot / 2)
    logk = F.log(F.col("strike") / CHAIN_FORWARD)
    size = F.col("p_size")
    base = (
        table(spark, sf_dir, "part")
        .select("p_partkey", "p_size")
        .select(
            market.alias("market_no"),
            F.concat(F.lit("M"), market.cast("string")).alias("market"),
            F.col("p_partkey").alias("quote_id"),
            strike.alias("strike"),
            (F.pmod(slot, F.lit(2)) == 0).alias("is_call"),
            F.col("p_size"),
        )
        .withColumn("as_of", F.lit(CHAIN_DAY).cast("date"))
        .withColumn("days", (30 + 30 * F.pmod("market_no", F.lit(3))).cast("int"))
        .withColumn("expiry", F.date_add("as_of", F.col("days")))
        .withColumn("t", F.col("days") / 365.0)
        .withColumn(
            "sigma", 0.20 + 0.01 * F.pmod("market_no", F.lit(10)) - 0.15 * logk + 0.5 * logk * logk
        )
        .withColumn(
            "oi",
            F.when(F.pmod("market_no", F.lit(7)) == 6, size / 10.0)
            .when(F.pmod("market_no", F.lit(5)) == 4, size.cast("double"))
            .otherwise(size * 10.0),
        )
    )
    rate, forward = F.lit(CHAIN_RATE), F.lit(CHAIN_FORWARD)
    priced = with_call_price(base, forward, F.col("strike"), rate, F.col("t"), F.col("sigma"), "_call")
    fair = F.when(F.col("is_call"), F.col("_call")).otherwise(
        F.col("_call") - F.exp(-rate * F.col("t")) * (forward - F.col("strike"))
    )
    width = 0.02 + size / 500.0
    return (
        priced.withColumn("fair", fair)
        .withColumn("bid", F.col("fair") * (1 - width / 2))
        .withColumn("ask", F.col("fair") * (1 + width / 2))
        .withColumn("spot", forward)
        .drop("_call", "days", "p_size")
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-of-book rows, one per line item."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("instrument_id"),
        (price * (1 - F.col("l_discount") / 2)).alias("bid"),
        (price * (1 + F.col("l_tax") / 2)).alias("ask"),
        F.col("l_quantity").cast("long").alias("bid_size"),
        (F.col("l_quantity") + 1).cast("long").alias("ask_size"),
        F.col("l_linenumber").cast("long").alias("volume"),
        *[F.col(c) for c in LINE_ORDER if c != "l_partkey"],
    )


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument definitions, one per part."""
    return (
        table(spark, sf_dir, "part")
        .select(
            F.col("p_partkey").alias("instrument_id"),
            F.col("p_retailprice").alias("strike"),
            F.date_format(
                F.date_add(F.lit("1998-01-01").cast("date"), (F.col("p_size") * 30).cast("int")),
                "yyyy-MM-dd",
            ).alias("expiry"),
            F.when(F.pmod("p_size", F.lit(2)) == 0, "C").otherwise("P").alias("instrument_class"),
            F.col("p_type").alias("market"),
            F.col("p_size").alias("seq"),
        )
    )


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open interest per instrument and line status; the later status wins."""
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.pmod("l_partkey", F.lit(7)) != 0)
        .groupBy(F.col("l_partkey").alias("instrument_id"), F.col("l_linestatus").alias("seq"))
        .agg(F.sum("l_quantity").alias("open_interest"))
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills with predicted and actual slippage, one per line item."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("symbol"), F.col("p_retailprice").alias("order_price")
    )
    spread = F.col("order_price") * 0.002
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_shipdate").alias("timestamp"),
            "symbol",
            F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("direction"),
            F.col("l_quantity").cast("long").alias("n_contracts"),
            "order_price",
            (F.col("order_price") * (1 + (F.col("l_discount") - F.col("l_tax")) / 10)).alias("fill_price"),
            slippage(F.col("l_quantity"), F.lit(5000.0), spread, F.lit(0.02)).alias("predicted_slippage"),
            F.lit(5000.0).alias("volume_at_fill"),
            spread.alias("spread_at_fill"),
            F.lit(100.0).alias("fill_latency_ms"),
            F.col("l_orderkey").alias("order_id"),
            *[F.col(c) for c in LINE_ORDER[1:]],
        )
        .withColumn("actual_slippage", F.abs(F.col("fill_price") - F.col("order_price")))
    )


FILL_ORDER = ["timestamp", "order_id", "l_linenumber", "l_partkey", "l_suppkey"]


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment log; JSON columns are still text, as landed."""
    user = F.concat(F.lit("u"), F.pmod("user_id", F.lit(5)).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("try "), F.col("event_type")).alias("hypothesis"),
        F.col("event_type").alias("mutation_type"),
        F.concat(F.lit('{"v": '), F.col("user_id").cast("string"), F.lit("}")).alias("config_diff"),
        F.col("props").alias("results"),
        F.when(F.col("value") > 66, "promoted")
        .when(F.col("value") < 33, "rejected")
        .otherwise("pending")
        .alias("promotion_decision"),
        F.concat(F.lit('["'), F.col("event_type"), F.lit('", "'), user, F.lit('"]')).alias("tags"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows per model with the realised outcome and the period return."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"),
        "ts",
        "event_id",
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("p"),
        F.pmod("event_id", F.lit(2)).cast("int").alias("actual"),
        F.pmod("event_id", F.lit(5)).cast("int").alias("window"),
        ((F.col("value") - 50.0) / 5000.0).alias("ret"),
    )


DRIFT_SPLIT = "2024-01-16"


def drift_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline and current sample of one value per feature."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("feature"),
        F.col("value").alias("x"),
        (F.col("ts") >= F.lit(DRIFT_SPLIT).cast("timestamp_ntz")).alias("is_current"),
    )


def metric_stream_columns(events: DataFrame) -> DataFrame:
    """Metric stream from an events frame, batch or streaming."""
    return events.select(
        F.col("event_type").alias("metric"),
        F.col("ts"),
        F.col("event_id"),
        ((F.col("value") - 50.0) / 50.0).alias("x"),
    )


def metric_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_stream_columns(table(spark, sf_dir, "events"))
