"""Group I: streaming operators, drained over everything that has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ledger import pnl_ledger
from tidemark.plans import ledger_sql
from tidemark.plans.aggregates import CUSUM_SQL
from tidemark.plans.landing import _BAR_OK, reports
from tidemark.plans.models import replay_input
from tidemark.plans.registry import query, r6
from tidemark.sources import tables
from tidemark.streaming import detectors, ingest


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    return ingest.read_landing(spark, d, tables.table(spark, d, "events").schema, "events.parquet")


def metric_stream(spark: SparkSession, d: str) -> DataFrame:
    return tables.metric_stream_columns(event_stream(spark, d))


@query(
    "i1_cusum_stream",
    f"WITH {CUSUM_SQL} SELECT metric, ts, event_id, round(s_pos, 6) + 0.0 AS s_pos, round(s_neg, 6) + 0.0 AS s_neg, s_pos > 5 OR s_neg > 5 AS cusum_alert FROM cusum",
)
def i1(spark, d):
    found = detectors.cusum_stream(metric_stream(spark, d), ingest.scratch(spark, "cusum"))
    return found.select("metric", "ts", "event_id", r6(F.col("s_pos")).alias("s_pos"), r6(F.col("s_neg")).alias("s_neg"), "cusum_alert")


@query("i2_adwin_stream")
def i2(spark, d):
    return detectors.adwin_stream(metric_stream(spark, d), ingest.scratch(spark, "adwin"))


@query("i3_metric_alerts")
def i3(spark, d):
    found = detectors.metric_alerts(metric_stream(spark, d), ingest.scratch(spark, "alerts"))
    return found.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("cusum_alert").alias("n_cusum"), F.count_if("adwin_alert").alias("n_adwin"),
        F.count_if("alert").alias("n_alerts"),
    )


def landed(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A landing folder with the rows of ``df`` and a stream that reads it."""
    path = ingest.scratch(spark, name)
    df.write.parquet(path)
    return ingest.read_landing(spark, path, df.schema)


@query(
    "i4_incremental_ingest",
    f"""SELECT market, count(*) FILTER ({_BAR_OK}) AS n_bars, count(*) FILTER (NOT {_BAR_OK}) AS n_quarantined, count(*) FILTER ({_BAR_OK}) AS n_features
        FROM v_trades GROUP BY market""",
)
def i4(spark, d):
    raw = tables.trades(spark, d).withColumn("symbol", F.col("market")).withColumnRenamed("ts", "ts_event")
    root = ingest.scratch(spark, "incremental")
    ingest.ingest_bars(landed(spark, raw, "landing-bars"), root)
    count = lambda rows, out: rows.groupBy("market").agg(F.count(F.lit(1)).alias(out))
    return (
        count(ingest.bars(spark, root, raw.schema), "n_bars")
        .join(count(ingest.quarantine(spark, root, raw.schema), "n_quarantined"), "market", "full")
        .join(count(ingest.bar_features(spark, root), "n_features"), "market", "full")
    )


@query(
    "i5_revision_merge",
    """SELECT market, CAST(report_date AS TIMESTAMP) AS as_of, round(CASE WHEN report_date >= DATE '2001-07-03' THEN managed_money_net + 1000 ELSE managed_money_net END, 2) + 0.0 AS value
       FROM v_reports""",
)
def i5(spark, d):
    """First prints, then corrections of the last four weeks.  One bucket a month: four keys a market."""
    rows = reports(spark, d)
    first = rows.select(
        "market", F.lit("cot_managed_money_net").alias("feature_name"), F.col("report_date").cast("timestamp_ntz").alias("as_of"),
        "available_at", F.col("managed_money_net").alias("value"), F.col("available_at").alias("ingested_at"),
    )
    late = first.where(rows["is_revision_window"]).select(
        "market", "feature_name", "as_of", "available_at", (F.col("value") + 1000).alias("value"),
        (F.col("ingested_at") + F.expr("INTERVAL 28 DAYS")).alias("ingested_at"),
    )
    merged = ingest.merge_revisions(
        landed(spark, first.unionByName(late), "landing-revisions"), ingest.scratch(spark, "revisions"), buckets=1
    )
    return merged.select("market", "as_of", r6(F.col("value"), 2).alias("value"))


@query(
    "i6_trade_stream_monitor",
    f"""WITH {ledger_sql.REPLAY}, v AS (SELECT market || '/' || run_id AS metric, ts, net_return * 200 AS x FROM led WHERE traded),
        c AS (SELECT *, sum(x - 0.5) OVER w AS cp, sum(-x - 0.5) OVER w AS cn FROM v WINDOW w AS (PARTITION BY metric ORDER BY ts)),
        s AS (SELECT metric, ts, cp - least(0.0, min(cp) OVER w) AS s_pos, cn - least(0.0, min(cn) OVER w) AS s_neg FROM c WINDOW w AS (PARTITION BY metric ORDER BY ts))
        SELECT metric, ts, round(s_pos, 6) + 0.0 AS s_pos, round(s_neg, 6) + 0.0 AS s_neg, s_pos > 5 OR s_neg > 5 AS cusum_alert FROM s""",
)
def i6(spark, d):
    """Ledger rows of traded bars as a stream of net returns per series into the detector of level shifts."""
    ledger = pnl_ledger(replay_input(spark, d), ["market", "run_id"], ["ts"]).where("traded")
    trades = ledger.select(
        F.concat_ws("/", "market", "run_id").alias("metric"), "ts", F.lit(0).cast("long").alias("event_id"),  # one row per series and bar
        (F.col("net_return") * 200).alias("x"),
    )
    found = detectors.cusum_stream(landed(spark, trades, "landing-ledger"), ingest.scratch(spark, "trade-alerts"))
    return found.select("metric", "ts", r6(F.col("s_pos")).alias("s_pos"), r6(F.col("s_neg")).alias("s_neg"), "cusum_alert")


@query(
    "i7_live_counts",
    """SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS window_start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2""",
)
def i7(spark, d):
    """All minutes, the open ones too."""
    return ingest.live_counts(event_stream(spark, d), ingest.scratch(spark, "live-counts"), "ts", F.col("event_type"))
