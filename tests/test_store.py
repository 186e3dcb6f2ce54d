"""Bitemporal store, lake, validation and report normalisation."""

from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import features, quality, validate
from tidemark.sources import journals, lake, markets, vendor

STORE = "market string, feature_name string, as_of timestamp_ntz, available_at timestamp_ntz, value double"


def one(spark):
    return spark.createDataFrame([("HE", "cot", datetime(2026, 2, 10), datetime(2026, 2, 13, 20, 30), 12345.0)], STORE)


@pytest.mark.parametrize(
    "when,seen",
    [(datetime(2026, 2, 11), False), (datetime(2026, 2, 14), True), (datetime(2026, 2, 13, 20, 30), True), (datetime(2026, 2, 13, 20, 29, 59), False)],
)
def test_visibility_boundary(spark, when, seen):
    assert (features.lookup(one(spark), when).count() == 1) == seen
    probes = spark.createDataFrame([("HE", when)], "market string, ts timestamp_ntz")
    value = features.matrix(one(spark), probes, ["cot"]).first()["cot"]
    assert (value == 12345.0) if seen else (value is None)


def test_upsert_keeps_last_write(spark):
    rows = [("HE", "f", datetime(2026, 1, 1), datetime(2026, 1, 2), float(v), v) for v in (1, 3, 2)]
    df = spark.createDataFrame(rows, STORE + ", seq int")
    assert features.upsert(df, F.col("seq")).first()["value"] == 3.0


def test_matrix_never_looks_ahead(spark):
    """Random bitemporal rows: the one-pass matrix equals a per-probe brute force."""
    rng = np.random.default_rng(1)
    start = np.datetime64("2024-01-01")
    rows = []
    for m in ("A", "B"):
        for f in ("x", "y", "z"):
            for k in range(60):
                as_of = start + np.timedelta64(int(rng.integers(0, 200)), "D")
                rows.append((m, f, as_of, as_of + np.timedelta64(int(rng.integers(0, 40)), "D"), float(k)))
    pdf = pd.DataFrame(rows, columns=["market", "feature_name", "as_of", "available_at", "value"])
    pdf = pdf.drop_duplicates(["market", "feature_name", "as_of"], keep="last")
    times = [start + np.timedelta64(int(d), "D") for d in range(0, 260, 9)]
    probes = [(m, pd.Timestamp(t).to_pydatetime()) for m in ("A", "B", "C") for t in times]
    df = spark.createDataFrame(pdf, STORE)
    got = features.matrix(df, spark.createDataFrame(probes, "market string, ts timestamp_ntz"), ["x", "y", "z"], F.date_trunc("week", "ts")).toPandas()
    assert len(got) == len(probes)
    for row in got.itertuples():
        for f in ("x", "y", "z"):
            seen = pdf[(pdf.market == row.market) & (pdf.feature_name == f) & (pdf.available_at <= row.ts)]
            value = getattr(row, f)
            if seen.empty:
                assert value is None or np.isnan(value)
            else:
                assert value == seen.loc[seen.as_of.idxmax(), "value"]


@pytest.mark.parametrize(
    "day,release",
    [("2026-02-17", "2026-02-20 20:30"), ("2026-02-20", "2026-02-27 20:30"), ("2026-02-21", "2026-02-27 20:30"), ("2026-02-19", "2026-02-20 20:30")],
)
def test_release_time(spark, day, release):
    got = spark.range(1).select(dates.release_time(F.lit(day).cast("date")).alias("t")).first()["t"]
    assert got == datetime.fromisoformat(release)


def test_weekdays_between_matches_stepping(spark):
    rng = np.random.default_rng(2)
    base = datetime(2026, 2, 1)
    pairs = []
    for _ in range(300):
        a = base + pd.Timedelta(hours=int(rng.integers(0, 24 * 20)))
        pairs.append((a, a + pd.Timedelta(hours=int(rng.integers(-50, 24 * 30)))))
    df = spark.createDataFrame([(pd.Timestamp(a).to_pydatetime(), pd.Timestamp(b).to_pydatetime()) for a, b in pairs], "a timestamp_ntz, b timestamp_ntz")
    for row in df.select("a", "b", dates.weekdays_between(F.col("a"), F.col("b")).alias("n")).collect():
        want, day = 0, row.a + pd.Timedelta(days=1)
        while day <= row.b:
            want += day.weekday() < 5
            day += pd.Timedelta(days=1)
        assert row.n == want


def test_report_date_spellings(spark):
    cases = {"2026-02-24": date(2026, 2, 24), " 260224 ": date(2026, 2, 24), "260224.0": date(2026, 2, 24), "40104": date(2004, 1, 4),
             "991231": date(1999, 12, 31), "bad": None, "": None, "2026-13-01": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    for row in df.select("s", dates.report_date(F.col("s")).alias("d")).collect():
        assert row.d == cases[row.s], row.s


def test_cot_normalize_filters_by_trimmed_code(spark):
    raw = spark.createDataFrame(
        [(" 054642 ", 260106, 10.0, 4.0, 100.0), ("999999", 260106, 1.0, 1.0, 1.0), ("054642", 0, 1.0, 1.0, 1.0)],
        "CFTC_Contract_Market_Code string, As_of_Date_In_Form_YYMMDD int, M_Money_Positions_Long_All double, M_Money_Positions_Short_All double, Open_Interest_All double",
    )
    rows = vendor.cot_normalize(raw, markets.market_dim(spark), F.lit("2026-01-20").cast("date")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.market, r.managed_money_net, r.total_oi, r.producer_net, r.is_revision_window) == ("HE", 6.0, 100.0, 0.0, True)
    assert r.available_at == datetime(2026, 1, 9, 20, 30)


def test_lake_append_and_scan(spark, tmp_path):
    rows = [("HE", 65.5, 65.5, 65.5, 65.5, 1200, "HEG6", datetime(2026, 1, 15)), ("HE", 65.75, 65.75, 65.75, 65.75, 800, "HEG6", datetime(2026, 3, 2))]
    df = spark.createDataFrame(rows, "market string, open double, high double, low double, close double, volume long, symbol string, ts_event timestamp_ntz")
    path = str(tmp_path / "lake")
    assert lake.scan(spark, path, "futures").count() == 0
    for _ in range(2):
        lake.append(df, path, "futures", F.col("ts_event"))
    assert lake.scan(spark, path, "futures", "HE").count() == 4
    assert lake.scan(spark, path, "futures", "ZC").count() == 0
    inside = lake.scan(spark, path, "futures", "HE", date(2026, 1, 31), date(2026, 2, 1))
    assert inside.count() == 2 and "year" not in inside.columns
    assert lake.scan(spark, path, "futures", "HE", date(2025, 12, 1), date(2026, 3, 1)).count() == 4
    # both ends given: the reader is told months, and lists nothing else
    told = lake.wanted_folders(path, "futures", "HE", date(2025, 12, 31), date(2026, 2, 1))
    assert told == path + "/data_type=futures/market=HE/{year=2025/month=12,year=2026/month=01,year=2026/month=02}"
    assert lake.scan(spark, path, "futures", None, date(2026, 1, 1), date(2026, 12, 1)).count() == 4
    assert lake.scan(spark, path, "futures", "HE", date(2026, 2, 1), date(2026, 1, 1)).count() == 0
    assert lake.scan(spark, path, "futures", "HE", date(2027, 1, 1), date(2027, 2, 1)).count() == 0
    assert lake.scan(spark, path, "futures", "HE", date(2026, 2, 1)).count() == 2
    assert lake.scan(spark, path, "futures", "HE", None, date(2026, 2, 1)).count() == 2
    odd = df.withColumn("market", F.lit("H=E [x]"))
    lake.append(odd, path, "futures", F.col("ts_event"))
    assert {r["market"] for r in lake.scan(spark, path, "futures", "H=E [x]", date(2026, 1, 1), date(2026, 3, 1)).collect()} == {"H=E [x]"}
    files = inside.inputFiles()
    assert len(files) == 2 and all("month=01" in f for f in files)


def test_bar_rules(spark):
    rows = [("ok", 1.0, 2.0, 1.0, 1.5, 0), ("wild_open", 9.0, 2.0, 1.0, 1.5, 0), ("high<low", 1.0, 1.0, 2.0, 1.5, 1), ("neg", -1.0, 2.0, 1.0, 1.5, -1)]
    df = spark.createDataFrame(rows, "name string, open double, high double, low double, close double, volume long")
    clean, broken = validate.split(df, validate.BAR_RULES)
    assert {r["name"] for r in clean.collect()} == {"ok", "wild_open"}
    reasons = {r["name"]: r["reasons"] for r in broken.collect()}
    assert reasons["neg"] == ["open<=0", "volume<0"]
    assert "high<low" in reasons["high<low"]


def test_quote_rules_allow_empty_ask(spark):
    df = spark.createDataFrame([(10.0, 1.0, 0.0), (10.0, 2.0, 1.0), (0.0, 1.0, 2.0)], "strike double, bid double, ask double")
    clean, _ = validate.split(df, validate.QUOTE_RULES)
    assert [r["ask"] for r in clean.collect()] == [0.0]


def test_staleness_over_a_weekend(spark):
    updates = spark.createDataFrame(
        [("HE", "futures", datetime(2026, 2, 13)), ("HE", "options", datetime(2026, 2, 11)), ("HE", "cot", datetime(2026, 2, 10))],
        "market string, source string, available_at timestamp_ntz",
    )
    now = F.lit("2026-02-16").cast("timestamp_ntz")
    got = {r["source"]: r for r in quality.staleness(updates, updates.select("market"), now).collect()}
    assert got["futures"]["days_since_update"] == 1 and not got["futures"]["is_stale"]
    assert got["options"]["days_since_update"] == 3 and got["options"]["is_stale"]
    assert got["cot"]["days_since_update"] == 6.0 and not got["cot"]["is_stale"]
    none = quality.staleness(updates.where("source = 'none'"), updates.select("market"), now)
    assert none.where(~F.col("is_stale")).count() == 0 and none.count() == 3


def test_journal_round_trip_and_ids(spark):
    df = spark.createDataFrame([(1, '{"lr": 0.05}', None, '["test"]', None)], "id int, config_diff string, champion_metrics string, tags string, metadata string")
    row = journals.decode_experiments(df).first()
    assert row["config_diff"] == {"lr": "0.05"} and row["champion_metrics"] is None and row["tags"] == ["test"] and row["metadata"] == {}
    fills = spark.createDataFrame([(datetime(2026, 1, d), d * 7 % 5) for d in range(1, 20)], "timestamp timestamp_ntz, order_id int")
    got = journals.with_fill_ids(fills, ["timestamp", "order_id"]).orderBy("timestamp").toPandas()
    assert got["id"].tolist() == list(range(1, 20))


def test_report_status_order(spark):
    stale = spark.createDataFrame([("A", "cot", True), ("B", "cot", False), ("C", "cot", False), ("D", "cot", False)], "market string, source string, is_stale boolean")
    chains = spark.createDataFrame([("A", 20, False), ("B", 20, True), ("C", 20, False)], "market string, liquid_strike_count int, has_arbitrage_violation boolean")
    got = {r["market"]: r["overall_status"] for r in quality.quality_report(stale, chains).collect()}
    assert got == {"A": "stale", "B": "degraded", "C": "healthy", "D": "degraded"}


def test_nulls_are_quarantined(spark):
    from tidemark.operators.validate import split, summary

    rules = {"close<=0": "close <= 0", "volume<0": "volume < 0"}
    df = spark.createDataFrame([("m", 1.0, 5.0), ("m", None, 5.0), ("m", -1.0, None)], "market string, close double, volume double")
    clean, bad = split(df, rules)
    assert [tuple(r) for r in clean.collect()] == [("m", 1.0, 5.0)]
    assert sorted(map(tuple, (r.reasons for r in bad.collect()))) == [("close<=0", "null: volume<0"), ("null: close<=0",)]
    row = summary(df, rules, ["market"]).first()
    assert (row.n_rows, row.n_valid, row.n_dropped) == (3, 1, 2)
