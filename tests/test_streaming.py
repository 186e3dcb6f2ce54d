"""Streams against their batch twins and plain loops."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift
from tidemark.streaming import detectors, ingest

SCHEMA = "metric string, ts timestamp_ntz, event_id long, x double"


@pytest.fixture(scope="module")
def shifted(spark):
    """Two metrics; one jumps half-way.  Landed as several files, one file per batch."""
    rng = np.random.default_rng(0)
    rows = []
    for name, late in (("calm", 0.0), ("jump", 3.0)):
        for i in range(600):
            rows.append((name, datetime(2026, 1, 1) + timedelta(minutes=i), i, float(rng.normal(0, 0.3) + (late if i >= 300 else 0.0))))
    path = ingest.scratch(spark, "shifted")
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(4):  # in time order, several micro-batches
        df.where(F.floor(F.col("event_id") / 150) == k).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return rows, df, path


def stream(spark, path, **options):
    return spark.readStream.schema(SCHEMA).options(**(options or {"maxFilesPerTrigger": 1})).parquet(f"{path}/*")


def test_stream_equals_batch_cusum(spark, shifted):
    _, df, path = shifted
    got = detectors.cusum_stream(stream(spark, path), ingest.scratch(spark, "t-cusum")).orderBy("metric", "event_id").toPandas()
    want = drift.cusum(df, ["metric"], ["ts", "event_id"], F.date_trunc("hour", "ts")).orderBy("metric", "event_id").toPandas()
    assert len(got) == len(want) == 1200
    np.testing.assert_allclose(got.s_pos, want.s_pos, atol=1e-9)
    np.testing.assert_allclose(got.s_neg, want.s_neg, atol=1e-9)
    assert got.cusum_alert.tolist() == want.alert.tolist() and got.s_pos.max() > 5


def test_file_order_and_batch_size_do_not_matter(spark, shifted):
    _, df, path = shifted
    mixed = ingest.scratch(spark, "t-mixed")
    for k in (2, 0, 3, 1):  # rows dealt out across files, landed out of order
        df.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(f"{mixed}/{k}")
    tables = [
        detectors.metric_alerts(stream(spark, p, maxBytesPerTrigger=size), ingest.scratch(spark, "t-size")).orderBy("metric", "event_id").toPandas()
        for p, size in ((path, 1 << 30), (mixed, 1), (mixed, 1 << 30))
    ]
    for other in tables[1:]:
        assert other.equals(tables[0])


def test_detectors_go_on_hold_back_and_put_late_rows_aside(spark, shifted):
    rows, df, path = shifted
    whole = detectors.metric_alerts(stream(spark, path), ingest.scratch(spark, "t-whole")).orderBy("metric", "event_id").toPandas()
    land, root = ingest.scratch(spark, "t-parts"), ingest.scratch(spark, "t-going")
    late = (df["metric"] == "calm") & (df["event_id"] == 10)
    df.where((df["event_id"] < 400) & ~late).write.parquet(f"{land}/a")
    first = detectors.metric_alerts(stream(spark, land), root, until=rows[299][1])
    assert first.count() == 599 and detectors.late_rows(spark, root).count() == 0
    df.where((df["event_id"] >= 400) | late).write.parquet(f"{land}/b")
    for _ in range(2):  # the second call finds nothing new
        got = detectors.metric_alerts(stream(spark, land), root)
        assert got.count() == 1199 and [r["event_id"] for r in detectors.late_rows(spark, root).collect()] == [10]
    jump = got.where("metric = 'jump'").orderBy("event_id").toPandas()
    alone = whole[whole.metric == "jump"].reset_index(drop=True)
    sums = ["s_pos", "s_neg"]  # taken on from a stored sum: the same but for rounding
    np.testing.assert_allclose(jump[sums], alone[sums], atol=1e-9)
    assert jump.drop(columns=sums).equals(alone.drop(columns=sums))


def test_reset_starts_anew(spark):
    row = lambda i, x: ("m", datetime(2026, 1, 1) + timedelta(minutes=i), i, x)
    land, root = ingest.scratch(spark, "t-reset-land"), ingest.scratch(spark, "t-reset")
    spark.createDataFrame([row(i, 2.0) for i in range(10)], SCHEMA).write.parquet(f"{land}/a")
    assert detectors.cusum_stream(stream(spark, land), root).where("cusum_alert").count() > 0
    detectors.reset(spark, root, ["m"])
    spark.createDataFrame([row(10, 0.0), row(11, None)], SCHEMA).write.parquet(f"{land}/b")
    got = detectors.cusum_stream(stream(spark, land), root).orderBy("event_id").collect()
    assert len(got) == 12 and all(r["s_pos"] == 0 and not r["cusum_alert"] for r in got[10:])


def test_adwin_sees_the_jump_only(spark, shifted):
    _, _, path = shifted
    got = detectors.metric_alerts(stream(spark, path), ingest.scratch(spark, "t-adwin")).toPandas()
    hits = got[got.adwin_alert]
    assert set(hits.metric) == {"jump"} and hits.event_id.min() in range(300, 340)
    last = got[(got.metric == "jump") & (got.event_id == 599)].iloc[0]
    assert last.window_mean == pytest.approx(3.0, abs=0.1) and last.n_detections == len(hits)
    assert (got.alert == (got.adwin_alert | got.cusum_alert)).all()


def test_adaptive_window_keeps_exact_sums():
    rng = np.random.default_rng(1)
    window = detectors.AdaptiveWindow(0.002, 30)
    values = rng.normal(5, 1, 500)
    for v in values:
        assert not window.update(float(v))
    assert window.width == 500 and window.mean == pytest.approx(values.mean())
    assert window._spread() == pytest.approx(values.var(), rel=1e-9)


def test_grace_period_holds_back_detection():
    window = detectors.AdaptiveWindow(0.002, 10_000)
    assert not any(window.update(v) for v in [0.0] * 200 + [100.0] * 200)


BAR = "market string, open double, high double, low double, close double, volume long, symbol string, ts_event timestamp_ntz"


def test_incremental_ingest_keeps_its_position(spark):
    day = lambda n: spark.createDataFrame([
        ("A", 1.0, 2.0, 1.0, 1.5, 10, "A", datetime(2026, 1, n)), ("A", 1.0, 1.0, 2.0, 1.5, 10, "A", datetime(2026, 1, n)),
    ], BAR)
    path, other, root = (ingest.scratch(spark, n) for n in ("t-land", "t-land-2", "t-out"))
    day(1).write.parquet(path)
    schema = day(1).schema
    counts = lambda: tuple(
        t.count() for t in (ingest.bars(spark, root, schema), ingest.quarantine(spark, root, schema), ingest.bar_features(spark, root))
    )
    assert counts() == (0, 0, 0)
    for size in (1 << 30, 1):  # a repeated run adds nothing
        ingest.ingest_bars(ingest.read_landing(spark, path, schema, max_bytes=size), root)
        assert counts() == (1, 1, 1)
    assert ingest.quarantine(spark, root, schema).first()["reasons"] == ["high<low", "close_outside_range"]
    feature = ingest.bar_features(spark, root).first()
    assert (feature["feature_name"], feature["value"]) == ("futures_close_A", 1.5)
    day(2).write.mode("append").parquet(path)  # the next day, same folder
    ingest.ingest_bars(ingest.read_landing(spark, path, schema), root)
    assert counts() == (2, 2, 2)
    day(3).write.parquet(other)  # another folder into the same target
    ingest.ingest_bars(ingest.read_landing(spark, other, schema), root, source="other")
    assert counts() == (3, 3, 3)


def test_live_counts_hold_every_row(spark, shifted):
    _, df, path = shifted
    want = {(r["ts"], r["metric"], 1) for r in df.collect()}
    for options in ({"maxBytesPerTrigger": 1}, {"maxBytesPerTrigger": 1 << 30}):
        root = ingest.scratch(spark, "t-counts")
        for _ in range(2):  # a second run counts nothing twice
            got = ingest.live_counts(stream(spark, path, **options), root, "ts", F.col("metric")).collect()
            assert len(got) == 1200 and {tuple(r) for r in got} == want


def test_later_write_wins_even_when_lower(spark):
    from tidemark.operators import features
    from tidemark.operators.ingest import backfill
    from tidemark.operators.validate import BAR_RULES

    root = ingest.scratch(spark, "t-backfill")
    for close in (10.0, 9.0):
        bar = spark.createDataFrame([("A", 9.0, 11.0, 8.0, close, 10, "A", datetime(2026, 1, 1))], BAR)
        got = backfill(bar, "ts_event", "2026-01-01", "2026-01-02", BAR_RULES, root, features.close_features)
    assert [r["value"] for r in got.collect()] == [9.0]


def test_cusum_goes_on_in_cells_and_reads_new_batches_only(spark, shifted, monkeypatch):
    """One metric shared by many cells, over three runs; each run reads what landed since the last."""
    from tidemark.operators import cells, ordered

    _, df, _ = shifted
    monkeypatch.setattr(ordered, "counted_cells", lambda d, k, o, n=40: cells.counted_cells(d, k, o, 40))
    land, root = ingest.scratch(spark, "t-cells"), ingest.scratch(spark, "t-cells-out")
    for i, low in enumerate((0, 200, 400)):
        df.where((F.col("event_id") >= low) & (F.col("event_id") < low + 200)).write.parquet(f"{land}/{i}")
        detectors.cusum_stream(stream(spark, land), root)
        folded = spark.read.parquet(f"{root}/folded/version={i + 1}")
        assert folded.where("NOT is_state").count() == 400 and folded.where("is_state").count() == 2
    got = detectors.cusum_stream(stream(spark, land), root).orderBy("metric", "event_id").toPandas()
    want = drift.cusum(df, ["metric"], ["ts", "event_id"]).orderBy("metric", "event_id").toPandas()
    assert len(got) == 1200
    np.testing.assert_allclose(got[["s_pos", "s_neg"]], want[["s_pos", "s_neg"]], atol=1e-9)
    assert got.cusum_alert.tolist() == want.alert.tolist()


def test_held_rows_are_folded_later(spark, shifted):
    rows, df, path = shifted
    root = ingest.scratch(spark, "t-held")
    for k, n in ((99, 200), (299, 600), (None, 1200)):
        got = detectors.cusum_stream(stream(spark, path), root, until=None if k is None else rows[k][1])
        assert got.count() == n
    want = drift.cusum(df, ["metric"], ["ts", "event_id"]).orderBy("metric", "event_id").toPandas()
    np.testing.assert_allclose(got.orderBy("metric", "event_id").toPandas()[["s_pos", "s_neg"]], want[["s_pos", "s_neg"]], atol=1e-9)


def test_revisions_rewrite_touched_folders_only(spark):
    schema = "market string, feature_name string, as_of timestamp_ntz, value double, ingested_at long"
    day = lambda m, d: datetime(2026, m, d)
    first = [(k, f, day(m, 1), float(m), 1) for k in ("A", "B", None) for f in ("x", "y") for m in (1, 2, 3)]
    land, root = ingest.scratch(spark, "t-rev-land"), ingest.scratch(spark, "t-rev")
    path = lambda i: f"{land}/{i}"
    run = lambda: ingest.merge_revisions(ingest.read_landing(spark, f"{land}/*", spark.createDataFrame([], schema).schema), root)
    state = lambda rows: sorted((tuple(r) for r in rows.collect()), key=repr)
    spark.createDataFrame(first, schema).write.parquet(path(0))
    assert state(run()) == sorted(first, key=repr)
    before = {f for f in run().inputFiles()}
    # one key corrected, one write that is older than what is stored, one new month; then the same again
    spark.createDataFrame([("A", "x", day(2, 1), 9.0, 5), ("B", "y", day(3, 1), -1.0, 0), ("B", "y", day(4, 1), 4.0, 1)], schema).write.parquet(path(1))
    want = [r for r in first if r[:3] != ("A", "x", day(2, 1))] + [("A", "x", day(2, 1), 9.0, 5), ("B", "y", day(4, 1), 4.0, 1)]
    for _ in range(2):
        got = run()
        assert state(got) == sorted(want, key=repr)
    after = {f for f in got.inputFiles()}
    folder = lambda f: f.split("/data/", 1)[1].split("/", 1)[1].rsplit("/", 1)[0]
    rewritten = {folder(f) for f in after - before}
    assert len(rewritten) == 3 and {f.split("/")[0] for f in rewritten} == {"month=202602", "month=202603", "month=202604"}
    assert before & after
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_compacted_store_prunes_and_ignores_a_retried_batch(spark):
    from tidemark.sources import compacted

    schema = "market string, feature_name string, as_of timestamp_ntz, value double, seq long"
    root = ingest.scratch(spark, "t-compacted")
    rows = [(k, "x", datetime(2026, m, 5), float(m), 1) for k in "ABCDEFGH" for m in range(1, 7)]
    df = spark.createDataFrame(rows, schema)
    assert compacted.read(spark, root, df.schema).count() == 0
    assert compacted.merge(spark, root, df, "seq", "source=a/batch=0") == 1
    assert compacted.merge(spark, root, df.withColumn("seq", F.lit(9)), "seq", "source=a/batch=0") == 1
    assert compacted.merge(spark, root, df.limit(0), "seq", "source=a/batch=1") == 2
    part = compacted.read(spark, root, df.schema, ("202602", "202603"))
    assert part.count() == 16 and all("month=20260" in f and f.split("month=2026")[1][:2] in ("02", "03") for f in part.inputFiles())
    one = compacted.read(spark, root, df.schema, pairs=[("C", "x")])
    assert {r["market"] for r in one.collect()} == {"C"} and one.count() == 6 and len({f.split("bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1


def test_sums_do_not_feel_what_went_before(spark):
    """25 steps of 0.2 reach 5 exactly, which is no alert, however far the plain sum of steps has gone; the next step is one."""
    rows = [("m", i, -1e8 if i == 0 else 0.7) for i in range(27)]
    df = spark.createDataFrame(rows, "metric string, i long, x double")
    for cell in (None, F.floor(F.col("i") / 5)):
        got = drift.cusum(df, ["metric"], ["i"], cell).orderBy("i").toPandas()
        np.testing.assert_allclose(got.s_pos, [0.0, *(0.2 * k for k in range(1, 27))], atol=1e-12)
        assert got.alert.tolist()[1:] == (got.s_neg > 5).tolist()[1:] and got.s_neg.min() > 5
        up = drift.beyond(F.col("s_pos"), 5.0)
        alerts = drift.cusum(df, ["metric"], ["i"], cell).orderBy("i").select(up.alias("a")).toPandas().a.tolist()
        assert alerts == [False] * 26 + [True]


def test_adaptive_window_costs_a_constant_number_of_steps():
    """Buckets stay in order and bounded per level, also from stored ones on; a value looks at no other bucket than those it merges."""
    rng = np.random.default_rng(2)
    values = [*rng.normal(0, 1, 3000).tolist(), *rng.normal(3, 1, 3000).tolist()]
    whole, part = detectors.AdaptiveWindow(0.002, 30), detectors.AdaptiveWindow(0.002, 30)
    drifted, means = whole.extend(values)
    first = part.extend(values[:1234])
    resumed = detectors.AdaptiveWindow(0.002, 30, part.buckets, part.since)
    second = resumed.extend(values[1234:])
    assert (drifted, means) == (first[0] + second[0], first[1] + second[1]) and any(drifted)
    assert whole.buckets == resumed.buckets and whole.levels == sorted(whole.levels, reverse=True)
    assert max(np.bincount(whole.levels)) <= detectors.BUCKETS_PER_LEVEL and whole.width == sum(1 << k for k in whole.levels)
