"""Keyed change detectors on metric streams.

A detector's answer depends on the order of its rows, while files land in no
promised order.  The stream therefore only appends what it reads (exactly once,
see ``ingest.run_batches``); ``advance`` then takes every metric on from where
it stood, in (ts, event_id) order.  So the result is the same for any order of
files and any size of micro-batches.  An advance reads the batches that no
earlier one has seen and the rows held back, not the history.  Rows that come in
behind a metric's position are kept in a side table, never folded out of order
or lost.

CUSUM is a scan: a stretch of rows acts on the sum as s -> max(a, s + b), and such
stretches compose.  So a metric is cut into cells, many tasks work on one metric,
and the state of the last run is the first row of the next.  The adaptive window
depends on each of its own detections; it streams through sorted batches, one
task per metric, which holds a handful of numbers and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config
from tidemark.operators.drift import beyond, cusum_sums
from tidemark.session import durable, task_count
from tidemark.streaming import ingest

ROW = "metric string, ts timestamp_ntz, event_id long, x double"
MARKS = (
    "s_pos double, s_neg double, cusum_alert boolean, adwin_alert boolean, n_detections long, window_mean double, alert boolean"
)
# what a metric carries from one run to the next: its position and both detectors
STATE = (
    "metric string, ts timestamp_ntz, event_id long, s_pos double, s_neg double, n_detections long, since_check long, "
    "levels array<int>, sums array<double>, spreads array<double>"
)
DETECTOR = ["s_pos", "s_neg", "n_detections", "since_check", "levels", "sums", "spreads"]

# --- fixed values: adaptive window settings
CLOCK, BUCKETS_PER_LEVEL, MIN_SIDE = 32, 5, 5


class AdaptiveWindow:
    """Adaptive windowing after Bifet and Gavalda (2007).

    The window is an exponential histogram: buckets hold 2^level values as
    (sum, sum of squared deviations).  Every ``CLOCK`` values each split between
    buckets is tested; the oldest bucket goes while some split has means too far
    apart.  Levels never rise from the oldest bucket to the newest, so the counts
    per level say where a level begins, and a value costs a constant number of steps.
    """

    def __init__(self, delta: float, grace: int, buckets: list | None = None, since: int = 0):
        self.delta, self.grace, self.since = delta, grace, since
        self.levels = [b[0] for b in buckets or []]  # oldest first
        self.sums = [b[1] for b in buckets or []]
        self.spreads = [b[2] for b in buckets or []]
        self.width = sum(1 << level for level in self.levels)
        self._held = [0] * 64  # buckets per level
        for level in self.levels:
            self._held[level] += 1

    @property
    def buckets(self) -> list[list]:
        return [list(b) for b in zip(self.levels, self.sums, self.spreads)]

    @property
    def mean(self) -> float:
        return sum(self.sums) / self.width if self.width else 0.0

    def _add(self, x: float) -> None:
        levels, sums, spreads, held = self.levels, self.sums, self.spreads, self._held
        levels.append(0)
        sums.append(x)
        spreads.append(0.0)
        self.width += 1
        held[0] += 1
        level, i = 0, len(levels) - held[0]
        while held[level] > BUCKETS_PER_LEVEL:
            n = 1 << level
            gap = (sums[i] - sums[i + 1]) / n
            sums[i] += sums[i + 1]
            spreads[i] = spreads[i] + spreads[i + 1] + gap * gap * n / 2.0
            levels[i] = level + 1
            del levels[i + 1], sums[i + 1], spreads[i + 1]
            held[level] -= 2
            level += 1
            held[level] += 1
            i -= held[level] - 1

    def _drop_oldest(self) -> None:
        level = self.levels[0]
        del self.levels[0], self.sums[0], self.spreads[0]
        self._held[level] -= 1
        self.width -= 1 << level

    def _spread(self) -> float:
        """Variance of the whole window from bucket sums and spreads."""
        n, mean = self.width, self.mean
        return sum(w + (1 << k) * (v / (1 << k) - mean) ** 2 for k, v, w in zip(self.levels, self.sums, self.spreads)) / n

    def _cut_found(self) -> bool:
        n, var = self.width, self._spread()
        total = sum(self.sums)
        bound = log(2.0 * log(n) / self.delta)
        n0, sum0 = 0, 0.0
        for level, value in zip(self.levels[:-1], self.sums):
            n0, sum0 = n0 + (1 << level), sum0 + value
            n1 = n - n0
            if n0 < MIN_SIDE or n1 < MIN_SIDE:
                continue
            inv = 1.0 / (n0 - MIN_SIDE + 1) + 1.0 / (n1 - MIN_SIDE + 1)
            eps = sqrt(2.0 * inv * var * bound) + 2.0 / 3.0 * bound * inv
            if abs(sum0 / n0 - (total - sum0) / n1) > eps:
                return True
        return False

    def update(self, x: float) -> bool:
        self._add(x)
        self.since += 1
        if self.since % CLOCK or self.width <= self.grace:
            return False
        changed = False
        while len(self.levels) > 1 and self.width > MIN_SIDE * 2 and self._cut_found():
            self._drop_oldest()
            changed = True
        return changed

    def extend(self, values: list[float]) -> tuple[list[bool], list[float]]:
        """For each value in turn: whether the window was cut, and its mean then."""
        drifted, means = [], []
        for x in values:
            drifted.append(self.update(x))
            means.append(sum(self.sums) / self.width)
        return drifted, means


def _versions(spark: SparkSession, root: str) -> DataFrame:
    return ingest.stored(spark, root, "states", T.StructType.fromDDL(STATE), "version long")


def _done(spark: SparkSession, root: str) -> tuple[int, dict[str, int]]:
    """Number of the last finished advance (0: none) and the last batch of every source it saw.

    A row per source and advance; written last, so a broken advance leaves no trace.
    """
    marks = ingest.stored(spark, root, "done", T.StructType.fromDDL("name string, last long"), "version long")
    last = marks.agg(F.max("version")).first()[0]
    return (0, {}) if last is None else (last, {r["name"]: r["last"] for r in marks.where(F.col("version") == last).collect()})


def _finish(spark: SparkSession, root: str, version: int, seen: dict[str, int]) -> None:
    rows = spark.createDataFrame(list(seen.items()), "name string, last long").coalesce(1)
    rows.write.mode("overwrite").parquet(f"{root}/done/version={version}")


def advance(
    spark: SparkSession,
    root: str,
    until=None,
    target: float = 0.0,
    slack: float = config.CUSUM_SLACK,
    threshold: float = config.CUSUM_THRESHOLD,
    delta: float = config.ADWIN_DELTA,
    grace: int = config.ADWIN_GRACE,
    windows: bool = True,
) -> None:
    """Take in the rows that are not folded yet, up to time ``until`` (inclusive; None: all of them).

    A caller that expects late files sets ``until`` some time behind the newest
    row; what is newer is held back for the next call.  New rows at or before their
    metric's position go to the late table.  Null times sort first, null values
    count as on target.  Without ``windows`` only CUSUM goes on.
    """
    version, seen = _done(spark, root)
    row = T.StructType.fromDDL(ROW)
    # what is filtered by source and batch is read from the folders of new batches only
    known = F.lit(False)
    for name, last in seen.items():
        known = known | ((F.col("source") == name) & (F.col("batch") <= last))
    fresh = ingest.stored(spark, root, "rows", row).where(~known)
    landed = {r["source"]: r["b"] for r in fresh.groupBy("source").agg(F.max("batch").alias("b")).collect()}
    held_back = ingest.stored(spark, root, "held", row, "version long").where(F.col("version") == version)
    if not landed and held_back.isEmpty():
        return
    # batches that arrive from here on belong to the next call
    inside = F.lit(False)
    for name, last in landed.items():
        inside = inside | ((F.col("source") == name) & (F.col("batch") <= last))
    incoming = fresh.where(inside).select(*row.names).unionByName(held_back.select(*row.names))
    states = _versions(spark, root).where(F.col("version") == version).drop("version")
    at = states.select(F.col("metric").alias("_m"), F.struct("ts", "event_id").alias("_at"))
    placed = incoming.join(at, F.col("metric").eqNullSafe(F.col("_m")), "left")
    due = F.lit(True) if until is None else F.coalesce(F.col("ts") <= F.lit(until).cast("timestamp_ntz"), F.lit(True))
    behind = F.col("_at").isNotNull() & (F.struct("ts", "event_id") <= F.col("_at"))
    sorted_out = durable(placed.select(*row.names, F.when(behind, "late").when(due, "now").otherwise("held").alias("_to")))
    for kind in ("late", "held"):
        sorted_out.where(F.col("_to") == kind).select(*row.names).write.mode("overwrite").parquet(f"{root}/{kind}/version={version + 1}")

    # the state is the row before a metric's first new one
    state = T.StructType.fromDDL(STATE)
    blank = [F.lit(None).cast(state[c].dataType).alias(c) for c in DETECTOR]
    line = states.select("metric", "ts", "event_id", F.lit(None).cast("double").alias("x"), F.lit(True).alias("is_state"), *DETECTOR).unionByName(
        sorted_out.where("_to = 'now'").select(*row.names, F.lit(False).alias("is_state"), *blank)
    )
    step = F.coalesce(F.nanvl("x", F.lit(target)), F.lit(target)) - target
    rising = F.when(F.col("is_state"), F.col("s_pos")).otherwise(step - slack)
    falling = F.when(F.col("is_state"), F.col("s_neg")).otherwise(-step - slack)
    summed = cusum_sums(line, ["metric"], ["ts", "event_id", "is_state", "x"], rising, falling)
    marked = summed.withColumn("cusum_alert", beyond(F.col("s_pos"), threshold) | beyond(F.col("s_neg"), threshold))

    path = f"{root}/folded/version={version + 1}"
    out = T.StructType.fromDDL(f"{ROW}, {MARKS}, is_state boolean, since_check long, levels array<int>, sums array<double>, spreads array<double>")
    (_windowed(marked, out, delta, grace, target) if windows else _unwindowed(marked, out)).write.mode("overwrite").parquet(path)
    folded = spark.read.schema(out).parquet(path)
    folded.where("is_state").select(*state.names).write.mode("overwrite").parquet(f"{root}/states/version={version + 1}")
    _finish(spark, root, version + 1, {**seen, **landed})


def _unwindowed(marked: DataFrame, out: T.StructType) -> DataFrame:
    """Rows and closing states without the adaptive window: what it holds stays as it is."""
    last = F.max_by(F.struct("ts", "event_id", "s_pos", "s_neg"), F.struct("ts", "event_id", ~F.col("is_state"), "x"))
    kept = [F.first(c, ignorenulls=True).alias(c) for c in DETECTOR[2:]]
    closing = marked.groupBy("metric").agg(last.alias("_last"), *kept).select(
        "metric", "_last.*", F.coalesce("n_detections", F.lit(0)).alias("n_detections"), F.coalesce("since_check", F.lit(0)).alias("since_check"),
        *[F.coalesce(c, F.array().cast(out[c].dataType)).alias(c) for c in DETECTOR[4:]], F.lit(True).alias("is_state"),
    )
    rows = marked.where(~F.col("is_state")).select(
        *T.StructType.fromDDL(ROW).names, "s_pos", "s_neg", "cusum_alert", F.col("cusum_alert").alias("alert"), "is_state"
    )
    whole = rows.unionByName(closing, allowMissingColumns=True)
    return whole.select(*[(F.col(f.name) if f.name in whole.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in out])


def _windowed(marked: DataFrame, out: T.StructType, delta: float, grace: int, target: float) -> DataFrame:
    """The adaptive window of every metric, from its stored buckets on."""
    given = marked.select(*T.StructType.fromDDL(ROW).names, "s_pos", "s_neg", "cusum_alert", "is_state", *DETECTOR[2:])
    ordered = given.repartition(task_count(given), "metric").sortWithinPartitions("metric", "ts", "event_id", F.desc("is_state"), "x")

    names = [*T.StructType.fromDDL(ROW).names, "s_pos", "s_neg", "cusum_alert"]
    kinds = {
        "metric": pa.string(), "ts": pa.timestamp("us"), "event_id": pa.int64(), "n_detections": pa.int64(), "since_check": pa.int64(),
        "cusum_alert": pa.bool_(), "adwin_alert": pa.bool_(), "alert": pa.bool_(), "is_state": pa.bool_(),
        "levels": pa.list_(pa.int32()), "sums": pa.list_(pa.float64()), "spreads": pa.list_(pa.float64()),
    }

    def shaped(n: int, **columns) -> pa.RecordBatch:
        """A batch of ``n`` rows; columns that are not given are null."""
        kind = lambda c: kinds.get(c, pa.float64())
        made = {c: v.cast(kind(c)) if isinstance(v, pa.Array) else pa.array(v, kind(c)) for c, v in columns.items()}
        return pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(n, kind(c)) for c in out.names], names=out.names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, end, found, window = None, None, 0, None

        def closing() -> pa.RecordBatch:
            return shaped(
                1, metric=[name], **{c: end.column(c) for c in ("ts", "event_id", "s_pos", "s_neg")}, n_detections=[found], is_state=[True],
                since_check=[window.since], levels=[window.levels], sums=[window.sums], spreads=[window.spreads],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            metrics = np.array(batch.column("metric").to_pylist(), object)
            state = np.array(batch.column("is_state").to_pylist(), bool)
            # a state is a stretch of its own
            starts = np.concatenate(([True], (metrics[1:] != metrics[:-1]) | state[1:] | state[:-1]))
            edges = np.append(np.flatnonzero(starts), len(starts)).tolist()
            for i, j in zip(edges[:-1], edges[1:]):
                if window is None or metrics[i] != name:
                    if window is not None:
                        yield closing()
                    name, found, window = metrics[i], 0, AdaptiveWindow(delta, grace)
                part, end = batch.slice(i, j - i), batch.slice(j - 1, 1)
                if state[i]:
                    kept = end.to_pylist()[0]
                    found = kept["n_detections"]
                    window = AdaptiveWindow(delta, grace, [list(b) for b in zip(kept["levels"], kept["sums"], kept["spreads"])], kept["since_check"])
                    continue
                values = np.array(part.column("x").to_pylist(), float)  # null: NaN
                drifted, means = window.extend(np.where(np.isnan(values), target, values).tolist())
                counts = found + np.cumsum(drifted)
                found = int(counts[-1])
                alert = np.array(part.column("cusum_alert").to_pylist(), bool) | np.array(drifted)
                yield shaped(
                    j - i, **{c: part.column(c) for c in names}, adwin_alert=drifted, n_detections=counts, window_mean=means,
                    alert=alert, is_state=np.zeros(j - i, bool),
                )
        if window is not None:
            yield closing()

    return ordered.mapInArrow(fold, out)


def reset(spark: SparkSession, root: str, metrics: list[str] | None = None) -> None:
    """Start the detectors of some metrics (None: all) anew; their positions stay, so no row is folded twice."""
    version, seen = _done(spark, root)
    if not seen:
        return
    states = _versions(spark, root).where(F.col("version") == version).drop("version")
    chosen = F.lit(True) if metrics is None else F.coalesce(F.col("metric").isin(metrics), F.lit(False))
    zero = {"s_pos": F.lit(0.0), "s_neg": F.lit(0.0), "n_detections": F.lit(0).cast("long"), "since_check": F.lit(0).cast("long"),
            "levels": F.array().cast("array<int>"), "sums": F.array().cast("array<double>"), "spreads": F.array().cast("array<double>")}
    fresh = states.withColumns({c: F.when(chosen, z).otherwise(F.col(c)) for c, z in zero.items()})
    fresh.write.mode("overwrite").parquet(f"{root}/states/version={version + 1}")
    waiting = ingest.stored(spark, root, "held", T.StructType.fromDDL(ROW), "version long").where(F.col("version") == version)
    waiting.drop("version").write.mode("overwrite").parquet(f"{root}/held/version={version + 1}")
    _finish(spark, root, version + 1, seen)


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows that arrived behind their metric's position; count them to watch the delay."""
    rows = ingest.stored(spark, root, "late", T.StructType.fromDDL(ROW), "version long")
    return rows.where(F.col("version") <= _done(spark, root)[0]).drop("version")


def metric_alerts(stream: DataFrame, root: str, source: str = ingest.LANDING, until=None, **settings) -> DataFrame:
    """I1 + I2 + I3: both detectors of every metric over what has landed in ``root`` so far.

    Input columns: metric, ts, event_id, x.  A metric's state appears with its
    first event.  ``alert`` is the OR of both detectors.  The result holds the
    rows of all runs on ``root``.
    """
    spark = stream.sparkSession
    names = T.StructType.fromDDL(ROW).names

    def apply(batch: DataFrame, folder: str) -> None:
        batch.select(*names).write.mode("overwrite").parquet(f"{root}/rows/{folder}")

    ingest.run_batches(stream, root, apply, source)
    advance(spark, root, until, **settings)
    marks = ingest.stored(spark, root, "folded", T.StructType.fromDDL(f"{ROW}, {MARKS}, is_state boolean"), "version long")
    return marks.where(~F.col("is_state") & (F.col("version") <= _done(spark, root)[0])).drop("is_state", "version")


def cusum_stream(stream: DataFrame, root: str, **settings) -> DataFrame:
    """CUSUM alone, without Python workers."""
    return metric_alerts(stream, root, windows=False, **settings).select("metric", "ts", "event_id", "x", "s_pos", "s_neg", "cusum_alert")


def adwin_stream(stream: DataFrame, root: str, **settings) -> DataFrame:
    """The adaptive-window columns of the combined operator."""
    return metric_alerts(stream, root, **settings).select(
        "metric", "ts", "event_id", "x", "adwin_alert", "n_detections", "window_mean"
    )
