"""Group J (and F4): training, scoring, folds and the capital ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import features, model, returns, signals
from tidemark.operators.cells import counted_cells
from tidemark.operators.ledger import account_ledger, pnl_ledger, replay_metrics
from tidemark.plans import ledger_sql
from tidemark.plans.options import DIRECTION_SQL, SEGMENT_SQL, feature_sources, segment_rows
from tidemark.plans.registry import query, r6
from tidemark.plans.windows import SENTIMENT_SQL
from tidemark.session import durable
from tidemark.sources import tables

NAMES = config.STORE_FEATURES + config.SIGNAL_FEATURES
_ROUNDED = [*config.SIGNAL_FEATURES, "implied_skew", "implied_kurtosis", "atm_iv"]
LATER = "2000-01-01"  # J1 trains before this time and is judged after it


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """The seventeen features of every market at every bar: stored ones as of the bar, computed ones from them."""
    options = durable(segment_rows(spark, d))  # stands for stored rows, read several times
    prices = options.select("market", F.col("as_of").alias("ts"), F.col("spot").alias("close"))
    stored = [*config.STORE_FEATURES, "spot", "sentiment_score", "sentiment_confidence"]
    wide = features.wide_matrix(feature_sources(spark, d, options), prices.select("market", "ts"), stored)
    matrix = signals.signal_features(wide, F.col("spot")).select("market", "ts", *NAMES)
    return model.training_set(prices, matrix)


# the as-of joins and computed features of the matrix, and the target five bars ahead
_MATRIX = f"""{SENTIMENT_SQL},
opt AS (SELECT {SEGMENT_SQL} AS market, ts, close * (1 + (open - low) / high / 20 - 0.02) AS implied_mean, (open - close) / high AS implied_skew,
        3 + 2 * low / close AS implied_kurtosis, close AS spot, (high - low) * (high - low) AS implied_variance, (high - low) / close AS atm_iv,
        volume * (close - open) AS gex, volume * (high - close) AS vanna_flow FROM v_bars),
charm AS (SELECT {SEGMENT_SQL} AS market, ts, volume * (open - low) AS charm_flow FROM v_bars WHERE (CAST(ts AS DATE) - DATE '1970-01-01') % 21 = 0),
priced AS (SELECT market, ts, spot AS close, lead(spot, 5) OVER w AS nxt, lead(ts, 5) OVER w AS label_ts FROM opt WINDOW w AS (PARTITION BY market ORDER BY ts)),
cot AS (SELECT r.*, s.sentiment_score AS sc, s.sentiment_confidence AS co FROM v_reports r JOIN sentiment s USING (market, report_date)),
j AS (SELECT p.*, c.managed_money_net AS cot_managed_money_net, c.producer_net AS cot_producer_net, c.swap_net AS cot_swap_net, c.total_oi AS cot_total_oi, sc, co
      FROM priced p ASOF LEFT JOIN cot c ON p.market = c.market AND p.ts >= c.available_at),
k AS (SELECT j.*, o.* EXCLUDE (market, ts), h.charm_flow FROM j JOIN opt o USING (market, ts) ASOF LEFT JOIN charm h ON j.market = h.market AND j.ts >= h.ts),
b AS (SELECT *, (implied_mean - spot) / spot AS bias, (implied_mean - spot) / spot - sc / 10.0 AS raw, implied_skew AS sk, implied_kurtosis AS ku FROM k),
feat AS (SELECT *, sc AS sentiment_score, co AS sentiment_confidence, CASE WHEN nxt > close THEN 1 ELSE 0 END AS target,
         CASE WHEN sc IS NOT NULL THEN {DIRECTION_SQL} END::double AS divergence_direction, CASE WHEN sc IS NOT NULL THEN raw END AS divergence_magnitude,
         CASE WHEN sc IS NOT NULL THEN least(greatest(co * greatest(least(abs(raw) / 2.0, 1.0), 0.3), 0.0), 1.0) END AS divergence_confidence
         FROM b WHERE nxt IS NOT NULL)"""


@query(
    "j4_training_set",
    f"WITH {_MATRIX} SELECT market, ts, label_ts, target, {', '.join(f'round({n}::double, 6) + 0.0 AS {n}' if n in _ROUNDED else f'{n}::double AS {n}' for n in NAMES)} FROM feat",
)
def j4(spark, d):
    return training_rows(spark, d).select("market", "ts", "label_ts", "target", *[r6(F.col(n)).alias(n) if n in _ROUNDED else n for n in NAMES])


def proper(scored: DataFrame) -> Column:
    """What holds for every score: a probability, and the class that it says."""
    return F.col("p").between(0.0, 1.0) & (F.col("predicted") == (F.col("p") >= 0.5).cast("int"))


@query(
    "j1_train_classifier",
    f"""WITH {_MATRIX}, parts AS (SELECT CASE WHEN label_ts < TIMESTAMP '{LATER}' THEN 'train' WHEN ts >= TIMESTAMP '{LATER}' THEN 'test' END AS part, target FROM feat)
        SELECT part, count(*) AS n, sum(target)::BIGINT AS n_up, true AS proper, true AS learned FROM parts WHERE part IS NOT NULL GROUP BY part""",
)
def j1(spark, d):
    """Fit where the target was known before a time, judged on what follows it; rows between are purged.

    ``learned``: on its training rows the model has a smaller log loss than their base rate.
    """
    later = F.lit(LATER).cast("timestamp_ntz")
    part = F.when(F.col("label_ts") < later, "train").when(F.col("ts") >= later, "test")
    rows = durable(training_rows(spark, d).withColumn("part", part).where("part IS NOT NULL"))
    scored = model.score(model.train(rows.where("part = 'train'"), NAMES), rows, NAMES)
    p = F.least(F.greatest("p", F.lit(1e-9)), F.lit(1 - 1e-9))
    loss = -F.when(F.col("target") == 1, F.log(p)).otherwise(F.log(1 - p))
    up = F.avg("target")
    base = -(up * F.log(F.greatest(up, F.lit(1e-9))) + (1 - up) * F.log(F.greatest(1 - up, F.lit(1e-9))))
    return scored.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").cast("long").alias("n_up"), F.bool_and(proper(scored)).alias("proper"),
        ((F.first("part") == "test") | (F.avg(loss) < base)).alias("learned"),
    )


@query("j2_score", f"WITH {_MATRIX} SELECT market, ts, target, true AS proper FROM feat")
def j2(spark, d):
    rows = durable(training_rows(spark, d))
    scored = model.score(model.train(rows, NAMES), rows, NAMES)
    return scored.select("market", "ts", "target", proper(scored).alias("proper"))


@query(
    "j3_importance",
    f"""SELECT feature, true AS between_bounds, true AS sums_to_one FROM (SELECT unnest([{', '.join(repr(n) for n in NAMES)}]) AS feature)""",
)
def j3(spark, d):
    """Every feature has an importance; they are shares of the whole."""
    found = model.importance(spark, model.train(durable(training_rows(spark, d)), NAMES))
    total = found.agg(F.abs(F.sum("importance") - 1.0) < 1e-6).first()[0]
    return found.select("feature", F.col("importance").between(0.0, 1.0).alias("between_bounds"), F.lit(total).alias("sums_to_one"))


@query("f4_top_importance", "SELECT unnest(range(1, 11)) AS place, true AS falling, true AS known")
def f4(spark, d):
    """The ten most important features by place."""
    found = model.importance(spark, model.train(durable(training_rows(spark, d)), NAMES))
    top = found.limit(10)
    along = Window.orderBy(F.desc("importance"), "feature")  # ten rows
    before = F.lag("importance").over(along)
    return top.select(
        F.row_number().over(along).cast("long").alias("place"), F.coalesce(before >= F.col("importance"), F.lit(True)).alias("falling"),
        F.col("feature").isin(NAMES).alias("known"),
    )


def fold_scores(spark: SparkSession, d: str) -> DataFrame:
    cut = durable(model.calendar_folds(durable(training_rows(spark, d))))
    return model.walk_forward_scores(cut, NAMES, config.WALK_FORWARD["n_splits"])


_FOLDS = f"""{_MATRIX},
days AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM feat)),
bounds AS (SELECT fold, 252 + 63 * fold AS te FROM (SELECT unnest(range(0, 5)) AS fold)),
cut AS (SELECT f.market, f.ts, f.target, fold, CASE WHEN i < te AND label_ts < (SELECT ts FROM days WHERE i = te + 5) THEN 'train'
               WHEN i >= te + 5 AND i < te + 68 THEN 'test' END AS role
        FROM feat f JOIN days USING (ts), bounds WHERE te + 68 <= n)"""


@query("j5_walk_forward_score", f"WITH {_FOLDS} SELECT market, ts, CAST(fold AS INTEGER) AS fold, target, true AS proper FROM cut WHERE role = 'test'")
def j5(spark, d):
    scored = fold_scores(spark, d)
    return scored.select("market", "ts", "fold", "target", proper(scored).alias("proper"))


@query("j5b_calendar_folds", f"WITH {_FOLDS} SELECT market, ts, CAST(fold AS INTEGER) AS fold, role, target FROM cut WHERE role IS NOT NULL")
def j5b(spark, d):
    """The folds J5 trains and tests on."""
    return model.calendar_folds(durable(training_rows(spark, d))).select("market", "ts", "fold", "role", "target")


def replay_input(spark: SparkSession, d: str) -> DataFrame:
    """Bars with returns, volatility and a probability per run; runs are parameter sets.

    Returns are scaled down: the bars of the test tables jump far more than a market does.
    """
    bars = durable(tables.bars(spark, d))  # stands for the landed bars
    cells = counted_cells(bars, ["market"], ["ts"])
    priced = returns.rolling_vol(returns.simple_returns(bars, cells), cells)
    # the probability is a rule on the previous bar's shape, shifted per run
    tilt = (F.col("open") - F.col("low")) / (F.col("high") - F.col("low") + 1e-9)
    return priced.withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in range(4)]))).select(
        "market", "run_id", "ts", "close", (F.col("ret") / 100.0).alias("ret"), "rolling_vol", F.col("volume"), (F.col("close") * 0.001).alias("spread"),
        F.least(F.greatest(0.35 + 0.3 * tilt + 0.05 * F.col("run_id"), F.lit(0.0)), F.lit(1.0)).alias("p"),
    )


_COLUMNS = ["direction", "n_contracts", "traded"]
_DIGITS = {"raw_return": 8, "slippage": 8, "net_return": 8, "capital_return": 9, "capital_after": 3}


def rounded(ledger: DataFrame, keys: list[str]) -> DataFrame:
    return ledger.select(*keys, *_COLUMNS, *[r6(F.col(c), n).alias(c) for c, n in _DIGITS.items()])


@query("j6_pnl_ledger", f"WITH RECURSIVE {ledger_sql.ACCOUNT} SELECT {ledger_sql.rounded(['market', 'run_id', 'ts'])}, allowed FROM led")
def j6(spark, d):
    return rounded(account_ledger(replay_input(spark, d), ["market", "run_id"], ["ts"]), ["market", "run_id", "ts", "allowed"])


@query(
    "j6b_replay_metrics",
    f"""WITH RECURSIVE {ledger_sql.METRICS} SELECT market, run_id, round(sharpe_ratio, 5) + 0.0 AS sharpe_ratio, round(total_return, 7) + 0.0 AS total_return,
        round(max_drawdown, 7) + 0.0 AS max_drawdown, round(hit_rate, 6) AS hit_rate, n_trades FROM met""",
)
def j6b(spark, d):
    found = replay_metrics(account_ledger(replay_input(spark, d), ["market", "run_id"], ["ts"]), ["market", "run_id"], ["ts"])
    digits = {"sharpe_ratio": 5, "total_return": 7, "max_drawdown": 7, "hit_rate": 6}
    return found.withColumns({c: r6(F.col(c), n) for c, n in digits.items()})


@query(
    "j6c_walk_forward_ledger",
    f"WITH {ledger_sql.WALK_FORWARD} SELECT {ledger_sql.rounded(['market', 'run_id', 'fold', 'row_idx'])} FROM led",
)
def j6c(spark, d):
    """The ledger over the test rows of three folds of all runs, with static costs; every fold starts anew."""
    static = {"volume": "static_volume", "spread": "static_spread", "rolling_vol": "static_volatility"}
    rows = replay_input(spark, d).withColumns({c: F.lit(config.LEDGER[n]) for c, n in static.items()})
    cut = returns.folds(rows, keys=["market", "run_id"], n_splits=3, min_train=150, test_size=60).where(F.col("role") == "test")
    return rounded(pnl_ledger(cut, ["market", "run_id", "fold"], ["row_idx"], walk_forward=True), ["market", "run_id", "fold", "row_idx"])
