"""Classifier training and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators.ordered import Cut, checked_broadcast, framed
from tidemark.session import durable

# --- fixed values: classifier defaults
DEFAULTS = {
    "maxIter": 100,
    "stepSize": 0.1,
    "maxDepth": 5,
    "minInstancesPerNode": 20,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "seed": 42,
}
MIN_PRICES, MIN_TARGETS, HORIZON = 50, 30, 5


def _with_indicators(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{n}_missing": F.col(n).isNull().cast("double") for n in names}).withColumns(
        {n: F.col(n).cast("double") for n in names}
    )


def train(df: DataFrame, names: Sequence[str], target: str = "target", **params) -> PipelineModel:
    """Boosted trees over imputed values plus one missing flag per feature.

    A column without any value cannot be imputed; it is kept through its flag.
    """
    names = list(names)
    ready = _with_indicators(df, names).withColumn("label", F.col(target).cast("double"))
    counts = ready.agg(*[F.count(n).alias(n) for n in names]).first()
    known = [n for n in names if counts[n] > 0]
    flags = [f"{n}_missing" for n in names]
    stages = []
    if known:
        stages.append(Imputer(inputCols=known, outputCols=[f"{n}_filled" for n in known], strategy="mean"))
    stages.append(VectorAssembler(inputCols=[f"{n}_filled" for n in known] + flags, outputCol="features"))
    stages.append(GBTClassifier(**{**DEFAULTS, **params}))
    return Pipeline(stages=stages).fit(ready)


def score(model: PipelineModel, df: DataFrame, names: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Probability of a rise, and the class at the threshold."""
    scored = model.transform(_with_indicators(df, list(names)))
    p = vector_to_array("probability")[1]
    return scored.withColumn("p", p).select(*df.columns, "p", (F.col("p") >= threshold).cast("int").alias("predicted"))


def importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Importances by feature, largest first (gain based); missing flags count for their feature."""
    assembler, trees = model.stages[-2], model.stages[-1]
    values = trees.featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(assembler.getInputCols(), values)), "input string, importance double")
    name = F.regexp_replace("input", "_(filled|missing)$", "")
    return (
        rows.groupBy(name.alias("feature"))
        .agg(F.sum("importance").alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def training_set(prices: DataFrame, matrix: DataFrame, cell: Cut = None, horizon: int = HORIZON) -> DataFrame:
    """Features at each price time with the target ``horizon`` bars ahead and the time that target is known.

    Markets with fewer than fifty prices or thirty targets are left out.
    """
    nxt = framed(
        prices, ["market"], ["ts"], cell,
        {"_price": lambda f: F.first("close").over(f(horizon, horizon)), "label_ts": lambda f: F.first("ts").over(f(horizon, horizon))},
        after=horizon,
    )
    target = F.when(F.col("_price").isNotNull(), (F.col("_price") > F.col("close")).cast("int"))
    # the last bars have no target, so targets follow from prices and one count decides
    sizes = prices.groupBy("market").agg(F.count(F.lit(1)).alias("_prices"))
    enough = durable(sizes.where(F.col("_prices") >= max(MIN_PRICES, MIN_TARGETS + horizon)).select("market"))
    return (
        nxt.withColumn("target", target).drop("_price").where(F.col("target").isNotNull())
        .join(matrix, ["market", "ts"])
        .join(checked_broadcast(enough), "market", "left_semi")
    )


def calendar_folds(
    rows: DataFrame,
    n_splits: int = config.WALK_FORWARD["n_splits"],
    embargo: int = config.WALK_FORWARD["embargo"],
    min_train: int = config.WALK_FORWARD["min_train"],
    test_size: int = config.WALK_FORWARD["test_size"],
    ts: str = "ts",
    label_ts: str = "label_ts",
) -> DataFrame:
    """(fold, role) labels of training rows, cut at calendar times that all markets share.

    Times are numbered over all markets, so no market's test rows lie before another one's training rows, however late a
    market starts.  Fold k trains on the first ``min_train + k * test_size`` times, skips ``embargo`` of them and tests
    on the next ``test_size``.  Training rows whose target is only known at or after the first test time are purged.
    Folds whose test end lies beyond the calendar are left out.  Without any complete fold the result is empty.
    """
    # a row per time of the calendar, not per bar
    times = rows.select(F.col(ts).alias("_t")).distinct()
    calendar = durable(times.withColumn("_i", F.row_number().over(Window.orderBy("_t")) - 1))
    n = calendar.count()
    ends = [min_train + k * test_size for k in range(n_splits)]
    ends = [e for e in ends if e + embargo + test_size <= n]
    # the first test time of each fold: at most n_splits rows
    first = {r["_i"]: r["_t"] for r in calendar.where(F.col("_i").isin([e + embargo for e in ends])).collect()}
    placed = rows.join(checked_broadcast(calendar, 200_000), F.col(ts) == F.col("_t")).drop("_t")
    labels = []
    for k, end in enumerate(ends):
        known = F.col(label_ts) < F.lit(first[end + embargo]).cast(rows.schema[label_ts].dataType)
        tested = (F.col("_i") >= end + embargo) & (F.col("_i") < end + embargo + test_size)
        role = F.when((F.col("_i") < end) & known, "train").when(tested, "test")
        labels.append(F.struct(F.lit(k).alias("fold"), role.alias("role")))
    if not labels:
        return rows.withColumns({"fold": F.lit(0), "role": F.lit("")}).where("false")
    each = placed.withColumn("_f", F.explode(F.array(*labels))).where("_f.role IS NOT NULL")
    return each.withColumns({"fold": F.col("_f.fold"), "role": F.col("_f.role")}).drop("_f", "_i")


def walk_forward_scores(labelled_folds: DataFrame, names: Sequence[str], n_splits: int, **params) -> DataFrame:
    """Per fold train on the past of all markets, score the test rows.

    The driver loops over at most ``n_splits`` folds; every fit is distributed.
    """
    out = None
    for k in range(n_splits):
        rows = labelled_folds.where(F.col("fold") == k)
        past = rows.where(F.col("role") == "train")
        if past.limit(1).count() == 0:
            break
        scored = score(train(past, names, **params), rows.where(F.col("role") == "test"), names)
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("no fold has training rows")
    return out
