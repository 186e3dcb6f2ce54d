"""A feature store that is folded together as it is written, so reading needs no aggregate and no exchange.

Rows lie in folders by month of ``as_of`` and by a bucket of (market, feature), each folder with the newest write of every
key in it.  A batch rewrites only the folders it touches, under a new version; a manifest says which version of each
folder counts.  The manifest is written last, so readers see a batch whole or not at all, and a batch that is retried
after its manifest was written changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.features import upsert
from tidemark.session import durable

BUCKETS = 16
PLACE = ["month", "bucket"]
_MANIFEST = "month string, bucket int, data_version long, batch string, version long"


def month_of(as_of: Column) -> Column:
    return F.coalesce(F.date_format(as_of, "yyyyMM"), F.lit("none"))


def bucket_of(market: Column, feature: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(market, feature), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, root: str) -> tuple[int, dict[tuple[str, int], int], set[str]]:
    """Last version, the version of each folder, and the batches taken in: rows by calendar months and buckets."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}, set()
    # a version repeats every folder; its batches are one row each
    last = rows.agg(F.max("version")).first()[0] or 0
    own = rows.where(F.col("version") == last).collect()
    return last, {(r["month"], r["bucket"]): r["data_version"] for r in own if r["batch"] is None}, {r["batch"] for r in own if r["batch"] is not None}


def _folders(spark: SparkSession, root: str, held: dict[tuple[str, int], int], schema: T.StructType) -> DataFrame:
    if not held:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/data/version={v}/month={m}/bucket={b}" for (m, b), v in sorted(held.items())]
    full = T.StructType([*schema.fields, *T.StructType.fromDDL("version long, month string, bucket int").fields])
    return spark.read.schema(full).option("basePath", f"{root}/data").parquet(*paths).select(*schema.names)


def merge(spark: SparkSession, root: str, writes: DataFrame, order: str, batch: str, newest: int = 1000, buckets: int = BUCKETS) -> int:
    """Folds a batch of writes in; the write with the largest ``order`` of a key stays.  Returns the version.

    ``batch`` names the batch among the last ``newest`` ones: naming one again is a retry.  ``writes`` has the key columns
    (market, feature_name, as_of), ``order`` and any others; nulls in the key are keys like any other.
    """
    version, held, seen = _manifest(spark, root)
    if batch in seen:
        return version
    placed = durable(writes)
    spots = placed.select(month_of(F.col("as_of")).alias("month"), bucket_of(F.col("market"), F.col("feature_name"), buckets).alias("bucket"))
    touched = {(r["month"], r["bucket"]) for r in spots.distinct().collect()}
    old = _folders(spark, root, {k: v for k, v in held.items() if k in touched}, placed.schema)
    kept = upsert(old.unionByName(placed), F.col(order)).select(*placed.columns)
    stamped = kept.withColumn("month", month_of(F.col("as_of"))).withColumn("bucket", bucket_of(F.col("market"), F.col("feature_name"), buckets))
    # REBALANCE gathers a folder's rows and splits what outgrows the advisory size
    stamped.hint("rebalance", *[F.col(c) for c in PLACE]).write.mode("overwrite").partitionBy(*PLACE).parquet(f"{root}/data/version={version + 1}")
    held |= {k: version + 1 for k in touched}
    names = sorted(seen, key=_number)[-(newest - 1):] + [batch]
    rows = [(m, b, v, None) for (m, b), v in held.items()] + [(None, None, None, n) for n in names]
    spark.createDataFrame(rows, _MANIFEST.rsplit(",", 1)[0]).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version + 1}")
    return version + 1


def _number(name: str) -> tuple:
    head, _, tail = name.rpartition("=")
    return (head, int(tail)) if tail.isdigit() else (name, -1)


def read(
    spark: SparkSession, root: str, schema: T.StructType, months: tuple[str, str] | None = None, pairs: Sequence[tuple[str, str]] | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The newest write of every key, read from the folders that can hold it.

    ``months`` bounds the months of as_of (yyyymm, both ends included), ``pairs`` names (market, feature) pairs; folders outside are
    not listed.
    """
    _, held, _ = _manifest(spark, root)
    if months is not None:
        held = {k: v for k, v in held.items() if months[0] <= k[0] <= months[1]}
    wanted = None
    if pairs is not None:
        asked = spark.createDataFrame(list(pairs), "market string, feature_name string")
        wanted = {r[0] for r in asked.select(bucket_of(F.col("market"), F.col("feature_name"), buckets)).collect()}
        held = {k: v for k, v in held.items() if k[1] in wanted}
    rows = _folders(spark, root, held, schema)
    return rows if pairs is None else rows.where(F.struct("market", "feature_name").isin([F.struct(F.lit(m), F.lit(f)) for m, f in pairs]))
