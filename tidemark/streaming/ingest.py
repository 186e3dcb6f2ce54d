"""Incremental ingestion, revision merge and live counts.

A target folder keeps the position of every stream that feeds it below
``state/<source>`` and its tables below ``<table>/source=<source>/batch=<id>``.
A second run goes on where the first one ended: what it has read it does not
read again, and its batches get new numbers.  A batch that is retried
overwrites its own folder.  No result depends on how many rows a micro-batch
holds or on the order in which files are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import features, validate
from tidemark.session import checkpoint_root
from tidemark.sources import compacted

LANDING = "landing"  # name of a stream where a target has only one


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint location."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def read_landing(
    spark: SparkSession, path: str, schema: T.StructType, files: str = "*.parquet", max_bytes: int = 1 << 30
) -> DataFrame:
    """Stream over a landing folder; ``files`` selects by name, ``max_bytes`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).option("pathGlobFilter", files)
    return reader.parquet(path)


def run_batches(stream: DataFrame, root: str, apply: Callable[[DataFrame, str], None], source: str = LANDING) -> None:
    """Drain what has landed since the last run through a function of a batch and its sub-folder."""

    def numbered(batch: DataFrame, batch_id: int) -> None:
        apply(batch, f"source={source}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(numbered)
        .option("checkpointLocation", f"{root}/state/{source}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stored(spark: SparkSession, root: str, table: str, schema: T.StructType, extra: str = "source string, batch long") -> DataFrame:
    """All batches of a table of a target, with ``source`` and ``batch``; empty before the first batch."""
    full = T.StructType([*schema.fields, *T.StructType.fromDDL(extra).fields])
    try:
        return spark.read.schema(full).parquet(f"{root}/{table}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def ingest_bars(stream: DataFrame, root: str, source: str = LANDING) -> None:
    """I4: landed bars -> validation -> lake, quarantine and close features.

    A batch is validated once and written by validity; the features are derived
    from the bars that were written.  Read the tables with ``bars``,
    ``quarantine`` and ``bar_features``.
    """

    def apply(batch: DataFrame, folder: str) -> None:
        checked = validate.with_reasons(batch, validate.BAR_RULES).withColumn("valid", F.size("reasons") == 0)
        checked.write.mode("overwrite").partitionBy("valid").parquet(f"{root}/checked/{folder}")
        clean = bars(batch.sparkSession, root, batch.schema, folder)
        features.close_features(clean).write.mode("overwrite").parquet(f"{root}/features/{folder}")

    run_batches(stream, root, apply, source)


def _checked(spark: SparkSession, root: str, schema: T.StructType, folder: str, valid: bool) -> DataFrame:
    extra = "valid boolean" if folder else "source string, batch long, valid boolean"
    held = T.StructType([*schema.fields, T.StructField("reasons", T.ArrayType(T.StringType()))])
    rows = stored(spark, root, f"checked/{folder}".rstrip("/"), held, extra)
    return rows.where(F.col("valid") == valid).select(*schema.names, "reasons")


def bars(spark: SparkSession, root: str, schema: T.StructType, folder: str = "") -> DataFrame:
    """Valid bars of a target, or of one batch of it."""
    return _checked(spark, root, schema, folder, True).drop("reasons")


def quarantine(spark: SparkSession, root: str, schema: T.StructType, folder: str = "") -> DataFrame:
    """Rejected bars of a target with their reasons."""
    return _checked(spark, root, schema, folder, False)


def bar_features(spark: SparkSession, root: str) -> DataFrame:
    """Close features of all batches of a target."""
    schema = T.StructType.fromDDL(
        "market string, feature_name string, as_of timestamp_ntz, available_at timestamp_ntz, value double, quality string"
    )
    return stored(spark, root, "features", schema).select(*schema.names)


def merge_revisions(
    stream: DataFrame, root: str, order: str = "ingested_at", source: str = LANDING, buckets: int = compacted.BUCKETS
) -> DataFrame:
    """Corrections replace earlier values of the same key.

    Every batch is folded into a compacted store: it rewrites the folders (month of as_of, bucket of keys) that it touches
    and no others.  A late or repeated write with a smaller ``order`` changes nothing.  Reading is a plain scan.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, folder: str) -> None:
        compacted.merge(spark, f"{root}/revisions", batch.select(*stream.columns), order, folder, buckets=buckets)

    run_batches(stream, root, apply, source)
    return compacted.read(spark, f"{root}/revisions", stream.schema, buckets=buckets)


def live_counts(
    stream: DataFrame, root: str, ts: str, kind: Column, width: str = "60 seconds", source: str = LANDING
) -> DataFrame:
    """Rows per kind and tumbling minute, over everything that has landed so far.

    Every batch adds its own counts; they are summed on reading.  Counts add up
    in any order, so no row is too late and the newest minutes are included.
    """

    def apply(batch: DataFrame, folder: str) -> None:
        timed = batch.select(F.col(ts).cast("timestamp").alias("_ts"), kind.alias("kind"))
        counts = timed.groupBy(F.window("_ts", width), "kind").agg(F.count(F.lit(1)).alias("n"))
        rows = counts.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "kind", "n")
        rows.write.mode("overwrite").parquet(f"{root}/counts/{folder}")

    run_batches(stream, root, apply, source)
    schema = T.StructType.fromDDL("window_start timestamp_ntz, kind string, n long")
    parts = stored(stream.sparkSession, root, "counts", schema)
    return parts.groupBy("window_start", "kind").agg(F.sum("n").alias("n"))


__all__ = [
    "bar_features", "bars", "ingest_bars", "live_counts", "merge_revisions", "quarantine", "read_landing", "run_batches",
    "scratch", "stored",
]
