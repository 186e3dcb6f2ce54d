"""Shared parts of the training-data operators: session set-up, shared files, deterministic shards."""

from __future__ import annotations

import os
import uuid
from bisect import bisect_right
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_root, ship_package, task_count

__all__ = ["checked_broadcast", "prepare", "read", "shared_folder", "shards", "spread", "storage", "write_file"]


def prepare(spark: SparkSession) -> None:
    """Sends the package to the workers and bounds the rows of one Arrow batch (texts may be long)."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def storage(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared location: a mounted folder, or a store that pyarrow can reach."""
    return fs.FileSystem.from_uri(uri if ":/" in uri else os.path.abspath(uri))


def write_file(uri: str, data: bytes | Sequence[bytes]) -> None:
    """Writes under a temporary name and renames: readers see whole files only, and a repeated task replaces equal bytes."""
    store, path = storage(uri)
    folder, name = path.rsplit("/", 1)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary, compression=None) as out:
        for part in [data] if isinstance(data, bytes) else data:
            out.write(part)
    store.move(temporary, path)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Deals rows out by a key to a fixed number of tasks, for work that costs far more time than bytes."""
    return df.repartition(task_count(df), *keys)


def checked_broadcast(df: DataFrame, limit: int, size: int | Column) -> DataFrame:
    """Broadcast hint for a durable table within ``limit`` bytes; otherwise a shuffled join.

    ``size`` is the bytes of a row: a number for fixed-width rows, else an expression that is summed up.
    """
    if isinstance(size, int):
        most = limit // size
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= limit else df


def shards(df: DataFrame, key: str, size: Column, target: int = 64 << 20, least: int = 64, per_shard: int = 64):
    """Number of shards and the function key -> shard (plain Python) for a range-sorted layout.

    The bounds depend on the rows alone, not on partitions or attempts: they are quantiles of the keys
    whose hash falls below a threshold, about ``per_shard`` keys per shard.  Null keys go to shard 0.
    """
    total, rows = df.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    count = max(least, -(-int(total) // target))
    share = min(1.0, count * per_shard / max(1, rows))
    drawn = df.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    sample = sorted(r[0] for r in drawn.select(key).collect())
    bounds = [sample[len(sample) * i // count] for i in range(1, count)] if sample else []

    def shard_of(value: int | None) -> int:
        return 0 if value is None else bisect_right(bounds, value)

    return count, shard_of


def arrow_map(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """mapInArrow whose function gets one batch as a dict of lists and returns a dict of lists."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = work({n: batch.column(n) for n in batch.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)
