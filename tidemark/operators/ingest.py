"""One ingestion job over all markets: validate, keep, quarantine, derive features."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import validate
from tidemark.operators.features import upsert
from tidemark.sources import lake


def ingest(
    raw: DataFrame,
    rules: dict[str, str],
    root: str,
    data_type: str,
    reference: Column,
    to_features: Callable[[DataFrame], DataFrame],
    columns: list[str],
) -> None:
    """All markets are one table, so one bad market cannot stop the others.

    Broken rows go to quarantine with their reasons instead of raising.
    """
    checked = validate.with_reasons(raw, rules).withColumn("valid", F.size("reasons") == 0)
    # a folder per call: the rows are validated once and the sinks read what was written
    folder = f"{root}/checked/{data_type}/{uuid.uuid4().hex}"
    checked.write.partitionBy("valid").parquet(folder)
    rows = raw.sparkSession.read.schema(checked.schema).parquet(folder)
    clean = rows.where("valid").drop("valid", "reasons")
    lake.append(clean.select("market", *columns), f"{root}/lake", data_type, reference)
    rows.where("not valid").drop("valid").write.mode("append").parquet(f"{root}/quarantine/{data_type}")
    to_features(clean).write.mode("append").parquet(f"{root}/features")


def backfill(
    raw: DataFrame, ts: str, start, end, rules: dict[str, str], root: str, to_features: Callable[[DataFrame], DataFrame],
    written_at: Column | None = None,
) -> DataFrame:
    """A11 restricted to a date range; features end up once per key however often it runs.

    ``written_at`` (the time of the call by default) is stored with every row: the later write of a key wins,
    whatever its value.  Within one write the later release wins, then the larger value.
    """
    part = raw.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    clean, _ = validate.split(part, rules)
    now = F.current_timestamp() if written_at is None else written_at
    rows = to_features(clean).withColumn("ingested_at", now.cast("timestamp"))
    rows.write.mode("append").parquet(f"{root}/features")
    stored = raw.sparkSession.read.schema(rows.schema).parquet(f"{root}/features")
    return upsert(stored, F.struct("ingested_at", "available_at", "value")).drop("ingested_at")
