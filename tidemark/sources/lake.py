"""Append-only parquet lake: data_type / market / year / month."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = ["data_type", "market", "year", "month"]

_DOUBLE = T.DoubleType()


def _fields(names: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


# One explicit schema per data type: a read never has to infer or reconcile files.
SCHEMAS = {
    "futures": T.StructType(
        _fields("open high low close", _DOUBLE)
        + [
            T.StructField("volume", T.LongType()),
            T.StructField("symbol", T.StringType()),
            T.StructField("ts_event", T.TimestampNTZType()),
        ]
    ),
    "options": T.StructType(
        [T.StructField("instrument_id", T.LongType()), T.StructField("strike", _DOUBLE)]
        + [T.StructField("expiry", T.DateType()), T.StructField("is_call", T.BooleanType())]
        + _fields("bid ask oi", _DOUBLE)
        + _fields("bid_size ask_size volume", T.LongType())
    ),
    "cot": T.StructType(
        [T.StructField("report_date", T.DateType()), T.StructField("available_at", T.TimestampNTZType())]
        + _fields(
            "managed_money_long managed_money_short managed_money_net producer_long producer_short "
            "producer_net swap_long swap_short swap_net total_oi",
            _DOUBLE,
        )
    ),
}


def append(df: DataFrame, path: str, data_type: str, reference: Column) -> None:
    """A1: add the partition columns from a reference date and append.

    Spark names part files uniquely, so earlier batches are never overwritten.
    Rows are spread by (market, month) plus a hash salt: one hot market-month is
    written by several tasks, and small ones do not scatter over all tasks.
    """
    stamped = (
        df.withColumn("data_type", F.lit(data_type))
        .withColumn("year", F.date_format(reference, "yyyy"))
        .withColumn("month", F.date_format(reference, "MM"))
    )
    # REBALANCE lets adaptive execution split a partition that outgrows the advisory size
    stamped.hint("rebalance", F.col("market"), F.col("year"), F.col("month")).write.mode("append").partitionBy(
        *PARTITIONS
    ).parquet(path)


def scan(
    spark: SparkSession,
    path: str,
    data_type: str,
    market: str | None = None,
    start: date | None = None,
    end: date | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """A2: one data type, optionally one market and an inclusive year-month range.

    Only the folders of the wanted market, years and months are named to the
    reader, so nothing else is listed or opened: ``wanted_folders`` says which.
    Folders that do not exist give no rows.
    """
    body = schema or SCHEMAS[data_type]
    market_field = [] if "market" in body.names else [T.StructField("market", T.StringType())]
    full = T.StructType(
        body.fields
        + market_field
        + [T.StructField("year", T.StringType()), T.StructField("month", T.StringType())]
    )
    reader = spark.read.schema(full).option("basePath", path)
    try:
        df = reader.parquet(wanted_folders(path, data_type, market, start, end))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full).drop("year", "month")
    # zero-padded strings compare like numbers, and stay partition filters; they matter where one end is open
    if start is not None:
        y, m = f"{start.year:04d}", f"{start.month:02d}"
        df = df.where((F.col("year") > y) | ((F.col("year") == y) & (F.col("month") >= m)))
    if end is not None:
        y, m = f"{end.year:04d}", f"{end.month:02d}"
        df = df.where((F.col("year") < y) | ((F.col("year") == y) & (F.col("month") <= m)))
    return df.drop("data_type", "year", "month")


def wanted_folders(path: str, data_type: str, market: str | None, start: date | None, end: date | None) -> str:
    """One path pattern for the folders of a scan; with both ends given it names every wanted year and month."""
    base = f"{path}/data_type={_escaped(data_type)}"
    if start is not None and end is not None:
        first, last = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
        months = [f"year={i // 12:04d}/month={i % 12 + 1:02d}" for i in range(first, last + 1)]
        return f"{base}/market={'*' if market is None else _escaped(market)}/{{{','.join(months) or 'none'}}}"
    return base if market is None else f"{base}/market={_escaped(market)}"


def _escaped(value: str) -> str:
    """A partition value as Spark writes it into a folder name; no sign with a meaning in patterns is left."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\{}[]^\x7f" else c for c in value)
