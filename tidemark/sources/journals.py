"""Fill and experiment journals: append tables with JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import index_rows

OBJECT = "map<string,string>"
JSON_OBJECTS = ["config_diff", "results", "champion_metrics", "metadata"]


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def with_fill_ids(fills: DataFrame, order: list[str]) -> DataFrame:
    """Ids 1..n in journal order, given when read rather than when written.

    A counter at write time would serialise all writers.  A large journal
    is numbered in counted cells that add the totals of the cells before, so no task sorts all of it.
    """
    numbered = index_rows(fills, [], order, out="_idx")
    return numbered.withColumn("id", F.col("_idx") + 1).drop("_idx")


def encode_experiments(df: DataFrame) -> DataFrame:
    """Structured columns to JSON text."""
    for name in [*JSON_OBJECTS, "tags"]:
        if name in df.columns:
            df = df.withColumn(name, F.to_json(name))
    return df


def decode_experiments(df: DataFrame) -> DataFrame:
    """A10: JSON text to maps and arrays; missing tags and metadata become empty."""
    for name in JSON_OBJECTS:
        if name in df.columns:
            decoded = F.from_json(name, OBJECT)
            if name == "metadata":
                decoded = F.coalesce(decoded, F.from_json(F.lit("{}"), OBJECT))
            df = df.withColumn(name, decoded)
    if "tags" in df.columns:
        df = df.withColumn(
            "tags", F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>"))
        )
    return df


def all_of(conditions: list[Column]) -> Column:
    result = F.lit(True)
    for c in conditions:
        result = result & c
    return result
