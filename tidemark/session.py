"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that hold for every deployment.  Cluster sizing (executors, memory,
# shuffle partitions) belongs to spark-submit, not to this library.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", app: str = "tidemark", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Needed wherever the executors do not have it installed; a no-op after the first call.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = tempfile.mkdtemp(prefix="tidemark-pkg-")
    archive = shutil.make_archive(f"{target}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set and the master is local."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-ckpt-"))
    return named or context.getCheckpointDir()


def task_count(df: DataFrame) -> int:
    """Partitions for work that costs much more processor time than bytes.

    Adaptive execution merges small partitions by size, which would put such
    work in a few tasks; an explicit count is left alone.
    """
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so a lost executor cannot change the result.

    Used where a plan reads one intermediate twice and both reads must agree
    (sketch-derived split points) or where a loop would otherwise grow the plan.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
