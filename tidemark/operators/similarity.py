"""Largest cosine similarity to a memory of vectors, by a block join that skips what a bound rules out.

Memory vectors are grouped around pivots (some of them, picked by hash).  By the triangle inequality for angles no
vector of a group can be nearer to a candidate than the candidate's angle to the pivot less the group's radius.  A
candidate meets its nearest group first; then it visits only groups whose bound lies below the best angle so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable

PIVOTS = 64  # groups at most: what every task holds is this many vectors
SLACK = 1e-7  # angle of rounding in a bound
PART, COPIES = 256, 4096  # candidates compared, and copies sent, at a time


def recent(memory: DataFrame, now: Column, days: int = 30, created: str = "created_at") -> DataFrame:
    """The memory of a check made at ``now``: what was created within the last ``days`` days, both ends included."""
    return memory.where(F.col(created).between(now - F.make_dt_interval(F.lit(days)), now))


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a usable vector, and those vectors at length 1; components stay packed numbers throughout."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    parts = pc.list_flatten(column)  # rows that are null have no parts
    values = np.asarray(pc.fill_null(parts.cast(pa.float64()), np.nan))
    ends = np.cumsum(sizes)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    some = np.concatenate(([0], np.cumsum(np.nan_to_num(values, nan=1.0) != 0)))
    usable = (bad[ends] == bad[ends - sizes]) & (some[ends] > some[ends - sizes])
    good = np.flatnonzero(usable)
    if not len(good):
        return good, np.empty((0, 0))
    rows = values[np.repeat(usable, sizes)].reshape(len(good), -1)
    # scaled first: squares of very large or small components must not leave the range of doubles
    made = rows / np.abs(rows).max(axis=1, keepdims=True)
    return good, made / np.linalg.norm(made, axis=1, keepdims=True)


def _stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Units of equal length as rows of a matrix."""
    flat = pc.list_flatten(column)
    return np.asarray(flat).reshape(len(column), -1)


def _lists(units: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1, dtype=np.int32) * units.shape[1]), pa.array(units.ravel()))


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _grouped(df: DataFrame, key: str, vector: str, pivots: np.ndarray) -> DataFrame:
    """(key, unit, group, angle): each usable vector at length 1 beside its nearest pivot."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, units = _units(batch.column(1))
            if len(good):
                angle = _angles(units, pivots)
                group = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(good)), _lists(units), pa.array(group.astype(np.int32)), pa.array(angle.min(axis=1))],
                    names=[key, "unit", "group", "angle"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vector).mapInArrow(work, f"`{key}` {kind}, unit array<double>, group int, angle double")


def _nearest(asked: DataFrame, memory: DataFrame, sizes: dict[int, int], key: str, rows: int) -> DataFrame:
    """(key, sim): largest similarity of each (candidate, group) row of ``asked`` inside that group.

    A group of the memory is cut into chunks, its visitors into lanes, both of about ``rows`` vectors by hash; a task holds one
    of each, and one maximum per candidate leaves it.
    """
    visits = {r["group"]: r["n"] for r in asked.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most PIVOTS rows
    parts = lambda counts: F.element_at(
        F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, max(1, -(-n // rows)))]), F.col("group")
    )
    if not visits or not sizes:
        return asked.select(key, F.lit(0.0).alias("sim")).limit(0)
    chunks, lanes = parts(sizes), parts(visits)
    left = asked.withColumn("lane", F.pmod(F.xxhash64(key, F.lit(1)), lanes).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), chunks - 1))
    )
    right = memory.where(F.col("group").isin(list(visits))).withColumn("chunk", F.pmod(F.xxhash64(key), chunks).cast("int")).withColumn(
        "lane", F.explode(F.sequence(F.lit(0), lanes - 1))
    )
    kind = asked.schema[key].dataType.simpleString()
    on = ["group", "chunk", "lane"]

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        top = np.full(a.num_rows, -1.0)
        if a.num_rows and b.num_rows:
            units = [_stacked(t.column("unit")) for t in (a, b)]
            top = np.concatenate([(part @ units[1].T).max(axis=1) for part in np.array_split(units[0], -(-a.num_rows // PART))])
        return pa.table({key: a.column(key), "sim": top})

    found = left.select(key, "unit", *on).groupBy(*on).cogroup(right.select("unit", *on).groupBy(*on)).applyInArrow(best, f"`{key}` {kind}, sim double")
    return found.groupBy(key).agg(F.max("sim").alias("sim"))


def similarity(
    candidates: DataFrame, memory: DataFrame, key: str, vector: str, threshold: float = 0.85, chunk_rows: int = 4096, pivots: int = PIVOTS
) -> DataFrame:
    """(key, max_similarity, is_duplicate, groups_visited) of every candidate.

    Exact: groups are skipped only where no vector in them can be nearer.  With an empty memory, and for candidates whose
    vector is null, zero or not finite, the answer is (0, false) after no visit; such memory vectors take no part.  Keys of
    candidates are unique; vectors have one length.
    """
    usable = F.col(vector).isNotNull() & F.exists(vector, lambda v: v != 0)
    drawn = memory.where(usable).orderBy(F.xxhash64(key), key).limit(pivots).select(vector).toArrow()  # at most PIVOTS vectors
    centres = _units(drawn.column(0))[1]
    asked = candidates.select(key)
    if not len(centres):
        return asked.select(key, F.lit(0.0).alias("max_similarity"), F.lit(False).alias("is_duplicate"), F.lit(0).alias("groups_visited"))
    known = durable(_grouped(memory, key, vector, centres))
    placed = durable(_grouped(candidates, key, vector, centres))
    groups = {r["group"]: r for r in known.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()}
    sizes = {g: r["n"] for g, r in groups.items()}
    held = sorted(groups)
    radii, places = np.array([groups[g]["radius"] for g in held]), centres[held]
    kind = candidates.schema[key].dataType.simpleString()

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups that may hold a nearer vector than the best so far (null: none yet, then the nearest group alone)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _stacked(batch.column(1))
            angle = _angles(units, places)
            first = angle.argmin(axis=1)
            wanted = np.zeros(angle.shape, bool)
            if batch.column(2).null_count == batch.num_rows:
                wanted[np.arange(len(first)), first] = True
            else:
                reached = np.arccos(np.clip(np.asarray(batch.column(2)), -1.0, 1.0))
                wanted = angle - radii <= reached[:, None] + SLACK
                wanted[np.arange(len(first)), first] = False
            rows, groups_of = np.nonzero(wanted)
            # a candidate may visit many groups: its copies leave some at a time
            for at in range(0, len(rows), COPIES):
                row, group = pa.array(rows[at : at + COPIES]), groups_of[at : at + COPIES]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.array(held, np.int32)[group])], names=[key, "unit", "group"]
                )

    schema = f"`{key}` {kind}, unit array<double>, group int"
    own = durable(_nearest(placed.select(key, "unit", F.lit(None).cast("double").alias("sim")).mapInArrow(visits, schema), known, sizes, key, chunk_rows))
    further = durable(placed.select(key, "unit").join(own, key).select(key, "unit", "sim").mapInArrow(visits, schema))
    rest = _nearest(further, known, sizes, key, chunk_rows).withColumnRenamed("sim", "_rest")
    counted = further.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    joined = asked.join(own, key, "left").join(rest, key, "left").join(counted, key, "left")
    top = F.coalesce(F.greatest("sim", "_rest"), F.lit(0.0))
    seen = F.when(F.col("sim").isNull(), 0).otherwise(1 + F.coalesce("_n", F.lit(0))).cast("int")
    return joined.select(key, top.alias("max_similarity"), (top > threshold).alias("is_duplicate"), seen.alias("groups_visited"))
