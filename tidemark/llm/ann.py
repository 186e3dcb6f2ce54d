"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, exact recomputation, heap merge."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, spread
from tidemark.session import durable

BLOCK = 2048  # vectors of one tile side


def valid(vector: Column) -> Column:
    """Neither null, empty nor zero, and no null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their scale, and the norm of what the codes leave out."""
    unit = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - codes * scale[:, None]
    return codes, scale, np.sqrt((rest * rest).sum(axis=1)) + 1e-12


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; components are added in their order, so equal vectors give equal scores."""
    dot, na, nb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        na += a[:, j] * a[:, j]
        nb += b[:, j] * b[:, j]
    return np.clip(dot / np.sqrt(na * nb), -1.0, 1.0)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products of int8 tiles; float32 holds sums of 1,024 products exactly, wider vectors go in steps."""
    out = np.zeros((len(q), len(c)))
    for j in range(0, q.shape[1], 1024):
        out += q[:, j : j + 1024].astype(np.float32) @ c[:, j : j + 1024].astype(np.float32).T
    return out


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, candidate, score) of the k nearest candidates of every query within one tile.

    |x.y - s_x s_y (X.Y)| <= e_x + e_y + e_x e_y for unit vectors with codes X, Y, scales s and left-out norms e.
    A candidate survives when its upper bound reaches the k-th largest lower bound; survivors are scored exactly.
    """
    qx, qs, qe = quantise(q)
    cx, cs, ce = quantise(c)
    near = products(qx, cx) * qs[:, None] * cs[None, :]
    slack = qe[:, None] + ce[None, :] + qe[:, None] * ce[None, :] + 1e-9
    low, high = near - slack, near + slack
    own = q_ids[:, None] == c_ids[None, :]
    low[own] = high[own] = -np.inf
    if low.shape[1] > k:
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
    else:
        floor = np.full(len(q), -np.inf)
    i, j = np.nonzero((high >= floor[:, None]) & ~own)
    for start in range(0, len(q), 64):  # so many queries at a time that their survivors fit
        part = slice(np.searchsorted(i, start), np.searchsorted(i, start + 64))
        x, y = i[part], j[part]
        score = exact_cosine(q[x], c[y])
        for n in np.unique(x):
            mine = x == n
            best = heapq.nsmallest(k, zip((-score[mine]).tolist(), c_ids[y[mine]].tolist()))
            for s, vec in best:
                yield int(q_ids[n]), vec, -s


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of every row for which ``queries`` holds.

    Nearest is the largest cosine in double precision of the vectors as given, ties to the smaller id.  Vectors that
    are null, empty, zero or hold a null or non-finite component take no part, nor do null ids; vectors of other
    lengths are compared among themselves; repeated rows of one vector are one row; of different vectors under one id
    both stay.  Fewer candidates give fewer rows; an empty table gives an empty result.

    Both sides are dealt by hash into blocks of about ``block`` rows; every query block meets every candidate block in a
    task group of its own, so a group holds two blocks whatever the size of the table, and the result is exact.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = durable(
        vectors.where(valid(F.col(vector)) & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"),
                F.coalesce(queries, F.lit(False)).alias("asks"))
        .dropDuplicates(["vec_id", "vector"]).withColumn("dim", F.size("vector"))
    )
    sizes = {r["dim"]: r for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()}
    blocks = lambda n: max(1, -(-int(n) // block))
    schema = "query_id long, vec_id long, score double"
    parts = []
    for dim, size in sorted(sizes.items()):
        own, c_blocks, q_blocks = rows.where(F.col("dim") == dim), blocks(size["n"]), blocks(size["q"])
        dealt = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        left = own.where("asks").select("vec_id", "vector", F.lit(True).alias("asks"), dealt(q_blocks).alias("qb"), every(c_blocks).alias("cb"))
        right = own.select("vec_id", "vector", F.lit(False).alias("asks"), every(q_blocks).alias("qb"), dealt(c_blocks).alias("cb"))
        parts.append(spread(left.unionByName(right), "qb", "cb").sortWithinPartitions("qb", "cb", "asks"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def search(batches: Iterator[pa.RecordBatch]):
        key, held = None, {False: [], True: []}

        def flush():
            if held[False] and held[True]:
                side = {a: (np.concatenate([x for x, _ in h]), np.concatenate([v for _, v in h])) for a, h in held.items()}
                found = list(tile(*side[True], *side[False], k))
                if found:
                    q, v, s = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())],
                        names=["query_id", "vec_id", "score"],
                    )

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            column = batch.column(1)
            data = np.asarray(column.flatten()).reshape(len(ids), -1)
            asks = np.asarray(batch.column(2).cast(pa.int8()))
            marks = np.stack([np.asarray(batch.column(3)), np.asarray(batch.column(4)), asks], axis=1)
            cuts = np.flatnonzero(np.any(marks[1:] != marks[:-1], axis=1)) + 1
            for rows_ in np.split(np.arange(len(ids)), cuts):
                now = tuple(marks[rows_[0], :2])
                if now != key:
                    yield from flush()
                    key, held = now, {False: [], True: []}
                held[bool(marks[rows_[0], 2])].append((ids[rows_], data[rows_]))
        yield from flush()

    found = parts[0].mapInArrow(search, schema)
    for part in parts[1:]:
        found = found.union(part.mapInArrow(search, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
