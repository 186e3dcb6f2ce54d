"""Ordered computations per key that no single task has to carry alone.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends all rows of a key to one
task, which fails once one market holds a third of the data.  Here a large key
is cut into *cells* along its order, sized by counting its rows (``cells``).
Work inside a cell is an ordinary window over ``(key, cell)``; what a cell must
know of the cells before it is one carry row per cell, computed from the rows
where they already lie and joined back.  Where no key is larger than a cell
there is nothing to carry, and the plan is one window over the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cells import CELL_ROWS, Cells, counted_cells
from tidemark.session import durable

_FIRST = Window.unboundedPreceding
SKETCH_ACCURACY = 10_000  # a sketch's rank is off by at most a row in so many
SKETCH_SLACK = 3.0 / SKETCH_ACCURACY

# Where the cells of an operator come from: a directory made beforehand (one for all operators on the same order), a
# column that never falls along the order, or None: the operator counts its own input.
Cut = Cells | Column | None


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Cut) -> tuple[DataFrame, bool]:
    """``df`` with ``_cell``, and whether every key is one cell."""
    if isinstance(cell, Column):
        return df.withColumn("_cell", cell), False
    cells = counted_cells(df, keys, order) if cell is None else cell
    return cells.place(df), cells.single


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe left join on ``keys`` that keeps each key once."""
    renamed = right
    for i, key in enumerate(keys):
        renamed = renamed.withColumnRenamed(key, f"_r{i}")
    condition = reduce(
        lambda a, b: a & b,
        [F.col(key).eqNullSafe(F.col(f"_r{i}")) for i, key in enumerate(keys)],
    )
    return left.join(renamed, condition, "left").drop(*[f"_r{i}" for i in range(len(keys))])


_RUNNING: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _combine(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    if kind == "last":
        return F.coalesce(here, before)
    if kind == "max":
        return F.greatest(before, here)
    return F.least(before, here)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Cut,
    columns: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Running aggregates from the first row of the key up to the current row.

    ``columns`` maps an output name to ``(kind, expression)`` with kind one of
    sum, max, min, last (last non-null value).  ``order`` must be total within
    a key.
    """
    keys = list(keys)
    kept = [c for c in df.columns if c not in columns]
    cut, single = placed(df, keys, order, cell)
    if single:
        along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(_FIRST, 0)
        return df.select(*kept, *[_RUNNING[kind](e).over(along).alias(n) for n, (kind, e) in columns.items()])
    # One struct holds key and cell: equal structs may contain nulls, so plain
    # equality is null-safe and the exchange of the window also serves the join.
    base = cut.withColumn("_g", F.struct(*keys, "_cell"))
    within = Window.partitionBy("_g").orderBy(*order).rowsBetween(_FIRST, 0)
    local = base.select(
        *df.columns, "_g", *[_RUNNING[kind](e).over(within).alias(f"_l_{n}") for n, (kind, e) in columns.items()]
    )
    # the last row of a cell holds its totals; the rows are clustered by cell already, so this moves none
    ended = F.struct(*[F.col(f"_l_{n}") for n in columns])
    totals = local.groupBy("_g").agg(F.max_by(ended, F.struct(*order)).alias("_t"))
    earlier = Window.partitionBy(*[F.col(f"_g.{k}") for k in keys]).orderBy("_g._cell").rowsBetween(_FIRST, -1)
    carry = totals.select(
        F.col("_g").alias("_gc"),
        *[_RUNNING[kind](F.col(f"_t._l_{n}")).over(earlier).alias(f"_c_{n}") for n, (kind, _) in columns.items()],
    )
    joined = local.join(carry, F.col("_g") == F.col("_gc"))
    return joined.select(
        *kept, *[_combine(kind, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (kind, _) in columns.items()]
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Cut,
    columns: dict[str, Column],
    extremes: dict[str, str],
) -> DataFrame:
    """Running sums together with their running maximum or minimum, in one pass over the rows.

    For each name in ``columns`` the output has the running sum under that name
    and its running ``max`` or ``min`` (per ``extremes``) as ``<name>_peak``.
    Inside a cell both come from windows over the same rows; across cells the
    extreme of a cell is lifted by the total before it, so the carry needs only
    (total, extreme) per cell.
    """
    keys = list(keys)
    cut, single = placed(df, keys, order, cell)
    if single:
        along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(_FIRST, 0)
        summed = df.select(*df.columns, *[F.sum(c).over(along).alias(n) for n, c in columns.items()])
        return summed.select("*", *[_RUNNING[extremes[n]](F.col(n)).over(along).alias(f"{n}_peak") for n in columns])
    base = cut.withColumn("_g", F.struct(*keys, "_cell")).withColumns({f"_x_{n}": c for n, c in columns.items()})
    within = Window.partitionBy("_g").orderBy(*order).rowsBetween(_FIRST, 0)
    local = base.withColumns({f"_l_{n}": F.sum(f"_x_{n}").over(within) for n in columns}).withColumns(
        {f"_p_{n}": _RUNNING[extremes[n]](F.col(f"_l_{n}")).over(within) for n in columns}
    )
    # already clustered by cell: this aggregate moves no rows
    totals = local.groupBy("_g").agg(
        *[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in columns],
        *[_RUNNING[extremes[n]](F.col(f"_l_{n}")).alias(f"_e_{n}") for n in columns],
    )
    earlier = Window.partitionBy(*[F.col(f"_g.{k}") for k in keys]).orderBy("_g._cell").rowsBetween(_FIRST, -1)
    lifted = totals.withColumns({f"_c_{n}": F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0.0)) for n in columns})
    carry = lifted.select(
        F.col("_g").alias("_gc"),
        *[f"_c_{n}" for n in columns],
        *[_RUNNING[extremes[n]](F.col(f"_c_{n}") + F.col(f"_e_{n}")).over(earlier).alias(f"_q_{n}") for n in columns],
    )
    joined = local.join(carry, F.col("_g") == F.col("_gc"))
    return joined.select(
        *df.columns,
        *[(F.col(f"_c_{n}") + F.col(f"_l_{n}")).alias(n) for n in columns],
        *[
            _combine(extremes[n], F.col(f"_q_{n}"), F.col(f"_c_{n}") + F.col(f"_p_{n}")).alias(f"{n}_peak")
            for n in columns
        ],
    )


def index_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Cut = None, out: str = "row_idx"
) -> DataFrame:
    """Exact zero-based position of each row inside its key."""
    counted = running(df, keys, order, cell, {out: ("sum", F.lit(1).cast("long"))})
    return counted.withColumn(out, F.col(out) - 1)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Cut,
    columns: dict[str, Callable[[Callable[[int, int], object]], Column]],
    before: int = 0,
    after: int = 0,
    block_rows: int = 65536,
    index: str | None = None,
) -> DataFrame:
    """Window expressions with a bounded row frame, over blocks of equal size.

    Rows of large keys are numbered inside their key, cut into blocks of ``block_rows`` and
    the ``before``/``after`` neighbours of each block are copied into it, so
    every frame is complete inside one block.  ``columns`` maps a name to a
    function that receives ``frame(lo, hi)`` (a window spec) and returns a
    column.  ``index`` keeps the row number under that name.
    """
    if max(before, after) > block_rows:
        raise ValueError("block_rows must cover the frame")
    keys = list(keys)
    if cell is None:
        cell = counted_cells(df, keys, order)
    if isinstance(cell, Cells) and cell.single:
        whole = Window.partitionBy(*keys).orderBy(*order)
        number = [(F.row_number().over(whole).cast("long") - 1).alias(index)] if index else []
        made = [make(lambda lo, hi: whole.rowsBetween(lo, hi)).alias(name) for name, make in columns.items()]
        return df.select(*df.columns, *made, *number)
    numbered = index_rows(df, keys, order, cell, "_idx")
    own = F.floor(F.col("_idx") / block_rows)
    offset = F.col("_idx") - own * block_rows
    # position p of block b is needed by b+1 when p lies in the last `before`
    # rows, and by b-1 when p lies in the first `after` rows
    homes = F.array_compact(
        F.array(
            own,
            F.when(offset >= block_rows - before, own + 1),
            F.when((offset < after) & (own > 0), own - 1),
        )
    )
    spread = numbered.withColumn("_own", own).withColumn("_block", F.explode(homes))

    def frame(lo: int, hi: int):
        spec = Window.partitionBy(*keys, "_block").orderBy("_idx")
        return spec.rowsBetween(lo, hi)

    out = spread.select(
        *df.columns, "_idx", "_own", "_block", *[make(frame).alias(name) for name, make in columns.items()]
    ).where(F.col("_own") == F.col("_block"))
    keep = [*df.columns, *columns]
    if index:
        return out.select(*keep, F.col("_idx").alias(index))
    return out.select(*keep)


def checked_broadcast(df: DataFrame, limit: int = 20_000) -> DataFrame:
    """Broadcast hint for a durable table of at most ``limit`` rows; otherwise a shuffled join.

    The count reads the checkpoint, not the lineage behind it.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def cumulative_counts(
    df: DataFrame, keys: Sequence[str], value: str, counts: dict[str, Column], cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Distinct values per key with running totals of ``counts`` up to and including each.

    Equal values are combined before any shuffle; a key of more than
    ``cell_rows`` rows is cut along its values, so it is shared by many tasks.
    """
    keys = list(keys)
    valued = df.where(F.col(value).isNotNull())
    cells = counted_cells(valued, keys, [value], cell_rows)
    tallied = valued.groupBy(*keys, value).agg(*[F.sum(expr.cast("long")).alias(name) for name, expr in counts.items()])
    return running(tallied, keys, [value], cells, {f"cum_{n}": ("sum", F.col(n)) for n in counts})


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Exact linear-interpolation quantiles per key without sorting or holding a large key.

    Keys of at most ``cell_rows`` rows are one aggregate.  Otherwise a first pass
    takes bounds around each wanted rank from mergeable sketches, and a second
    counts the values between the bounds and the rows outside, which gives the
    exact ranks; the rows themselves are not moved.  Should a rank lie outside its
    bounds, the cells of the value order are counted instead.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    ends = [end for p in probs.values() for end in (max(p - SKETCH_SLACK, 0.0), min(p + SKETCH_SLACK, 1.0))]
    sketches = durable(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), F.percentile_approx(value, ends, SKETCH_ACCURACY).alias("_ends"))
    )
    n_keys, largest = sketches.where("_total > 0").agg(F.count(F.lit(1)), F.max("_total")).first()
    if not largest or largest <= cell_rows:
        return rows.groupBy(*keys).agg(*[F.percentile(value, float(p)).alias(n) for n, p in probs.items()])
    ranked = durable(_bounded_ranks(rows, sketches, keys, value, probs))
    sure = reduce(lambda a, b: a & b, [F.col(f"_{side}_{n}").isNotNull() for n in probs for side in ("lo", "hi")])
    if ranked.where(sure).count() < n_keys:
        ranked = _celled_ranks(rows, keys, value, probs, cell_rows)
    return ranked.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probs
        ],
    )


def _bounded_ranks(rows: DataFrame, sketches: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Both order statistics around each quantile (null: not between its bounds), from one count of all rows."""
    v = F.col(value)
    within = [v.between(F.get("_ends", F.lit(2 * i)), F.get("_ends", F.lit(2 * i + 1))) for i in range(len(probs))]
    inside = reduce(lambda a, b: a | b, within)
    # a row outside all bounds lies behind the largest upper bound below it
    below = F.greatest(F.lit(None), *[F.when(F.get("_ends", F.lit(2 * i + 1)) < v, F.get("_ends", F.lit(2 * i + 1))) for i in range(len(probs))])
    beside = attach(rows, checked_broadcast(sketches), keys) if keys else rows.crossJoin(F.broadcast(sketches))
    tallied = beside.groupBy(*keys, "_total", F.when(inside, v).otherwise(below).alias("_at"), (~inside).alias("_out")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    along = Window.partitionBy(*keys).orderBy("_at", "_out").rowsBetween(_FIRST, 0)  # a row per value between bounds
    upto = tallied.withColumn("_upto", F.sum("_n").over(along)).where(~F.col("_out")).withColumn("_wanted", _ranks(probs))
    return _picked(upto, keys, "_at", probs)


def _ranks(probs: dict[str, float]) -> Column:
    return F.array(*[
        F.struct(F.lit(name).alias("name"), rank(F.lit(float(p)) * (F.col("_total") - 1)).cast("long").alias("rank"))
        for name, p in probs.items()
        for rank in (F.floor, F.ceil)
    ])


def _picked(upto: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """The values at the wanted ranks, from values with their counts ``_n`` and running counts ``_upto``."""
    here = F.filter("_wanted", lambda r: (r["rank"] < F.col("_upto")) & (r["rank"] >= F.col("_upto") - F.col("_n")))
    found = upto.withColumn("_r", F.explode(here))
    picks = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        at = lambda rank: F.max(F.when((F.col("_r.name") == name) & (F.col("_r.rank") == rank), F.col(value)))  # noqa: B023, E731
        picks += [
            at(F.floor(position)).alias(f"_lo_{name}"),
            at(F.ceil(position)).alias(f"_hi_{name}"),
            F.max(position - F.floor(position)).alias(f"_w_{name}"),
        ]
    return found.groupBy(*keys).agg(*picks)


def _celled_ranks(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float], cell_rows: int) -> DataFrame:
    """As ``_bounded_ranks``: a pass counts rows per cell of the value order, a second reads the cells that hold the ranks."""
    cells = counted_cells(rows, keys, [value], cell_rows)
    cut = cells.place(rows)
    sizes = cut.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys)  # a row per cell
    located = sizes.withColumn(
        "_before", F.coalesce(F.sum("_n").over(by_key.orderBy("_cell").rowsBetween(_FIRST, -1)), F.lit(0))
    ).withColumn("_total", F.sum("_n").over(by_key))
    holds = (F.col("_before") <= F.col("_r.rank")) & (F.col("_r.rank") < F.col("_before") + F.col("_n"))
    wanted = durable(
        located.withColumn("_r", F.explode(_ranks(probs))).where(holds)
        .groupBy(*keys, "_cell", "_before", "_total")
        .agg(F.collect_set("_r").alias("_wanted"))
    )
    hit = attach(cut, checked_broadcast(wanted), [*keys, "_cell"]).where(F.col("_wanted").isNotNull())
    tallied = hit.groupBy(*keys, "_cell", value).agg(
        F.count(F.lit(1)).alias("_n"), F.first("_before").alias("_before"), F.first("_total").alias("_total"),
        F.first("_wanted").alias("_wanted"),
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(_FIRST, 0)
    upto = tallied.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    return _picked(upto, keys, value, probs)
