"""Cells sized by counts: cut points along a key's order that leave a bounded number of rows between them.

A calendar unit or a fixed number of value ranges says nothing about how many
rows fall into it.  Here the rows are counted: keys of at most ``rows`` rows
are one cell, and only larger keys get cut points, found by a histogram that
cuts a piece again, between its own bounds, while it still holds too many rows.
Rows that share the first order column are cut by the second.

The directory holds a few entries per ``rows`` rows of the large keys and never
more than about ``4 * MOST_CELLS`` of them (beyond that the cells grow), so it is
broadcast whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import durable

CELL_ROWS = 1_000_000
MOST_CELLS = 50_000
PIECES = 64  # pieces of one cut

_HUGE = 1.7976931348623157e308


def order_code(kind: T.DataType, name: str) -> Column:
    """A number that sorts as the column does; constant for types that cannot be cut by arithmetic."""
    c = F.col(name)
    if isinstance(kind, T.TimestampNTZType | T.TimestampType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.FractionalType):
        return c.cast("double")
    if isinstance(kind, T.IntegralType | T.BooleanType):
        return c.cast("long")
    return F.lit(0).cast("long")


class Cells:
    """Cut points per key.  ``bounds`` is None where every key is one cell."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], bounds: DataFrame | None = None, longest: int = 0):
        self.keys, self.order, self.bounds, self.longest = list(keys), list(order), bounds, longest

    @property
    def single(self) -> bool:
        return self.bounds is None

    def place(self, df: DataFrame, out: str = "_cell") -> DataFrame:
        """``df`` with the number of each row's cell: non-decreasing along the order, 0 for keys that are one cell."""
        if self.single:
            return df.withColumn(out, F.lit(0))
        joined = _beside(df, self.bounds, self.keys)
        found = _search(F.col("_b.cuts"), _row(df, self.order), self.longest)
        return joined.withColumn(out, F.coalesce(found, F.lit(0))).drop("_b")


def _row(df: DataFrame, order: Sequence[str]) -> Column:
    kinds = {f.name: f.dataType for f in df.schema}
    codes = [order_code(kinds[c], c) for c in order[:2]]
    if len(codes) < 2:
        codes.append(F.lit(0).cast("long"))
    return F.struct(codes[0].alias("c1"), codes[1].alias("c2"))


def _beside(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with its key's entry of a bounded table in ``_b`` (null for keys without one)."""
    packed = table.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("k")).alias("_k"),
                          F.struct(*[c for c in table.columns if c not in keys]).alias("_b"))
    if not keys:
        return df.withColumn("_b", packed.select("_b").scalar())
    own = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("k"))
    # structs of equal fields are equal, nulls among them too
    return df.withColumn("_k0", own).join(F.broadcast(packed), F.col("_k0") == F.col("_k"), "left").drop("_k0", "_k")


def _search(cuts: Column, row: Column, longest: int) -> Column:
    """How many cut points lie at or before the row, by halving."""
    steps = [1 << k for k in range(max(longest, 1).bit_length() - 1, -1, -1)]
    size = F.size(cuts)
    further = lambda i, s: (i + s <= size) & (F.get(cuts, i + s - 1) <= row)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda i, s: F.when(further(i, s), i + s).otherwise(i))


def _share(v: Column, low: Column, high: Column, logarithmic: bool) -> Column:
    """Place of v between two bounds, from 0 to 1, never falling as v grows."""
    number = lambda c: F.greatest(F.least(c.cast("double"), F.lit(_HUGE)), F.lit(-_HUGE))
    gap = lambda a, b: F.coalesce(F.try_subtract(a, b).cast("double"), number(a) - number(b))
    linear = number(gap(v, low)) / F.greatest(number(gap(high, low)), F.lit(5e-324))
    if not logarithmic:
        return linear
    size = lambda c: F.log(F.greatest(F.abs(number(c)), F.lit(5e-324)))
    rising = (size(v) - size(low)) / (size(high) - size(low))
    falling = (size(low) - size(v)) / (size(low) - size(high))
    far = lambda small, large: number(large) / 4 > number(small)
    return (
        F.when((low > 0) & far(low, high), rising)
        .when((high < 0) & far(-number(high), -number(low)), falling)
        .when((low < 0) & (high > 0), F.when(v < 0, 0.0).when(v == 0, 0.5).otherwise(1.0))
        .otherwise(linear)
    )


def counted_cells(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = CELL_ROWS) -> Cells:
    """The directory of ``df``: at most ``rows`` rows a cell, except rows that agree in the first two order columns.

    One pass over keys and order columns tells whether any key is large; only then are rows of large keys read again.
    Null order values sort first and lie in the first cell.
    """
    keys, order = list(keys), list(order)
    codes = df.select(*keys, _row(df, order).alias("_row")).select(*keys, "_row.c1", "_row.c2").where("c1 IS NOT NULL")
    spans = [F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}{c}") for c in ("c1", "c2") for n, f in (("lo_", F.min), ("hi_", F.max))]]
    by_key = codes.groupBy(*keys).agg(*spans)
    total, largest = by_key.agg(F.sum("n"), F.max("n")).first()
    rows = max(rows, -(-(total or 0) // MOST_CELLS))
    if not total or largest <= rows:
        return Cells(keys, order)
    none = F.lit(None).cast(codes.schema["c2"].dataType)
    ranges = durable(by_key.where(F.col("n") > rows).withColumn("cut2", none))
    splits = (F.col("lo_c1") < F.col("hi_c1")) | F.coalesce(F.col("lo_c2") < F.col("hi_c2"), F.lit(False))
    turn = 0
    while not ranges.where((F.col("n") > rows) & splits).isEmpty():
        ranges = durable(_merged(_cut(codes, ranges, keys, rows, turn % 2 == 1, spans, splits), keys, rows))
        turn += 1
    lists = ranges.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("lo_c1").alias("c1"), F.col("cut2").alias("c2")))).alias("cuts"))
    bounds = durable(lists.select(*keys, F.expr("slice(cuts, 2, greatest(size(cuts) - 1, 0))").alias("cuts")).where(F.size("cuts") > 0))
    longest = bounds.agg(F.max(F.size("cuts"))).first()[0]
    return Cells(keys, order, bounds, longest) if longest else Cells(keys, order)


def _cut(codes: DataFrame, ranges: DataFrame, keys: list[str], rows: int, logarithmic: bool, spans: list, splits: Column) -> DataFrame:
    """Ranges with those of too many rows cut into pieces, counted in one pass over the rows of their keys."""
    large = (F.col("n") > rows) & splits
    fields = ["lo_c1", "cut2", "hi_c1", "lo_c2", "hi_c2"]
    lists = ranges.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*fields, large.alias("large")))).alias("ranges"), F.count(F.lit(1)).alias("_size")
    )
    lists = durable(lists.where(F.exists("ranges", lambda r: r["large"])))
    longest = lists.agg(F.max("_size")).first()[0]
    cuts = F.transform("_b.ranges", lambda r: F.struct(r["lo_c1"].alias("c1"), r["cut2"].alias("c2")))
    beside = _beside(codes, lists, keys).where(F.col("_b").isNotNull()).withColumn("_cuts", cuts)
    found = beside.withColumn("_at", F.greatest(_search(F.col("_cuts"), F.struct("c1", "c2"), longest), F.lit(1)))
    own = found.withColumn("_r", F.get("_b.ranges", F.col("_at") - 1)).where("_r.large")
    first = F.col("_r.lo_c1") < F.col("_r.hi_c1")
    share = F.when(first, _share(F.col("c1"), F.col("_r.lo_c1"), F.col("_r.hi_c1"), logarithmic)).otherwise(
        _share(F.coalesce("c2", "_r.lo_c2"), F.col("_r.lo_c2"), F.col("_r.hi_c2"), logarithmic)
    )
    piece = F.least(F.floor(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * PIECES), F.lit(PIECES - 1)).cast("int")
    counted = own.groupBy(*keys, "_at", first.alias("_first"), piece.alias("_piece")).agg(*spans)
    pieces = counted.withColumn("cut2", F.when(~F.col("_first"), F.col("lo_c2")))
    columns = [*keys, "n", *fields]
    return ranges.where(~large).select(*columns).unionByName(pieces.select(*columns))


def _merged(ranges: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Neighbours joined while they hold at most ``rows`` together, so the directory stays small."""
    half = max(1, rows // 2)
    along = Window.partitionBy(*keys).orderBy("lo_c1", "cut2")
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavy = F.col("n") > half
    # a heavy range stands alone, and moves the count on by more than half
    numbered = ranges.withColumn("_group", F.floor(before / half)).withColumn("_heavy", heavy)
    head = F.min(F.struct("lo_c1", "cut2")).alias("_head")
    return numbered.groupBy(*keys, "_group", "_heavy").agg(
        F.sum("n").alias("n"), head, F.max("hi_c1").alias("hi_c1"), F.min("lo_c2").alias("lo_c2"), F.max("hi_c2").alias("hi_c2")
    ).select(*keys, "n", F.col("_head.lo_c1").alias("lo_c1"), "hi_c1", "lo_c2", "hi_c2", F.col("_head.cut2").alias("cut2"))
