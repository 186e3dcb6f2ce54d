"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checked_broadcast
from tidemark.session import durable

NONE = "(none)"
WORD = r"[^\x09-\x0D\x20]+"
# Surface topics, first match wins: what a document is made of, told from its text.
TOPICS: Sequence[tuple[str, str]] = (
    ("tabular", r" \| .* \| "),
    ("licence", r"(?i)(licen[sc]e|copyright|warrant)"),
    ("contact", r"([0-9]{3}[) .-]+[0-9]{3}|@[A-Za-z0-9]+\.[a-z])"),
    ("noisy", r"[#$%&*]{3}"),
)
REST = "prose"


def topic_of(text: Column, topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    """Topic of a whole text; null texts are of the last, unnamed kind."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(topics):
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit(REST))


def token_weight(text: Column) -> Column:
    """White-space separated words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rake(
    cells: DataFrame, dims: Sequence[str], targets: Mapping[str, DataFrame] | None = None, power: float = 0.7,
    rounds: int = 10,
) -> DataFrame:
    """``cells`` (dims, tokens) with the fitted ``weight``: tokens * weight sums to the target share of each value.

    ``targets`` maps a dimension to a table (value, share); without one, a value's share is its token share to the
    power ``power``.  Shares are normalised over the values present.  Each round scales every dimension in turn, the
    last one exactly; a value without target share gets weight 0, a cell without tokens keeps its weight.
    """
    out = cells.withColumn("weight", F.lit(1.0))
    for dim in dims:
        own = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("n"))
        if targets and dim in targets:
            given = targets[dim].select(F.col("value").alias("__v"), F.col("share").alias("__s"))
            want = own.join(given, F.col(dim) == F.col("__v"), "left").select(
                dim, F.coalesce(F.col("__s"), F.lit(0.0)).alias("__w")
            )
        else:
            want = own.select(dim, F.pow("n", F.lit(power)).alias("__w"))
        total = want.agg(F.sum("__w").alias("t"))
        share = want.select(dim, (F.col("__w") / F.nullif(total.scalar(), F.lit(0.0))).alias(f"__t_{dim}"))
        out = out.join(share, dim)
    out = durable(out)
    mass = out.agg(F.sum("tokens").cast("double").alias("m"))
    out = durable(out.withColumn("__m", mass.scalar()))
    for step in range(rounds):
        for dim in dims:
            now = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(dim))
            scale = F.when(now > 0, F.col("__m") * F.col(f"__t_{dim}") / now).otherwise(1.0)
            out = out.withColumn("weight", F.col("weight") * scale)
        if step % 5 == 4:
            out = durable(out)
    return out.select(*dims, "tokens", "weight")


def unit_draw(seed: int, *columns: Column) -> Column:
    """Number in [0, 1) from the row's own values: the same on every attempt and in any order."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", lang: str = "lang",
    targets: Mapping[str, DataFrame] | None = None, power: float = 0.7, rounds: int = 10, seed: int = 42,
    budget: float | None = None, carry: bool = True,
) -> DataFrame:
    """``docs`` (its id alone without ``carry``, for one pass over the texts) with __source, __lang, __topic, __tokens, __p (probability) and __kept of every row.

    Weights of the (source, language, topic) cells are raked to the targets.  The largest weight becomes probability 1,
    so expected token shares meet the targets; ``budget`` (tokens) lowers all probabilities together where they would
    give more.  A row is kept when its draw, a hash of seed, id and text, is below its cell's probability.

    Null sources and languages are values of their own.  Texts without words have a cell's probability and no tokens.
    Repeated rows share a draw.  Where no cell has tokens every row is kept.  An empty table gives an empty result.
    The cell table is broadcast within 8 MB; beyond that rows and cells meet salted, so a hot cell is split.
    """
    t = F.col(text)
    rows = docs.withColumns({
        "__source": F.coalesce(F.col(source).cast("string"), F.lit(NONE)),
        "__lang": F.coalesce(F.col(lang).cast("string"), F.lit(NONE)),
        "__topic": topic_of(t), "__tokens": token_weight(t), "__u": unit_draw(seed, F.col(id_col), t),
    })
    if not carry:
        rows = durable(rows.select(id_col, "__source", "__lang", "__topic", "__tokens", "__u"))
    dims = ["__source", "__lang", "__topic"]
    cells = durable(rows.groupBy(*dims).agg(F.sum("__tokens").alias("tokens")))
    fitted = durable(rake(cells, dims, targets, power, rounds))
    top = fitted.agg(
        F.max(F.when(F.col("tokens") > 0, F.col("weight"))).alias("top"),
        F.sum(F.col("tokens") * F.col("weight")).alias("sum"),
    )
    limit = F.lit(1.0) if budget is None else F.least(F.lit(1.0), F.lit(float(budget)) * F.col("top") / F.col("sum"))
    scale = top.select(F.coalesce(limit / F.nullif(F.col("top"), F.lit(0.0)), F.lit(1.0)).alias("k"))
    chances = durable(
        fitted.withColumn("__p", F.least(F.lit(1.0), F.col("weight") * scale.scalar())).select(*dims, "__p")
    )
    known = checked_broadcast(chances, 8 << 20, 256)
    if known is chances:
        salts = 64
        known = chances.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("__salt", F.floor(F.col("__u") * salts).cast("int"))
        joined = rows.join(known, [*dims, "__salt"]).drop("__salt")
    else:
        joined = rows.join(known, dims)
    return joined.withColumn("__kept", F.col("__u") < F.col("__p")).drop("__u")
