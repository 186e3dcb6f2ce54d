"""Benchmark decontamination by spaced seeds, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checked_broadcast
from tidemark.session import durable

SPLIT = r"[^\p{L}\p{N}]+"
# 1 counts, 0 is ignored: any one word under a zero, or several of them, may differ.
MASKS: Sequence[str] = ("1101100101", "1011010011")
QUOTED = 3  # words of the shortest item that counts as found inside a longer text


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits of a whole text; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row; inside lambdas a plain expression would be for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def _seeds(words: Column, masks: Sequence[str]) -> Column:
    """One array of struct(seed, pos) per text: for each mask and place, a hash of the counted words.

    Words are hashed once; a seed is a hash of those longs.  Texts shorter than a mask have none.
    """
    def seed_at(n: int, mask: str):
        counted = [i for i, c in enumerate(mask) if c == "1"]
        return lambda p: F.struct(
            F.xxhash64(F.lit(n), *[F.get(words, p + i) for i in counted]).alias("seed"), p.cast("int").alias("pos")
        )

    found = []
    for n, mask in enumerate(masks):
        span = len(mask)
        places = F.when(F.size(words) >= span, F.sequence(F.lit(0), F.size(words) - span)).otherwise(
            F.array().cast("array<int>")
        )
        found.append(F.transform(places, seed_at(n, mask)))
    return F.concat(*found)


def contamination(
    docs: DataFrame, tests: DataFrame, text: str = "text", id_col: str = "doc_id", test_text: str = "text",
    test_id: str = "item_id", masks: Sequence[str] = MASKS, least: float = 0.5, run: int = 5, verbatim: int = 13,
) -> DataFrame:
    """(doc_id, text_hash, item_id, matched, item_words): the best item of every document that contains one.

    Seeds of test items and documents are joined; a hit fixes a diagonal, on which the texts are then compared word by
    word.  A place of the item is covered when it equals the document's word on such a diagonal and at least half of
    the ``run`` * 2 + 1 places around it do as well, so scattered common words do not count.  Places covered on several
    diagonals (words put in or left out) count once.  A document is contaminated when the covered places reach
    ``least`` of an item's words, or when it holds ``verbatim`` words of an item in a row.

    Items shorter than the masks have one seed of all their words, and documents a seed for every window of each length
    that such items have.  Items of one or two words are found only as whole texts of documents.

    Ties go to the larger coverage, then the smaller item id.  Equal items are compared once, under their smallest id;
    null items and null texts match nothing.  Repeated documents and null ids are found by id and text hash.  Empty tables give an empty result.
    Item seeds (a benchmark is bounded) are broadcast within 16 MB, else shuffled; only the documents that were hit are
    compared, and their hits are broadcast within 16 MB, else the documents are shuffled by id.
    """
    items = durable(
        tests.select(F.col(test_id).cast("long").alias("item_id"), words_of(F.col(test_text)).alias("item_words"))
        .where(F.size("item_words") > 0).groupBy("item_words").agg(F.min("item_id").alias("item_id"))
        .withColumn("item_key", F.xxhash64("item_words"))
    )
    word_bytes = 64 + F.octet_length(F.array_join("item_words", " ")) + 8 * F.size("item_words")
    shortest = min(map(len, masks))
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    # an item too short for a mask is one seed of all its words; documents show one for every window of such a length
    whole = lambda c: F.array(F.struct(F.xxhash64(F.lit(-1), c).alias("seed"), F.lit(0).alias("pos")))
    spots = lambda c: F.when(F.size(c) < shortest, whole(c)).otherwise(_seeds(c, masks))
    short = [r[0] for r in items.select(F.size("item_words")).where(F.size("item_words") < shortest).distinct().collect()]

    def window(c: Column, n: int):
        return lambda p: F.struct(F.xxhash64(F.lit(-1), F.slice(c, p + 1, n)).alias("seed"), p.alias("pos"))

    def doc_spots(c: Column) -> Column:
        none = F.array().cast("array<struct<seed:bigint,pos:int>>")
        found = [F.when(F.size(c) >= shortest, _seeds(c, masks)).otherwise(none)]
        for n in short:
            fits = F.size(c) == n if n < QUOTED else F.size(c) >= n
            found.append(F.when(fits, F.transform(F.sequence(F.lit(0), F.size(c) - n), window(c, n))).otherwise(none))
        return F.concat(*found)

    item_seeds = durable(
        items.withColumn("h", hashed(F.col("item_words")))
        .select("item_key", F.explode(_let(F.col("h"), spots)).alias("s"))
        .select("item_key", F.col("s.seed").alias("seed"), F.col("s.pos").alias("item_pos"))
    )
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = known.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.explode(_let(hashed(words_of(F.col("text"))), doc_spots)).alias("s")
    ).select("doc_id", "text_hash", F.col("s.seed").alias("seed"), F.col("s.pos").alias("pos"))
    hits = placed.join(checked_broadcast(item_seeds, 16 << 20, 40), "seed").select(
        "doc_id", "text_hash", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift")
    )
    pairs = durable(
        hits.groupBy("doc_id", "text_hash", "item_key").agg(F.sort_array(F.collect_set("shift")).alias("shifts"))
    )
    found = durable(pairs.join(checked_broadcast(items, 16 << 20, word_bytes), "item_key"))
    right = checked_broadcast(found.withColumnRenamed("doc_id", "__id"), 16 << 20, word_bytes + 8 * F.size("shifts"))
    compared = known.withColumn("__hash", F.xxhash64("text")).join(
        right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("text_hash"))
    )
    item = F.col("item_words")

    def around(equal: Column, i: Column) -> Column:
        # the 2 * run + 1 places from ``run`` before a place on (from the item's start for its first places)
        return F.aggregate(
            F.slice(equal, F.greatest(i - run + 1, F.lit(1)), 2 * run + 1), F.lit(0), lambda a, x: a + x
        )

    def longest(equal: Column) -> Column:
        last = F.aggregate(
            equal, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
            lambda a, x: F.struct(
                F.when(x == 1, a["now"] + 1).otherwise(0).alias("now"),
                F.when(x == 1, F.greatest(a["most"], a["now"] + 1)).otherwise(a["most"]).alias("most"),
            ),
        )
        return last["most"]

    def covered(doc: Column, shift: Column) -> Column:
        equal = F.transform(item, lambda w, i: F.get(doc, i + shift).eqNullSafe(w).cast("int"))
        return _let(equal, lambda e: F.struct(
            F.filter(
                F.sequence(F.lit(0), F.size(e) - 1),
                lambda i: (F.get(e, i) == 1) & (2 * around(e, i) >= F.least(F.lit(2 * run + 1), F.size(e))),
            ).alias("places"),
            longest(e).alias("longest"),
        ))

    diagonals = _let(words_of(F.col("text")), lambda doc: F.transform("shifts", lambda shift: covered(doc, shift)))
    scored = compared.select("doc_id", "text_hash", "item_id", F.size(item).alias("n"), diagonals.alias("d")).select(
        "doc_id", "text_hash", "item_id", F.size(F.array_distinct(F.flatten("d.places"))).alias("matched"),
        F.col("n").alias("item_words"), F.array_max("d.longest").alias("longest"),
    )
    enough = (F.col("matched") >= F.col("item_words") * least) | (F.col("longest") >= verbatim)
    best = scored.where(enough).groupBy("doc_id", "text_hash").agg(
        F.max(F.struct(
            (F.col("matched") / F.col("item_words")).alias("share"), (-F.col("item_id")).alias("minus"),
            "matched", "item_words",
        )).alias("b")
    )
    return best.select(
        "doc_id", "text_hash", (-F.col("b.minus")).alias("item_id"), F.col("b.matched").alias("matched"),
        F.col("b.item_words").alias("item_words"),
    )


def decontaminate(docs: DataFrame, tests: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that contain a test item; columns and order of columns stay."""
    bad = durable(contamination(docs, tests, text, id_col, **options).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")
    ).distinct())
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__hash")
    )
    return docs.join(checked_broadcast(bad, 16 << 20, 40), same, "left_anti")
