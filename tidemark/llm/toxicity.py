"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidemark.llm.common import prepare
from tidemark.session import durable

# Pronouns that address a reader, in the languages of the corpus (a fixed, general list).
SECOND_PERSON = frozenset("you your yours yourself ya u tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch "
                          "euer tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"[^\W_]+(?:[@$!*'’][^\W_]+)*")
MIXED = re.compile(r"[^\W\d_][\d@$*!]+[^\W\d_]")
STRETCH = re.compile(r"([^\W\d_])\1{2,}")
SPACED = re.compile(r"(?:\b[^\W\d_][ .\-_*]){3,}[^\W\d_]\b")
NEAR = 5  # words on either side that count as near
STEMS = (4, 5, 6)
FEATURES = (
    "hits", "hit_density", "weight_sum", "weight_density", "weight_max", "stem_hits", "stem_density", "stem_weight_max",
    "second_person_density", "second_person_near", "capital_rate", "capital_words", "exclamation_rate", "question_rate",
    "punctuation_rate", "obfuscation_rate", "obfuscated_hits", "stretch_rate", "spaced_rate", "log_words",
)


@dataclass
class Lexicon:
    """Log-odds of words and of word beginnings, learned from labelled rows."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def _plain(word: str) -> str:
    return word.lower()


def _cleaned(word: str) -> str:
    """The word with look-alike characters read as letters and stretched letters shortened."""
    return STRETCH.sub(r"\1", re.sub(r"[*'’]", "", word.lower().translate(LEET)))


def units(text: str) -> set[str]:
    """Distinct words, and beginnings (marked with a tilde) of words longer than them."""
    words = {_plain(w) for w in WORD.findall(text)}
    return words | {f"~{w[:n]}" for w in words for n in STEMS if len(w) > n}


def featurise(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of a whole text; all zero for null and empty texts."""
    text = text or ""
    found = WORD.findall(text)
    n = len(found)
    if not text:
        return [0.0] * len(FEATURES)
    lowered = [_plain(w) for w in found]
    hits, weights, near, stem_hits, stem_top, masked = 0, [], 0, 0, 0.0, 0
    persons = [i for i, w in enumerate(lowered) if w in SECOND_PERSON]
    person = np.array(persons) if persons else None
    get, stem = lexicon.words.get, lexicon.stems.get
    for i, w in enumerate(lowered):
        weight = get(w)
        if weight is None and not w.isalpha():
            weight = get(_cleaned(w))
            masked += weight is not None
        if weight is not None:
            hits += 1
            weights.append(weight)
            if person is not None and np.abs(person - i).min() <= NEAR:
                near += 1
        best = max((stem(w[:k], 0.0) for k in STEMS if len(w) > k), default=0.0)
        if best > 0:
            stem_hits += 1
            stem_top = max(stem_top, best)
    size, words = len(text), max(1, n)
    upper = sum(map(str.isupper, text))
    marks = sum(not (c.isalnum() or c.isspace()) for c in text)
    return [
        float(hits), hits / words, sum(weights), sum(weights) / words, max(weights, default=0.0),
        float(stem_hits), stem_hits / words, stem_top, len(persons) / words, float(near), upper / size,
        sum(len(w) > 2 and w.isupper() for w in found) / words, text.count("!") / size, text.count("?") / size,
        marks / size, len(MIXED.findall(text)) / words, float(masked), len(STRETCH.findall(text)) / words,
        len(SPACED.findall(text)) / words, math.log1p(n),
    ]


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def learn_lexicon(rows: DataFrame, least: int = 3, size: int = 4000, odds: float = 2.0) -> Lexicon:
    """The ``size`` words and beginnings with the largest smoothed log-odds (above ``odds``) in ``least`` toxic texts or more."""

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            one, all_ = Counter(), Counter()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = units(t or "")
                all_.update(own)
                if y:
                    one.update(own)
            names = list(all_)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([one[x] for x in names], pa.int64()),
                 pa.array([all_[x] for x in names], pa.int64())],
                names=["unit", "one", "both"],
            )

    total = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    counts = rows.select("text", "label").mapInArrow(count, "unit string, one long, both long").groupBy("unit").agg(
        F.sum("one").alias("one"), F.sum("both").alias("both")
    )
    odd = F.log((F.col("one") + 0.5) / (total["p"] + 1.0)) - F.log((F.col("both") - F.col("one") + 0.5) / (total["n"] + 1.0))
    best = counts.where(F.col("one") >= least).withColumn("odds", odd).where(F.col("odds") > odds)
    out = Lexicon()
    for stem in (False, True):
        own = best.where(F.col("unit").startswith("~") == stem).orderBy(F.desc("odds"), "unit").limit(size)
        for r in own.collect():
            (out.stems if stem else out.words)[r["unit"].lstrip("~")] = r["odds"]
    return out


def features(docs: DataFrame, lexicon: Lexicon, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and a column ``features`` (array of doubles) for whole texts."""
    schema = docs.select(*keep).schema.add("features", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values = [featurise(t, lexicon) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(values, pa.list_(pa.float64()))], names=[*keep, "features"]
            )

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic",
    folds: int = 5, fold: int = 0, per_class: int = 10_000, trees: int = 20, depth: int = 3,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Labels of documents whose crc32 of the id as text leaves ``fold`` modulo ``folds`` are never read.  Of the other
    labelled rows at most ``per_class`` of each label are learned from, those with the smallest hashes, weighted back
    to the classes' true sizes.  A hash of the id deals them to the lexicon (half), the trees (three tenths) and
    the calibration (two tenths), so no part is fitted on rows another part has learned.  Labels, language, source and
    id are no inputs of a score.

    Null and empty texts have all features zero and are scored like any other.  Null labels teach nothing; a document with
    different labels counts as toxic; null ids are never held out and have no label.  With one class only, or
    none, every score is that class's share of toxic rows (0 for none).  Repeated rows are kept.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out_of_fold = held_out("doc_id", folds, fold)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~out_of_fold
    ).groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    draw = F.xxhash64(F.col("doc_id"), F.lit(3))
    drawn = [marks.where(F.col("label") == y).orderBy(draw, "doc_id").limit(per_class) for y in (0, 1)]
    chosen = durable(drawn[0].unionByName(drawn[1]))
    known = durable(base.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]))  # 2 * per_class ids at most
    taken = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rows = base.withColumn("held_out", out_of_fold)
    if len(taken) < 2:
        share = float(taken.get(1, 0) > 0)
        return rows.select("doc_id", "held_out", F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    weight = F.when(F.col("label") == 1, F.lit(sizes[1] / taken[1])).otherwise(F.lit(sizes[0] / taken[0]))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(10))
    known = known.withColumn("part", part)
    by_part = {(r["p"], r["label"]): r["count"] for r in known.groupBy(
        F.when(part < 5, 0).when(part < 8, 1).otherwise(2).alias("p"), "label").count().collect()}
    split = all(by_part.get((p, y), 0) >= 2 for p in range(3) for y in (0, 1))
    own = lambda low, high: known.where(F.col("part").between(low, high)) if split else known
    lexicon = learn_lexicon(own(0, 4))
    table = durable(features(known, lexicon, "text", ["doc_id", "label", "part"]).coalesce(4))
    points = table.select(
        array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"),
        weight.alias("weight"), "part",
    )
    fitted = points.where(F.col("part").between(5, 7)) if split else points
    model = GBTClassifier(
        maxIter=trees, maxDepth=depth, stepSize=0.2, weightCol="weight", seed=42, maxBins=64, subsamplingRate=1.0,
        minInstancesPerNode=3 if split else 1,
    ).fit(fitted)
    left = points.where(F.col("part") >= 8) if split else points
    margin = lambda df: model.transform(df).withColumn("margin", vector_to_array("probability")[1])
    steps = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="score").fit(
        margin(left).select("margin", "label", "weight")
    )
    scored = margin(
        features(rows, lexicon, "text", ["doc_id", "held_out"]).withColumn("features", array_to_vector("features"))
    )
    calibrated = steps.transform(scored.select("doc_id", "held_out", "margin"))
    # equal steps keep the order of the trees: the margin decides within a step, by at most a thousandth
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") * 0.999 + F.col("margin") * 0.001))
    return calibrated.select("doc_id", "held_out", score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
