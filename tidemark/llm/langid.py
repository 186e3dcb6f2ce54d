"""Language identification by mixture inference over character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare

BUCKETS = 1 << 16  # hashed n-gram space: bounds the model to languages x 65,536 numbers
ORDERS = (1, 2, 3)
CACHE = 200_000  # words of one worker whose likelihoods are kept
SLICE = 250  # documents whose words are held together
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Log probabilities of hashed n-grams; one row of ``weights`` per language in ``langs``."""

    langs: list[str]
    weights: np.ndarray  # float32 [languages, BUCKETS]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased words, letters only, a blank on either side; and the word of each."""
    joined = (" " + " ".join(words) + " ").lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    known = np.unique(points)
    letter = np.fromiter((chr(int(p)).isalpha() for p in known), bool, len(known))
    blank = points == 32
    word = np.minimum(np.cumsum(blank) - 1, len(words) - 1)
    keep = blank | letter[np.searchsorted(known, points)]
    points, word, blank = points[keep], word[keep], blank[keep]
    hashes, owners = [], []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        rolled = rolled[:size] * np.uint64(1_000_003) + points[n - 1 :]
        mixed = (rolled ^ (rolled >> np.uint64(17)) ^ np.uint64(n * 0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
        # a gram must hold a letter, and a blank only at its ends
        inner = np.zeros(size, bool)
        for k in range(1, n - 1):
            inner |= blank[k : k + size]
        lettered = np.zeros(size, bool)
        for k in range(n):
            lettered |= ~blank[k : k + size]
        good = lettered & ~inner
        # the word of its last letter: a gram that begins with a blank belongs to the word after it
        owner = np.where(blank[n - 1 : n - 1 + size], word[:size], word[n - 1 : n - 1 + size])
        hashes.append((mixed[good] >> np.uint64(48)).astype(np.int64))
        owners.append(owner[good])
    if not hashes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.1) -> LanguageModel:
    """Counts hashed n-grams of every given document by language; rows with a null text or language teach nothing.

    Repeated rows count each time, ids and other columns are not read, very long texts are counted whole, and without any row
    nothing is learned.
    Each task adds its documents up before the shuffle, so what moves is at most tasks x languages x 65,536 counts.
    """
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]):
        found: dict[str, np.ndarray] = {}
        for part in (batch.slice(i, SLICE) for batch in batches for i in range(0, batch.num_rows, SLICE)):
            words: dict[str, Counter] = {}
            for t, g in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words.setdefault(g, Counter()).update(t.split())
            for g, own in words.items():
                grams, word = _grams(list(own)) if own else (np.empty(0, np.int64), np.empty(0, np.int64))
                times = np.fromiter(own.values(), np.int64, len(own))
                total = found.setdefault(g, np.zeros(BUCKETS, np.int64))
                if len(grams):
                    total += np.bincount(grams, times[word], BUCKETS).astype(np.int64)
        for g, total in found.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])],
                names=["lang", "bucket", "n"],
            )

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL"
    )
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toPandas()
    langs = sorted(table["lang"].unique())
    weights = np.zeros((len(langs), BUCKETS))
    for i, g in enumerate(langs):
        own = table[table["lang"] == g]
        weights[i, own["bucket"].to_numpy()] = own["n"].to_numpy()
    weights += smoothing
    weights = np.log(weights / weights.sum(axis=1, keepdims=True))
    return LanguageModel(langs, weights.astype(np.float32))


class _Words:
    """Log likelihood of each word under every language, remembered for a bounded number of words.

    Every letter is part of n-grams of each order, so a word's likelihood is the geometric mean over the orders.
    """

    def __init__(self, model: LanguageModel):
        self.model, self.place, self.rows = model, {}, np.empty((0, len(model.langs)), np.float32)

    def look_up(self, words: set[str]) -> None:
        if len(self.place) > CACHE:
            self.place, self.rows = {}, self.rows[:0]
        new = [w for w in words if w not in self.place]
        if not new:
            return
        grams, owner = _grams(new)
        own = np.zeros((len(new), len(self.model.langs)))
        for i in range(len(self.model.langs)):
            own[:, i] = np.bincount(owner, self.model.weights[i, grams], len(new)) / len(ORDERS)
        start = len(self.rows)
        self.rows = np.concatenate([self.rows, own.astype(np.float32)])
        self.place.update(zip(new, range(start, start + len(new))))


def _mixture(ll: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, steps: int):
    """Expectation-maximisation for many documents at once: proportions and the mixture's log likelihood.

    ``ll`` has one column for each language of the document's own set.
    """
    size = ll.shape[1]
    pi = np.full((len(starts), size), 1.0 / size)
    top = ll.max(axis=1)
    p = [np.exp(np.maximum(ll[:, j] - top, -80.0)) for j in range(size)]
    total = np.add.reduceat(n, starts)
    for step in range(steps + 1):
        r = [p[j] * pi[doc, j] for j in range(size)]
        s = np.maximum(sum(r), 1e-300)
        if step == steps:
            return pi, np.add.reduceat(n * (np.log(s) + top), starts)
        scale = n / s
        for j in range(size):
            pi[:, j] = np.add.reduceat(r[j] * scale, starts) / total


def infer(texts: list[str | None], words: _Words, steps: int = 12, penalty: float = 1.0):
    """Language and proportion per text.

    The languages of a document are ordered by their share after one step of the full mixture; the set grows by one language while
    the log likelihood gains more than ``penalty`` * log(words), and its largest share decides.
    """
    langs = words.model.langs
    pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    live = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if langs else []
    if not live:
        return pred, score
    bags = [Counter(texts[i].split()) for i in live]
    words.look_up(set().union(*bags))
    at = np.concatenate([np.fromiter(map(words.place.__getitem__, b), np.int64, len(b)) for b in bags])
    n = np.concatenate([np.fromiter(b.values(), np.float64, len(b)) for b in bags])
    sizes = np.array([len(b) for b in bags])
    starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes)
    ll = words.rows[at].astype(np.float64)
    count = len(langs)
    single = np.add.reduceat(ll * n[:, None], starts, axis=0)
    # first the language that is best alone; the others by their share after one step, ties to the earlier name
    first = _mixture(ll, n, doc, starts, 1)[0]
    every = np.arange(len(bags))
    best = single.argmax(axis=1)
    first[every, best] = 2.0
    order = np.argsort(-first, axis=1, kind="stable")
    share = np.zeros((len(bags), count))
    share[every, best] = 1.0
    reached = single[every, best]
    cost = penalty * np.log(np.add.reduceat(n, starts) + 1)
    open_docs = every
    for k in range(2, count + 1):
        mask = np.isin(doc, open_docs) if len(open_docs) < len(bags) else slice(None)
        own, weight = ll[mask], n[mask]
        own_sizes = sizes[open_docs]
        place = np.repeat(every[: len(open_docs)], own_sizes)
        chosen = order[open_docs, :k]
        found, reach = _mixture(
            np.take_along_axis(own, chosen[place], axis=1), weight, place, np.cumsum(own_sizes) - own_sizes, steps
        )
        better = reach - reached[open_docs] > cost[open_docs]
        if not better.any():
            break
        open_docs, found, chosen = open_docs[better], found[better], chosen[better]
        share[open_docs[:, None], chosen] = found
        reached[open_docs] = reach[better]
    winner = share.argmax(axis=1)
    for j, i in enumerate(live):
        pred[i], score[i] = langs[winner[j]], min(1.0, float(share[j, winner[j]]))
    return pred, score


def language(model: LanguageModel, text: Column | str = "text") -> Column:
    """Column of struct(lang_pred, score) for whole texts.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.  The score is the share of
    the document's words that the mixture gives to the predicted language.  Ties go to the language whose name comes first.
    Spark takes the column for nondeterministic, so that a filter on it does not evaluate it a second time.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _Words(model)
        for texts in batches:
            values = [t if isinstance(t, str) else None for t in texts]
            parts = [infer(values[i : i + SLICE], words) for i in range(0, len(values), SLICE)] or [([], [])]
            yield pd.DataFrame(
                {"lang_pred": sum((list(p) for p, _ in parts), []), "score": np.concatenate([s for _, s in parts])}
            )

    return predict.asNondeterministic()(text)
