"""Periodic runs of words, found through string synchronising sets at dyadic scales."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, prepare

LEAST = 24  # words of the shortest run
TIMES = 3  # periods of the shortest run
BASE = 4  # smallest scale; periods below 1.5 * BASE are read off directly
STEP = 400_000  # words looked at together (a longer text is taken alone)
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)  # never NEVER


def _direct(tokens: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of at least TIMES * period words that repeat after ``period`` words."""
    same = np.zeros(max(0, len(tokens) - period) + 2, np.int8)
    same[1:-1] = tokens[:-period] == tokens[period:] if len(tokens) > period else 0
    turn = np.diff(same)
    start, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = stop - start >= (TIMES - 1) * period
    return start[long], stop[long] + period


def _around(tokens: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The maximal stretch with this period around a place, by comparing words."""
    right, step = at, 64
    while right + period < len(tokens):
        m = min(step, len(tokens) - period - right)
        differ = tokens[right : right + m] != tokens[right + period : right + period + m]
        first = int(differ.argmax())
        if differ[first]:
            right += first
            break
        right, step = right + m, step * 2
    left, step = at, 64
    while left > 0:
        m = min(step, left)
        differ = (tokens[left - m : left] != tokens[left + period - m : left + period])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            left -= first
            break
        left, step = left - m, step * 2
    return left, right + period


def synchronising_set(hashes: np.ndarray, scale: int, rest: np.ndarray, periodic: np.ndarray) -> np.ndarray:
    """Places i whose least window hash over [i, i + scale] stands at one of the two ends.

    ``hashes`` are those of windows of ``scale`` words, ``rest`` the words from each place to the end of its text and
    ``periodic`` marks windows of a period of at most scale / 3, which take no part.  Whether a place belongs depends
    on the 2 * scale words after it alone, and every 3 * scale - 1 words without so small a period hold one.
    """
    held = np.where(periodic, NEVER, hashes)
    least, width = held.copy(), 1
    while width < scale:
        least[:-width] = np.minimum(least[:-width], least[width:])
        width *= 2
    ahead = np.full(len(held), NEVER)
    ahead[:-scale] = held[scale:]
    least = np.minimum(least, ahead)
    return np.flatnonzero((rest >= 2 * scale) & (least < NEVER) & ((held == least) | (ahead == least)))


def _proposals(places: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of pairs with equal contexts whose distance is a period of this scale: [1.5, 3) * scale.

    Equal contexts of the set lie more than scale / 3 apart, so a place has a bounded number of partners in reach.
    """
    order = np.argsort(contexts, kind="stable")
    c, at = contexts[order], places[order]
    found, shift = [], 0
    while shift + 1 < len(at):
        shift += 1
        gap = at[shift:] - at[:-shift]
        near = (c[shift:] == c[:-shift]) & (gap < 3 * scale)
        if not near.any():
            break
        near &= 2 * gap >= 3 * scale
        found.append((at[:-shift][near], gap[near]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text (an array of word numbers) its runs (start, length, period), by start, then period.

    A run is a maximal stretch of smallest period q and at least max(24, 3 q) words.  A run of period p holds two places
    of the synchronising set of a scale between p / 3 and p / 1.5 that stand p apart with equal contexts; each proposal is
    compared word by word and carried to both ends.  Periods below 1.5 * BASE are read off directly, and the runs of small
    periods known so far are the highly periodic regions that a larger scale leaves out.  Hashes only select and
    propose, so they cannot change the result.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    # one number of its own closes each text, so nothing repeats across texts
    tokens = np.concatenate([x for n, t in enumerate(texts) for x in (t, np.array([-1 - n]))]) if texts else np.empty(0, np.int64)
    found = {}  # (start, stop) -> smallest period

    def keep(start: int, stop: int, period: int) -> None:
        found[start, stop] = min(period, found.get((start, stop), period))

    for period in range(1, BASE + BASE // 2):
        for start, stop in zip(*(x.tolist() for x in _direct(tokens, period))):
            keep(start, stop, period)
    rest = np.concatenate([np.arange(n, -1, -1) for n in sizes.tolist()]) if texts else sizes
    whole = np.repeat(sizes, sizes + 1)
    place = np.arange(len(tokens))
    hashes, scale = _mix(tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 1
    while len(place):
        if scale >= BASE:
            active = 2 * whole >= 9 * scale
            if not active.all():
                place, rest, whole, hashes = place[active], rest[active], whole[active], hashes[active]
        doubled = np.zeros_like(hashes)
        if scale < len(hashes):
            doubled[:-scale] = _mix(hashes[:-scale] * np.uint64(0xD1342543DE82EF95) + hashes[scale:])
        if scale >= BASE and len(place):
            edge = np.zeros(len(place) + 1, np.int64)
            flat = np.array([(s, e) for (s, e), p in found.items() if 3 * p <= scale <= e - s], np.int64).reshape(-1, 2)
            at = np.searchsorted(place, flat[:, 0])
            there = at < len(place)
            there[there] = place[at[there]] == flat[there, 0]
            np.add.at(edge, at[there], 1)
            np.add.at(edge, at[there] + (flat[there, 1] - flat[there, 0] - scale + 1), -1)
            chosen = synchronising_set(hashes, scale, rest, np.cumsum(edge[:-1]) > 0)
            at, period = _proposals(chosen, doubled[chosen], scale)
            inside = rest[at] >= period + 2 * scale
            at, period = place[at[inside]], period[inside]
            last = reach = -1
            for i in np.lexsort((at, period)).tolist():
                p, x = int(period[i]), int(at[i])
                if p == last and x < reach:
                    continue
                start, stop = _around(tokens, x, p)
                last, reach = p, max(stop - p, x + 1)
                if stop - start >= TIMES * p:
                    keep(start, stop, p)
        hashes, scale = doubled, scale * 2
    out = [[] for _ in texts]
    for (start, stop), period in sorted(found.items()):
        if stop - start >= max(LEAST, TIMES * period):
            n = int(np.searchsorted(starts, start, side="right")) - 1
            out[n].append((start - int(starts[n]), stop - start, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def stretched(words: list, doc_id: int | None) -> list:
    """The words with a planted repetition in one of ten documents, as their id says; without an id unchanged."""
    if doc_id is None or not words:
        return words
    tenth, kind = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if kind:
        return words
    n = len(words)
    a = tenth % n
    p = 1 + (n - a) // (3 + tenth % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = words
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            edge[s + q] += 1
            edge[s + n] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    return {
        "n_runs": len(runs), "start": top[0], "length": top[1], "period": top[2],
        "exponent_milli": 1000 * top[1] // top[2] if runs else None,
        "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(),
    }


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>"
)


def periodic_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", planted: bool = False) -> DataFrame:
    """Runs of every whole text, its strongest run and digests of all runs and of the text without repetitions.

    ``planted`` first repeats words of one document in ten, as ``stretched`` says.  The strongest run has the greatest
    exact length / period; ties go to the smallest start, then period.  Null and empty texts have no words and no runs:
    nulls for the strongest run and digests of the empty string.  Null ids and repeated rows are kept as they are; other
    columns are not read; an empty table gives an empty result.  One pass, no shuffle: texts are worked on in groups of
    a bounded number of words, and a longer text alone, in memory proportional to it.
    """
    prepare(docs.sparkSession)

    def work(cols):
        ids, texts = cols["doc_id"].to_pylist(), cols["text"].to_pylist()
        rows, group, taken = [], [], 0

        def finish():
            number: dict[bytes, int] = {}
            coded = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in group]
            for words, runs in zip(group, find_runs(coded)):
                rows.append(summary(words, runs) | {"runs": [dict(zip(("start", "length", "period"), r)) for r in runs]})

        for doc_id, value in zip(ids, texts):
            words = stretched(words_of(value), doc_id) if planted else words_of(value)
            if group and taken + len(words) > STEP:
                finish()
                group, taken = [], 0
            group.append(words)
            taken += len(words)
        finish()
        return {"doc_id": cols["doc_id"]} | {k: [r[k] for r in rows] for k in rows[0]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, work, SCHEMA)
