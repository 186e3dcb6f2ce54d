"""Exact token counts of byte-pair vocabularies by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, prepare
from tidemark.llm.pretokens import byte_symbols, pretokens

PIECES = 600_000  # pre-tokens one worker remembers


class WordMerges:
    """Counts tokens of a word-level byte-pair vocabulary with word ends, as the tokenizers library would.

    Whole texts are cut into pre-tokens, and those not seen before are merged together as one ragged array.
    """

    def __init__(self, path: str):
        self.pre = pretokens(path)
        model = self.pre.spec["model"]
        specials = "|".join(regex.escape(s) for s in self.pre.specials)
        self.special = regex.compile(specials) if specials else None
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = len(vocab)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.none = len(keys)
        self.pieces: dict[str, int] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty word.

        In every round each word takes its lowest rank and joins all places of that pair at once, from the left where
        places overlap.  A new symbol's pairs rank after the pair that made it, so this equals one merge at a time.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes)
        ids[ends - 1] = self.last[np.frombuffer(bytes(w[-1] for w in words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        left = sizes.copy()
        while len(ids) > 1:
            same = word[1:] == word[:-1]
            rank = np.full(len(ids), self.none)
            rank[:-1][same] = self._rank(ids[:-1][same], ids[1:][same])
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            lowest = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.append(starts, len(ids)))
            least = np.repeat(lowest, spans)
            hit = (rank == least) & (rank < self.none)
            if not hit.any():
                break
            # places that overlap (aaa): every second one of a run, counted from its left end
            at = np.flatnonzero(hit)
            run = np.concatenate(([True], at[1:] != at[:-1] + 1))
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids[at] = self.made[rank[at]]
            gone = np.zeros(len(ids), bool)
            gone[at + 1] = True
            np.subtract.at(left, word[at], 1)
            keep = ~gone & (least < self.none)  # words with nothing left to join leave the arrays
            ids, word = ids[keep], word[keep]
        return left

    def _cut(self, text: str) -> tuple[int, list[str]]:
        """Special strings in a text, and the pre-tokens of what stands between them."""
        found = self.pre.cut(text)
        if found is not None:
            return 0, found
        parts = self.special.split(text) if self.special else [text]
        normal = [self.pre.library.normalizer.normalize_str(p) for p in parts if p]
        return len(parts) - 1, [t for p in normal for t in self.pre.pattern.findall(p)]

    def count(self, texts: list[str]) -> list[int]:
        cut = [self._cut(t) for t in texts]
        words = set().union(*(w for _, w in cut))
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        new = list(words - self.pieces.keys())
        if new:
            self.pieces.update(zip(new, self.merge([p.encode("utf-8") for p in new]).tolist()))
        get = self.pieces.__getitem__
        return [n + sum(map(get, w)) for n, w in cut]


@lru_cache(maxsize=2)
def counter(path: str) -> WordMerges:
    return WordMerges(path)


def count_tokens(
    docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", limit: int = 2048
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, without added special tokens.

    Null texts count as empty: no bytes and no tokens.  Special strings inside a text count one token each, the
    library's default.  Null ids and repeated rows are kept as they are; other columns are not read.  One pass, no
    shuffle; a worker remembers a bounded number of pre-tokens, so very long texts and vocabularies only cost time.
    """
    prepare(docs.sparkSession)

    def work(cols):
        texts = [t or "" for t in cols["text"].to_pylist()]
        tokens = []
        for i in range(0, len(texts), 250):
            tokens += counter(path).count(texts[i : i + 250])
        return {
            "doc_id": cols["doc_id"],
            "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
            "n_tokens": tokens,
            "over_limit": [n > limit for n in tokens],
        }

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
