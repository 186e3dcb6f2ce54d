"""Cross-tokenizer alignment: byte-aligned token links, counted through inverted pair bitmaps."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, shared_folder, spread
from tidemark.llm.pretokens import byte_symbols
from tidemark.session import durable

SHIFT = 15  # bits of a B id inside a pair number
SLICE = 1 << 20  # characters aligned together (a longer text is taken alone)
CHUNKS = 600_000  # chunks of text whose ids a worker remembers
SPACE = "▁"
# Letters, digits and signs whose classes do not differ between Unicode versions; other texts go to the libraries whole.
PLAIN = re.compile("[\n -~\xa1-\xac\xae-ʯ]*")
SURROGATE = re.compile("[\ud800-\udfff]")
CHUNK = re.compile(r"[ \n]+[^ \n]*")


class Aligner:
    """Both tokenizers, and the exact ids of whole texts under each.

    A text of plain characters is cut before each run of white space, where neither tokenizer joins anything: A's pre-tokens
    end there, and no piece of B's vocabulary reaches across (checked here; otherwise nothing is cut).  Each chunk is
    encoded once by both libraries.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte_of = {s: i for i, s in enumerate(byte_symbols())}
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.spelt_a = [bytes(map(byte_of.get, s)) if byte_of.keys() >= set(s) else s.encode("utf-8") for s in names]
        b, pieces = self.b, [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.spelt_b = [
            bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode("utf-8") for i, p in enumerate(pieces)
        ]
        inner = [p.lstrip(SPACE) for i, p in enumerate(pieces) if not b.is_byte(i)]
        self.cuts = not any(c in p for p in inner for c in (SPACE, "\n"))
        self.blank = b.piece_to_id(SPACE)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.spelt_a, self.spelt_b))
        self.width = len(self.spelt_a), len(self.spelt_b)
        # text of a token inside a group and at the end of its side
        ids_a, ids_b = (list(map(str, range(n))) for n in self.width)
        self.names = np.array([x + s for ids, ends in ((ids_a, ",|"), (ids_b, ",;")) for s in ends for x in ids], object)

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1) if texts else []

    def _exact(self, a: list[int], b: list[int], data: bytes) -> bool:
        spelt = b"".join(map(self.spelt_a.__getitem__, a)) == data
        return spelt and b"".join(map(self.spelt_b.__getitem__, b)) == data

    def _learn(self, cut: list[list[str]]) -> None:
        """Chunks as they stand inside a text: B puts one space before what it encodes."""
        if len(self.known) > CHUNKS:
            self.known.clear()
        new = list(set().union(*cut) - self.known.keys())
        of_b = self._encode_b([c[1:] if c[0] == " " else c for c in new])
        for c, a, b in zip(new, self._encode_a(new), of_b):
            if c == " ":
                b = [self.blank]
            elif c[0] != " ":
                b = b[1:] if b[:1] == [self.blank] else []
            fits = self._exact(a, b, c.encode("utf-8"))
            self.known[c] = (array("i", a).tobytes(), array("i", b).tobytes()) if fits else None

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of space + text under A and B; empty for empty texts and where either side spells other bytes."""
        out = [(np.empty(0, np.int32),) * 2] * len(texts)
        cut, whole = {}, []
        for n, text in enumerate(texts):
            if self.cuts and text and PLAIN.fullmatch(text):
                cut[n] = CHUNK.findall(" " + text)
            elif text and not SURROGATE.search(text):
                whole.append(n)
        self._learn(list(cut.values()))
        for n, chunks in cut.items():
            found = list(map(self.known.__getitem__, chunks))
            if None not in found:
                out[n] = tuple(np.frombuffer(b"".join(side), np.int32) for side in zip(*found))
        spaced = [" " + texts[n] for n in whole]
        for n, s, a, b in zip(whole, spaced, self._encode_a(spaced), self._encode_b([texts[n] for n in whole])):
            if self._exact(a, b, s.encode("utf-8")):
                out[n] = np.array(a, np.int32), np.array(b, np.int32)
        return out

    def align(self, texts: list[str]) -> dict:
        """Token counts, digests and links of some texts; links are (text number, A id, B id) arrays."""
        found = self.encode(texts)
        n_a, n_b = (np.array([len(f[k]) for f in found], np.int64) for k in (0, 1))
        a, b = (np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.empty(0, np.int64) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        # both sides of a text have the same bytes, so ends of the whole slice can be compared
        size = int(ends_a[-1]) + 1 if len(a) else 1
        seen_a, seen_b = np.zeros(size, bool), np.zeros(size, bool)
        seen_a[ends_a] = seen_b[ends_b] = True
        last_a, last_b = seen_b[ends_a], seen_a[ends_b]
        owner = np.repeat(np.arange(len(texts)), n_a)[last_a]
        # order of the written form: the A ids of a group, then its B ids
        stop_a, stop_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.concatenate(([0], stop_b + 1))[group_a]] = a + self.width[0] * last_a
        code[np.arange(len(b)) + (stop_a + 1)[group_b]] = b + self.width[1] * last_b + 2 * self.width[0]
        written = self.names[code].tolist()
        bounds = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
        digests = [
            hashlib.sha256("".join(written[i:j])[:-1].encode()).hexdigest() if j > i else ""
            for i, j in zip(bounds[:-1], bounds[1:])
        ]
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(owner, minlength=len(texts)), "groups_sha256": digests,
            "owner": owner, "a": a[last_a], "b": b[last_b],
        }


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def planes(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(plane, pairs, places, fresh) of link keys pair << 16 | place, sorted by pair, then place.

    Plane k holds the documents whose number of links has bit k set; ``fresh`` marks those that no lower plane holds, so
    they count the union of the planes.
    """
    found, times = np.unique(keys, return_counts=True)
    pair, place = found >> 16, found & 0xFFFF
    plane = 0
    while len(times) and (times >> plane).any():
        here = (times >> plane) & 1 == 1
        yield plane, pair[here], place[here], (times[here] & ((1 << plane) - 1)) == 0
        plane += 1


def bitmaps(pair: np.ndarray, place: np.ndarray, fresh: np.ndarray, width: int) -> Iterator[dict]:
    """Compressed bitmaps of each pair: lists of 16-bit places, or bits where those are shorter (two tables)."""
    starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(pair)))
    documents = np.add.reduceat(fresh.astype(np.int64), starts) if len(pair) else sizes
    row_bytes = -(-width // 8)
    dense = 2 * sizes > row_bytes
    for kind in (False, True):
        rows = np.flatnonzero(dense == kind)
        if not len(rows):
            continue
        member = np.repeat(dense == kind, sizes)
        if kind:
            data = np.zeros(len(rows) * row_bytes, np.uint8)
            row = np.repeat(np.arange(len(rows)), sizes[rows])
            at = place[member]
            np.add.at(data, row * row_bytes + (at >> 3), (1 << (at & 7)).astype(np.uint8))
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * row_bytes
        else:
            data = place[member].astype("<u2")
            offsets = (2 * np.concatenate(([0], np.cumsum(sizes[rows])))).astype(np.int32)
        bits = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        yield {"pair": pair[starts[rows]], "dense": np.full(len(rows), kind), "bits": bits,
               "popcount": sizes[rows], "documents": documents[rows]}


def places_of(dense: np.ndarray, bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every set bit of some bitmaps."""
    offsets = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
    data = np.frombuffer(bits.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(bits)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    byte = data[offsets[0] : offsets[-1]]
    inner = dense[row]
    sparse = np.flatnonzero(~inner)
    places = byte[sparse[0::2]].astype(np.int64) | byte[sparse[1::2]].astype(np.int64) << 8
    full = np.unpackbits(byte[inner][:, None], axis=1, bitorder="little")
    i, bit = np.nonzero(full)
    return np.concatenate([row[sparse[0::2]], row[inner][i]]), np.concatenate([places, at[inner][i] * 8 + bit])


BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int32()), ("plane", pa.int32()),
    ("documents", pa.int64()), ("links", pa.int64()), ("dense", pa.bool_()), ("bits", pa.binary()),
])
BLOCKS_DDL = (
    "block long, doc_id long, place int, n_a long, n_b long, n_groups long, groups_sha256 string, pair int, plane int, "
    "documents long, links long, dense boolean, bits binary"
)


def _batch(values: dict, n: int) -> pa.RecordBatch:
    columns = [pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in BLOCKS]
    return pa.RecordBatch.from_arrays(columns, schema=BLOCKS)


def write_postings(docs: DataFrame, path_a: str, path_b: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encodes and aligns every text once; a table in the shared folder with two kinds of rows.

    Documents come in blocks (an Arrow batch); a row with a null ``pair`` is a document with its place in its block, the others
    are the block's bitmaps per pair and plane, with their popcounts.
    """
    spark = docs.sparkSession
    prepare(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = aligner(path_a, path_b)
        for number, batch in enumerate(batches):
            block = TaskContext.get().partitionId() << 32 | number
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keys, low = [], 0
            while low < len(texts):
                high, taken = low, 0
                while high < len(texts) and (high == low or taken + len(texts[high]) <= SLICE):
                    taken += len(texts[high])
                    high += 1
                got = found.align(texts[low:high])
                keys.append((got["a"] << SHIFT | got["b"]) << 16 | (got["owner"] + low))
                rows = {k: got[k] for k in ("n_a", "n_b", "n_groups", "groups_sha256")}
                rows |= {"block": [block] * (high - low), "doc_id": batch.column(0)[low:high], "place": np.arange(low, high)}
                yield _batch(rows, high - low)
                low = high
            for plane, pair, place, fresh in planes(np.concatenate(keys) if keys else np.empty(0, np.int64)):
                for part in bitmaps(pair, place, fresh, len(texts)):
                    n = len(part["pair"])
                    rows = {k: part[k] for k in ("pair", "documents", "dense", "bits")}
                    rows |= {"block": [block] * n, "plane": np.full(n, plane), "links": part["popcount"] << plane}
                    yield _batch(rows, n)

    folder = shared_folder(spark, "alignment")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows.mapInArrow(work, BLOCKS_DDL).write.parquet(folder)
    return spark.read.schema(BLOCKS_DDL).parquet(folder)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, a, b, documents, links, best): corpus-wide counts; ``best`` where no other A id has more links with the B id.

    Blocks hold different documents, so the popcounts of a pair's merged bitmap are sums over blocks: of the union of the
    planes for documents, of plane k times 2^k for links.  The sums are combined before the shuffle.
    """
    found = durable(
        postings.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    )
    b = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    named = found.select("pair", F.shiftright("pair", SHIFT).alias("a"), b.alias("b"), "documents", "links")
    most = named.groupBy("b").agg(F.max("links").alias("most"))  # at most one row per id of B's vocabulary
    return named.join(F.broadcast(most), "b").withColumn("best", F.col("links") == F.col("most")).drop("most")


def document_scores(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(block, place, n_best, count_sum): the pairs' counts brought back to the documents of their bitmaps.

    Bitmaps meet their pair's count in a join (a pair has one row per block and plane, and adaptive execution splits a hot
    one), then go back to their block, which is unpacked into sums per document in one pass.
    """
    scored = postings.where("pair IS NOT NULL").select("pair", "block", "plane", "dense", "bits").join(
        pairs.select("pair", F.col("links").alias("count"), "best"), "pair"
    ).drop("pair")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_block, best, total = None, None, None

        def close():
            at = np.flatnonzero(total)
            values = {"block": np.full(len(at), open_block), "place": at.astype(np.int32), "n_best": best[at], "count_sum": total[at]}
            return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in values.items()})

        for batch in batches:
            block = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(block) else []
            for i, j in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(i, j - i)
                if block[i] != open_block:
                    if open_block is not None:
                        yield close()
                    open_block, best, total = int(block[i]), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
                plane, count = np.asarray(part.column(1)).astype(np.int64), np.asarray(part.column(4))
                row, place = places_of(np.array(part.column(2).to_pylist(), bool), part.column(3))
                times = 1 << plane
                np.add.at(total, place, (times * count)[row])
                np.add.at(best, place, (times * np.array(part.column(5).to_pylist(), np.int64))[row])
        if open_block is not None:
            yield close()

    dealt = spread(scored.select("block", "plane", "dense", "bits", "count", "best"), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(work, "block long, place int, n_best long, count_sum long")


def token_alignment(
    docs: DataFrame, path_a: str, path_b: str, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text under two tokenizers.

    A is a byte-level vocabulary of the tokenizers library, B a sentencepiece model.  Their tokens are cut into groups
    where both end at the same byte; the last tokens of each group are linked.  Null and empty texts, and texts that
    either side spells otherwise, have no tokens: zeros and an empty digest.  Ties for a B id's highest count are all best.
    Null ids and repeated rows are kept, each row counting for itself; other columns are not read; an empty table gives
    an empty result.  A text is encoded once, in memory proportional to the longest one.
    """
    postings = write_postings(docs, path_a, path_b, text, id_col)
    scores = document_scores(postings, pair_counts(postings))
    rows = postings.where("pair IS NULL").join(scores, ["block", "place"], "left")
    return rows.select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
