"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, prepare, spread
from tidemark.llm.components import connected
from tidemark.session import durable

GROUPS = 5  # k differing bits touch at most k groups, so with 5 groups two stay equal for k = 3
SEGMENT = 2  # bits of one segment
BLOCK = 32_768  # most fingerprints of one cell that meet in one task
UPPER = bytes(range(65, 91))
LOWERED = bytes.maketrans(UPPER, UPPER.lower())


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles of a whole text; null and texts without words give zero."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        spans = zip(begins[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())
        hashes = [xxhash.xxh64_intdigest(joined[i:j], seed) for i, j in spans]
    else:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.array(hashes[i : i + 65_536], ">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    prepare(docs.sparkSession)

    def work(cols):
        raw = np.array([fingerprint(t, words) for t in cols["text"].to_pylist()], np.uint64)
        return {"doc_id": cols["doc_id"], "fp": raw.view(np.int64)}

    return arrow_map(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), work, "doc_id long, fp long"
    )


def _segments(width: int) -> np.ndarray:
    """Bit masks of the groups: consecutive segments, dealt so that the groups differ by one segment at most."""
    cuts = np.array_split(np.arange(64 // width), GROUPS)
    return np.array([sum(((1 << width) - 1) << (int(s) * width) for s in c) for c in cuts], np.uint64)


def popcounts(fps: np.ndarray) -> np.ndarray:
    """The embedding: set bits of each two-bit segment, still packed two bits wide."""
    odd = np.uint64(0x5555555555555555)
    return (fps & odd) + ((fps >> np.uint64(1)) & odd)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of |a_i - b_i| over the segments: never above the Hamming distance of the fingerprints.

    For values 0..2 in two bits, |x - y| is 2 where the high bits and the low bits disagree as 0 against 2, else the
    parity of the difference; both come from the exclusive or of the packed values.
    """
    odd = np.uint64(0x5555555555555555)
    x = a ^ b
    low, high = x & odd, (x >> np.uint64(1)) & odd
    # 0^1=01 -> 1, 0^2=10 -> 2, 1^2=11 -> 1
    return np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(high & ~low).astype(np.int64)


def _cells(fps: np.ndarray) -> list[np.ndarray]:
    """One key per pair of groups: the embedding's coordinates in both."""
    embedded, masks = popcounts(fps), _segments(SEGMENT)
    keys = []
    for n, (i, j) in enumerate(combinations(range(GROUPS), 2)):
        # the number of the pair goes into the mix, so cells of different pairs do not meet
        mixed = (embedded & (masks[i] | masks[j])) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        mixed ^= mixed >> np.uint64(29)
        keys.append((mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
    return keys


def _spanning(fps: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among the members of one cell.

    Breadth first: each member is held once against those not yet reached, so a dense cell costs about its size
    and the edges never exceed the members.  Manhattan distance of the embeddings first, exact bits for what is left.
    """
    a, b = [], []
    embedded = popcounts(fps)
    left = np.arange(len(fps))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.flatnonzero(manhattan(embedded[left], embedded[i]) <= bits)
            near = near[np.bitwise_count(fps[left[near]] ^ fps[i]) <= bits]
            if len(near):
                found = left[near]
                a += [i] * len(found)
                b += found.tolist()
                queue += found.tolist()
                left = np.delete(left, near)
    return a, b


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], np.any(keys[1:] != keys[:-1], axis=1))))
    return starts, np.diff(np.append(starts, len(keys)))


def _link(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges inside the runs of equal keys."""
    starts, sizes = _runs(keys)
    a, b = [], []
    small = sizes <= 32
    member = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(fps)) - starts[member]
    embedded = popcounts(fps)
    for shift in range(1, int(sizes[small].max(initial=1))):
        i = np.flatnonzero(small[member] & (place + shift < sizes[member]))
        i = i[manhattan(embedded[i], embedded[i + shift]) <= bits]
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= bits]
        a.append(fps[i])
        b.append(fps[i + shift])
    for n in np.flatnonzero(~small):
        own = fps[starts[n] : starts[n] + sizes[n]]
        x, y = _spanning(own, bits)
        a.append(own[x])
        b.append(own[y])
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def links(distinct: DataFrame, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b) over distinct fingerprints: edges whose components are those of all pairs within ``bits`` bits.

    A pair within 3 bits has Manhattan distance at most 3 in the embedding, so of five coordinate groups two are
    equal: the pair shares a cell of one of the ten group pairs.  Cells of more than ``block`` members are cut into
    blocks by hash and every two blocks meet in a task of their own, so no task holds more than two blocks and no pair
    is left out.
    """
    if bits > GROUPS - 2:
        raise ValueError(f"{GROUPS} groups find at most {GROUPS - 2} differing bits")
    prepare(distinct.sparkSession)

    def cells(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            fps = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for key in _cells(fps):
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)], names=["cell", "fp"])

    placed = distinct.select("fp").mapInArrow(cells, "cell long, fp long")
    hot = durable(
        placed.groupBy("cell").count().where(F.col("count") > block)
        .select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    )
    if hot.isEmpty():
        dealt = placed.select("cell", F.lit(0).alias("left"), F.lit(0).alias("right"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        dealt = (
            placed.join(hot, "cell", "left").fillna(1, ["blocks"]).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("cell", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "fp")
        )

    def match(batches: Iterator[pa.RecordBatch]):
        kept_keys, kept_fps = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], axis=1)
            keys = np.concatenate([kept_keys, keys])
            fps = np.concatenate([kept_fps, np.asarray(batch.column(3)).astype(np.int64).view(np.uint64)])
            cut = len(keys) - int(np.argmin(np.all(keys[::-1] == keys[-1], axis=1))) if len(keys) and not np.all(keys == keys[-1]) else 0
            if cut:
                yield edges(*_link(keys[:cut], fps[:cut], bits))
            kept_keys, kept_fps = keys[cut:], fps[cut:]
        if len(kept_fps):
            yield edges(*_link(kept_keys, kept_fps, bits))

    def edges(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    dealt = spread(dealt, "cell", "left", "right").sortWithinPartitions("cell", "left", "right")
    return dealt.mapInArrow(match, "a long, b long")


def simhash_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are linked by chains of at most ``bits`` differing bits.

    ``component_id`` is the smallest doc_id reachable.  Null and wordless texts share the fingerprint zero and are
    linked like any other; equal fingerprints are one node, so copies cost one row.  Rows with a null id keep a row and
    take the smallest id of the others (null when there is none); repeated rows are kept; other columns are not read;
    an empty table gives an empty result.
    """
    marked = durable(fingerprints(docs, text, id_col))
    nodes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(nodes, bits))
    member = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = durable(member.join(smallest, "root").select("fp", "component_id"))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, text: str = "text", id_col: str = "doc_id", bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id; all columns stay as they are.

    Of repeated rows with that id one stays.  Rows without an id are compared by their whole text only: one row of
    each text stays.
    """
    return keep_components(docs, simhash_components(docs, text, id_col, bits), text, id_col)


def keep_components(docs: DataFrame, found: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``keep_first`` for any components ``found`` (doc_id, component_id)."""
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    rows = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col("__id"), "left_semi")
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text)))
    named = rows.withColumn("__n", first).where("__n = 1").drop("__n")
    nameless = docs.where(F.col(id_col).isNull()).withColumn("__h", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return named.unionByName(nameless.dropDuplicates(["__h"]).drop("__h"))
