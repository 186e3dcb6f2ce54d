"""Document fingerprints: a quartile digest of hashed byte triplets and a bounded difference score."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import prepare
from tidemark.session import durable, task_count

BUCKETS = 256
# Second and third byte of a triplet, counted from its first: all triplets of a five-byte window that hold its first byte.
SHAPES = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
STEP = 1 << 20  # bytes counted together
GROWTH = 1.1  # texts whose lengths differ by this factor differ by one in the length byte
HEAD = 2  # bytes before the bucket codes: length, quartile ratios
LENGTH_MOST, RATIO_MOST = 24, 14  # bounds of the two parts of the difference that the head gives
LIMIT = 240  # difference from which texts count as unlike

_SALTS = np.random.default_rng(13).integers(1, 1 << 32, (len(SHAPES), 3, 256), dtype=np.uint32)


def counts(texts: list[bytes]) -> np.ndarray:
    """Triplets of each text per bucket; every whole text, in slices of a bounded size."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    out = np.zeros((len(texts), BUCKETS), np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(4), np.uint8)
    owner, ends = np.repeat(np.arange(len(texts), dtype=np.int32), sizes), np.cumsum(sizes)
    for low in range(0, total, STEP):
        high = min(low + STEP, total)
        own = owner[low:high]
        left = ends[own] - np.arange(low, high)  # bytes from here to the end of the text
        base = (own - own[0]).astype(np.int32) * BUCKETS
        n = int(own[-1] - own[0]) + 1
        here = np.zeros(n * BUCKETS, np.int64)
        for (second, third), salt in zip(SHAPES, _SALTS):
            h = salt[0][data[low:high]] + salt[1][data[low + second : high + second]] + salt[2][data[low + third : high + third]]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            here += np.bincount((base + (h >> np.uint32(24)).astype(np.int32))[left > third], minlength=len(here))
        out[own[0] : own[-1] + 1] += here.reshape(n, BUCKETS)
    return out


def digests(texts: list[bytes]) -> np.ndarray:
    """One row of bytes per text: length on a log scale, two quartile ratios, then two bits for each bucket.

    A bucket's code says between which quartiles of the text's own bucket counts its count lies, so a text and a text
    of the same mixture twice as long have the same codes.
    """
    found = counts(texts)
    ranked = np.sort(found, axis=1)
    q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1][:, None] for k in (1, 2, 3))
    codes = (found > q1).astype(np.uint8) + (found > q2) + (found > q3)
    packed = codes[:, 0::4] << 6 | codes[:, 1::4] << 4 | codes[:, 2::4] << 2 | codes[:, 3::4]
    sizes = np.array([len(t) for t in texts], np.float64)
    length = np.minimum(255, np.floor(np.log1p(sizes) / np.log(GROWTH))).astype(np.uint8)
    top = np.maximum(q3[:, 0], 1)
    ratios = (np.minimum(15, q1[:, 0] * 16 // top) << 4 | np.minimum(15, q2[:, 0] * 16 // top)).astype(np.uint8)
    return np.column_stack([length, ratios, packed.astype(np.uint8)]) if texts else np.empty((0, HEAD + BUCKETS // 4), np.uint8)


def _steps() -> np.ndarray:
    """Difference of two bytes of four codes: neighbours 1, two apart 2, lowest against highest 6."""
    code = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3
    gap = np.abs(code[:, None, :] - code[None, :, :])
    return (gap + 3 * (gap == 3)).sum(axis=2).astype(np.int32)


_DIFFERENCE = _steps()


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Difference of digests, row by row: the codes' steps, and bounded parts for length and quartile ratios."""
    body = _DIFFERENCE[a[:, HEAD:], b[:, HEAD:]].sum(axis=1)
    length = np.abs(a[:, 0].astype(np.int32) - b[:, 0])
    high = np.abs((a[:, 1] >> 4).astype(np.int32) - (b[:, 1] >> 4))
    low = np.abs((a[:, 1] & 15).astype(np.int32) - (b[:, 1] & 15))
    return body + np.minimum(length, LENGTH_MOST) + np.minimum(high + low, RATIO_MOST)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, falling with their difference to 0 at ``LIMIT`` and beyond."""
    return 1.0 - np.minimum(difference(a, b), LIMIT) / LIMIT


def shown(digest: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in digest]


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many first ones of the next text (or all it has)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def columns(texts: list[str], own: np.ndarray, after: list[str], following: np.ndarray) -> dict[str, list]:
    changed = [raw(edited(t, f)) for t, f in zip(texts, after)]
    other = digests(changed)
    return {
        "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
        "edited_fingerprint": shown(other),
        "near_edited": likeness(own, other).tolist(),
        "near_next": likeness(own, following).tolist(),
    }


FINDINGS = "edited_sha256 string, edited_fingerprint string, near_edited double, near_next double"
ROWS = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string()), ("edited_sha256", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("part", pa.int32()), ("first", pa.bool_()), ("text", pa.string()),
])
ROWS_DDL = f"doc_id long, n_chars long, fingerprint string, {FINDINGS}, part int, first boolean, text string"


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted part: each row meets the next one; the last row waits for the part behind.

    The last row and the first keep their text, all others give it up.  Of two batches one text is carried over.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held = None  # (id, text, digest) of the row that waits for its next one
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_pylist()
        texts = [t or "" for t in batch.column(1).to_pylist()]
        own = digests([raw(t) for t in texts])
        if held is not None:
            ids, texts, own = [held[0], *ids], [held[1], *texts], np.vstack([held[2], own])
        if len(texts) > 1:
            yield _rows(ids[:-1], texts[:-1], own[:-1], columns(texts[:-1], own[:-1], texts[1:], own[1:]), part, first)
            first = False
        held = ids[-1], texts[-1], own[-1:]
    if held is not None:
        none = dict.fromkeys(("edited_sha256", "edited_fingerprint", "near_edited", "near_next"), [None])
        yield _rows([held[0]], [held[1]], held[2], none, part, first, waits=True)


def _rows(ids, texts, own, found, part, first, waits=False) -> pa.RecordBatch:
    n = len(ids)
    kept = [texts[0] if first or waits else None, *[None] * (n - 1)]
    values = {
        "doc_id": ids, "n_chars": list(map(len, texts)), "fingerprint": shown(own), **found,
        "part": [part] * n, "first": [first] + [False] * (n - 1), "text": kept,
    }
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in ROWS], schema=ROWS)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of the parts beside the first row that follows each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        own, following = (
            np.array([list(bytes.fromhex(x)) for x in row[n]], np.uint8) for n in ("fingerprint", "next_fingerprint")
        )
        found = columns(row["text"], own, row["next_text"], following)
        kept = {n: batch.column(n) for n in ("doc_id", "n_chars", "fingerprint")} | {k: pa.array(v) for k, v in found.items()}
        yield pa.RecordBatch.from_pydict(kept)


def fingerprints_with_next(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next) of every whole text.

    The edited text has its last quarter of characters replaced from the start of the next document by ascending id; after
    the last comes the first, and a single document is its own next one.  Null texts count as empty.  Ties of ids are
    ordered by the texts' hash, then the text; null ids come first; repeated rows are kept; other columns are not read; an
    empty table gives an empty result.

    The texts move once, into parts by ranges of ids (a number per input row splits even equal rows), and each part is
    read in order with one row held back.  Only the last row of each part still needs its next one: those rows, one per
    part, meet the first rows of the parts behind through a join on the number of the part.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    keyed = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    parts = keyed.repartitionByRange(task_count(docs), "id", "tie", "row").sortWithinPartitions("id", "tie", "text")
    passed = durable(parts.select("id", "text").mapInArrow(_pass, ROWS_DDL))
    done = passed.where("edited_sha256 IS NOT NULL").select(*_names())
    waiting = passed.where("edited_sha256 IS NULL").select("doc_id", "n_chars", "fingerprint", "text", "part")
    heads = passed.where("first").select(
        F.col("part").alias("next_part"), F.col("fingerprint").alias("next_fingerprint"), F.col("text").alias("next_text")
    )
    # one number per part that holds rows
    order = heads.select("next_part").withColumnRenamed("next_part", "part")
    behind = order.select(
        "part", F.coalesce(F.lead("part").over(Window.orderBy("part")), _least(order)).alias("next_part")
    )
    met = waiting.join(behind, "part").join(heads, "next_part").drop("part", "next_part")
    schema = f"doc_id long, n_chars long, fingerprint string, {FINDINGS}"
    return done.unionByName(met.mapInArrow(_meet, schema).select(*_names()))


def _least(order: DataFrame) -> Column:
    return order.agg(F.min("part").alias("least")).scalar()


def _names() -> list[str]:
    return ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
