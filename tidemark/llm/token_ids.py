"""Token-id files: one zstandard dictionary for all documents, one frame per document, an offset index.

File layout (little endian)::

    magic "TKID0001" | 32 bytes SHA-256 of the dictionary | uint8 bytes per id | frames ...
    index: per document  has_id uint8, doc_id int64, offset uint64, length uint32, n_tokens uint64   (column by column)
    footer: n_docs uint64 | index offset uint64 | crc32 of the index uint32 | magic

A short document is read with two reads: its index entry and its frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, prepare, shards, shared_folder, spread, storage, write_file
from tidemark.llm.pretokens import byte_symbols, pretokens

MAGIC = b"TKID0001"
FOOTER = struct.Struct("<QQI8s")
INDEX = (("has_id", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u8"))
PIECES = 400_000  # pre-tokens one worker remembers


class Encoder:
    """Token ids of whole texts from the tokenizers library, whose model sees every distinct pre-token once.

    Texts that ``PreTokens.cut`` does not take are given to the library whole.
    """

    def __init__(self, path: str, dtype: str):
        self.pre, self.dtype = pretokens(path), dtype
        self.model = self.pre.library.model
        self.symbols = byte_symbols()
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.symbols.__getitem__, piece.encode("utf-8")))
        return np.array([t.id for t in self.model.tokenize(shown)], self.dtype).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self.pre.cut(t) for t in texts]
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        for piece in set().union(*(c for c in cut if c)) - self.pieces.keys():
            self.pieces[piece] = self._piece(piece)
        other = [t for t, c in zip(texts, cut) if c is None]
        whole = iter(self.pre.library.encode_batch_fast(other, add_special_tokens=False) if other else ())
        get = self.pieces.__getitem__
        return [
            np.array(next(whole).ids, self.dtype).tobytes() if c is None else b"".join(map(get, c)) for c in cut
        ]


@lru_cache(maxsize=2)
def encoder(path: str, dtype: str) -> Encoder:
    return Encoder(path, dtype)


def id_type(path: str) -> str:
    spec = json.load(open(path, encoding="utf-8"))
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return "<u2" if top < 1 << 16 else "<u4"


def encode(docs: DataFrame, path: str, text: str, id_col: str, end_id: int, shard_of=lambda doc_id: 0) -> DataFrame:
    """(doc_id, ids, shard): serialised ids of every whole text, the end id last.

    One Python step does both, since a second one would double the workers that hold a cache.
    """
    prepare(docs.sparkSession)
    dtype = id_type(path)
    end = np.array([end_id], dtype).tobytes()

    def work(cols):
        texts = [t or "" for t in cols["text"].to_pylist()]
        found = []
        for i in range(0, len(texts), 250):
            found += [b + end for b in encoder(path, dtype)(texts[i : i + 250])]
        return {"doc_id": cols["doc_id"], "ids": found, "shard": [shard_of(d) for d in cols["doc_id"].to_pylist()]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, work, "doc_id long, ids binary, shard int")


def train_dictionary(
    docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", end_id: int = 1,
    samples: int = 1000, size: int = 64 << 10, prefix: int = 16 << 10,
) -> bytes:
    """Dictionary from the serialised ids of at most ``samples`` documents: those whose ids have the smallest hashes.

    The bound is the parameter ``samples``; a dictionary learns from a bounded sample by nature.  ``prefix`` bounds
    the bytes taken of one sample.  Too few samples to train on give an empty dictionary: plain frames.
    """
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct()
    few = F.broadcast(ids.orderBy(F.xxhash64("__id"), "__id").limit(samples))  # ``samples`` ids at most
    drawn = docs.select(id_col, text).join(few, F.col(id_col) == F.col("__id"), "left_semi").dropDuplicates([id_col])
    parts = [bytes(r[0])[:prefix] for r in encode(drawn, path, text, id_col, end_id).select("ids").collect()]
    parts = sorted(p for p in parts if len(p) > 8)
    if len(parts) < 16 or sum(map(len, parts)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, parts)) // 8), parts, level=6).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes):
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def pack(rows: list[tuple[int | None, bytes]], dictionary: bytes, width: int) -> Iterator[bytes]:
    """Parts of one file, for rows in their final order."""
    press = zstandard.ZstdCompressor(level=3, write_checksum=True, **_dictionary(dictionary))
    yield MAGIC + hashlib.sha256(dictionary).digest() + bytes([width])
    at, index = len(MAGIC) + 33, []
    for doc_id, ids in rows:
        frame = press.compress(ids)
        index.append((doc_id is not None, doc_id or 0, at, len(frame), len(ids) // width))
        at += len(frame)
        yield frame
    columns = list(zip(*index)) or [()] * len(INDEX)
    packed = b"".join(np.array(c, t).tobytes() for c, (_, t) in zip(columns, INDEX))
    yield packed
    yield FOOTER.pack(len(index), at, zlib.crc32(packed), MAGIC)


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, uri: str, dictionary: bytes):
        store, path = storage(uri)
        self.data = store.open_input_file(path)
        size = self.data.size()
        head = self.data.read_at(len(MAGIC) + 33, 0)
        if head[:8] != MAGIC or head[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a token file, or written with another dictionary")
        self.width = head[40]
        count, at, crc, magic = FOOTER.unpack(self.data.read_at(FOOTER.size, size - FOOTER.size))
        packed = self.data.read_at(size - FOOTER.size - at, at)
        if magic != MAGIC or zlib.crc32(packed) != crc:
            raise ValueError(f"{uri}: the index is damaged")
        self.index, place = {}, 0
        for name, kind in INDEX:
            span = np.dtype(kind).itemsize * count
            self.index[name] = np.frombuffer(packed[place : place + span], kind)
            place += span
        self.open = zstandard.ZstdDecompressor(**_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.index["doc_id"])

    def doc_id(self, i: int) -> int | None:
        return int(self.index["doc_id"][i]) if self.index["has_id"][i] else None

    def ids(self, i: int) -> np.ndarray:
        """Ids of document ``i`` of this file as unsigned 32-bit integers."""
        frame = self.data.read_at(int(self.index["length"][i]), int(self.index["offset"][i]))
        return np.frombuffer(self.open.decompress(frame), f"<u{self.width}").astype("<u4")


def write_token_files(
    docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", end_id: int = 1,
    folder: str | None = None, shard_bytes: int = 64 << 20, file_bytes: int = 64 << 20,
) -> str:
    """Writes the ids of all documents in ascending doc_id order and returns the folder.

    ``shard-NNNNN-RRRR.tkid`` hold disjoint, ascending ranges of ids; ``dictionary`` and ``manifest`` (a table: file,
    n_docs, n_tokens) complete the set.  A file appears under its name only when it is whole, and a repeated task
    writes the same bytes.  Nulls come first; equal ids follow the order of their serialised ids.
    Null and empty texts are documents of the end id alone.  An empty table gives a manifest without rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or shared_folder(spark, "token-ids")
    store, local = storage(folder)
    store.create_dir(local, recursive=True)
    dictionary = train_dictionary(docs, path, text, id_col, end_id)
    write_file(f"{folder}/dictionary", dictionary)
    width = int(id_type(path)[-1])
    count, shard_of = shards(docs, id_col, F.octet_length(text), shard_bytes)
    rows = encode(docs, path, text, id_col, end_id, shard_of)
    dealt = rows.repartitionById(count, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")

    def write(batches: Iterator[pa.RecordBatch]):
        shard, roll, held, size = None, 0, [], 0
        for batch in batches:
            for doc_id, ids, s in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    if held:
                        yield close(shard, roll, held)
                    shard, roll, held, size = s, 0, [], 0
                held.append((doc_id, ids))
                size += len(ids)
                if size >= file_bytes:
                    yield close(shard, roll, held)
                    roll, held, size = roll + 1, [], 0
        if held:
            yield close(shard, roll, held)

    def close(shard, roll, held):
        name = f"shard-{shard:05d}-{roll:04d}.tkid"
        write_file(f"{folder}/{name}", pack(held, dictionary, width))
        total = sum(len(b) for _, b in held) // width
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([total], pa.int64())],
            names=["file", "n_docs", "n_tokens"],
        )

    dealt.mapInArrow(write, "file string, n_docs long, n_tokens long").write.parquet(f"{folder}/manifest")
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files and their manifest alone.

    ``start`` counts the ids of all documents before this one; file starts come from the manifest, whose rows
    (one per file) are the only thing the driver sees.
    """
    prepare(spark)
    store, local = storage(folder)
    with store.open_input_stream(f"{local}/dictionary", compression=None) as stream:
        dictionary = stream.read()
    files, start = [], 0
    for r in sorted(spark.read.parquet(f"{folder}/manifest").collect()):
        files.append((r["file"], start))
        start += r["n_tokens"]

    def load(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns)):
                file = TokenFile(f"{folder}/{name}", dictionary)
                counts = file.index["n_tokens"].astype(np.int64)
                starts = base + np.cumsum(counts) - counts
                for i in range(0, len(file), 4096):
                    part = range(i, min(i + 4096, len(file)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file.doc_id(k) for k in part], pa.int64()),
                            pa.array(starts[part.start : part.stop]),
                            pa.array(counts[part.start : part.stop]),
                            pa.array([zlib.crc32(file.ids(k).tobytes()) for k in part], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    listed = spark.createDataFrame(files, "file string, start long")
    return spread(listed, "file").mapInArrow(load, schema)
