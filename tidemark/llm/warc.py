"""Deterministic sharded WARC writer and its reader.

Records are sorted by page id over range shards, each record is a gzip member of its own, a file is closed when its
compressed size passes a limit, headers and digests are made anew from the payload, and a file gets its final name only
when it is whole.  The manifest lists the files of a finished write.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checked_broadcast, prepare, shards, shared_folder, spread, storage, write_file
from tidemark.session import durable

VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "none"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{NO_ID if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == NO_ID else int(name)


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, date: str
) -> bytes:
    """One uncompressed record; a revisit holds the HTTP header only and names the response it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _uri(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": target or None,
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": _sha1(block),
        "WARC-Refers-To": None if refers_to is None else _uri(refers_to),
        "WARC-Profile": None if refers_to is None else REVISIT,
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"{VERSION}\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time stamp or name: equal records give equal bytes."""
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def records(uri: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Uncompressed records of an archive, one at a time."""
    store, path = storage(uri)
    with store.open_input_stream(path, compression=None) as stream:
        data, parts, unzip = stream.read(chunk), [], zlib.decompressobj(31)
        while data:
            parts.append(unzip.decompress(data))
            data = unzip.unused_data
            if unzip.eof:
                yield b"".join(parts)
                parts, unzip = [], zlib.decompressobj(31)
            data = data or stream.read(chunk)
        if any(parts):
            raise ValueError(f"{uri}: the archive ends inside a record")


def parse(data: bytes) -> dict:
    """Headers, payload and the digests' check of one record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = top.decode("utf-8", "surrogatepass").split("\r\n")
    head = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(head["Content-Length"])]
    if version != VERSION or rest[len(block) :] != b"\r\n\r\n" or _sha1(block) != head["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {head.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    if head["WARC-Type"] == "response" and (len(payload) != length or _sha1(payload) != head["WARC-Payload-Digest"]):
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": _page(head["WARC-Record-ID"]),
        "url": head.get("WARC-Target-URI"),
        "payload": payload,
        "payload_bytes": length,
        "payload_digest": base64.b32decode(head["WARC-Payload-Digest"][5:]).hex(),
        "record_type": head["WARC-Type"],
        "refers_to": _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None,
    }


def write_warc(
    pages: DataFrame, html: str = "html", url: str = "url", id_col: str = "page_id", folder: str | None = None,
    file_bytes: int = 32 << 20, shard_bytes: int = 64 << 20, revisit_from: int = 1000, date: str = "2000-01-01T00:00:00Z",
) -> str:
    """Writes every page as a record and returns the folder with the archives and ``manifest``.

    Equal payloads of ``revisit_from`` bytes or more: the record with the largest id is the response, the others
    are revisits of it.  A null html is an empty payload, a null url leaves the target header out; a page without id is
    always a response, sorted first.  Rows that repeat a page id with the payload's largest id are all responses.
    Equal ids are sorted by payload digest and url.  An empty table gives a manifest without rows.

    Digests are grouped with map-side maxima, and only groups of two or more are joined back, without the html.  Archives depend on rows and parameters alone: shard bounds are quantiles of
    hash-selected ids, and a file ends at the record that passes ``file_bytes``.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or shared_folder(spark, "warc")
    store, local = storage(folder)
    store.create_dir(local, recursive=True)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("size", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    copies = (
        rows.where(F.col("size") >= revisit_from).groupBy("digest", "size")
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("digest", "size", "refers_to")
    )
    revisits = durable(
        rows.select("page_id", "digest", "size").join(copies, ["digest", "size"])
        .where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    )
    count, shard_of = shards(pages, id_col, F.octet_length(html), shard_bytes)
    kept = rows.withColumn("shard", F.udf(shard_of, "int", useArrow=True)("page_id"))
    # few revisits are broadcast, so the html moves once; beyond 16 MB both sides are shuffled by page
    marked = kept.join(checked_broadcast(revisits, 16 << 20, 96), ["page_id", "digest"], "left").select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "size",
        "refers_to", "shard",
    )
    dealt = marked.repartitionById(count, "shard").sortWithinPartitions(
        "shard", F.asc_nulls_first("page_id"), "digest", F.asc_nulls_first("url")
    )

    def write(batches: Iterator[pa.RecordBatch]):
        shard, roll, held, size = None, 0, [], 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for page_id, target, payload, digest, length, refers, s in zip(*columns):
                if s != shard:
                    if held:
                        yield close(shard, roll, held)
                    shard, roll, held, size = s, 0, [], 0
                named = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
                held.append(member(record(page_id, target, payload or b"", named, length, refers, date)))
                size += len(held[-1])
                if size >= file_bytes:
                    yield close(shard, roll, held)
                    roll, held, size = roll + 1, [], 0
        if held:
            yield close(shard, roll, held)

    def close(shard, roll, held):
        name = f"part-{shard:05d}-{roll:04d}.warc.gz"
        write_file(f"{folder}/{name}", held)
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([sum(map(len, held))], pa.int64())],
            names=["file", "n_records", "n_bytes"],
        )

    dealt.mapInArrow(write, "file string, n_records long, n_bytes long").write.parquet(f"{folder}/manifest")
    return folder


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the archives in the manifest, one row each, every digest checked; a damaged archive is an error.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and with ``payloads`` the html of
    responses.  A task reads record by record, so memory does not grow with the archives.
    """
    prepare(spark)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
        + ", payload binary" * payloads
    )
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def batch_of(rows):
        arrays = [pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def load(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for data in records(f"{folder}/{name}"):
                    rows.append(parse(data))
                    size += len(rows[-1]["payload"]) if payloads else 100
                    if size > 1 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    listed = spark.read.parquet(f"{folder}/manifest").select("file")
    return spread(listed, "file").mapInArrow(load, schema)
