"""Cross-tokenizer alignment against the two libraries and plain counters."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from tidemark.llm import alignment, queries
from tidemark.llm.pretokens import byte_symbols

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
PARTS = [
    "a", "the", " ", "  ", "\n", "\n\n", "\t", "\r", ");\r", "é", "ü", "ing", "1", "23", "'s", "<|endoftext|>", "<s>", ".", "▁", "日本", "́", "\x00",
    "\xa0", "’", "ﬁ", " \n", "</s>", "<0x0A>", "ß", "Ĳ", " ",
]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain(libraries, rows):
    """The contract, read off the libraries' ids with dictionaries."""
    a, b = libraries
    byte_of = {s: i for i, s in enumerate(byte_symbols())}
    spelt_a = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))
    spelt_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    made = []
    for _, text in rows:
        text = text or ""
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spelt = [list(map(f, x)) for f, x in zip((spelt_a, spelt_b), ids)]
        if any(b"".join(x) != (" " + text).encode() for x in spelt):
            ids, spelt = ([], []), [[], []]
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
        common = sorted(set(ends[0]) & set(ends[1]))
        low, groups, links = 0, [], []
        for end in common:
            sides = [[i for i, e in zip(x, es) if low < e <= end] for x, es in zip(ids, ends)]
            groups.append("|".join(",".join(map(str, s)) for s in sides))
            links.append((sides[0][-1], sides[1][-1]))
            low = end
        made.append((ids, groups, links))
    count = Counter(x for m in made for x in m[2])
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [
        (i, len(ids[0]), len(ids[1]), len(groups), len(links), sum(count[x] == most[x[1]] for x in links),
         sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for (i, _), (ids, groups, links) in zip(rows, made)
    ], count, made


def result(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_ids_equal_the_libraries(libraries):
    rng = random.Random(2)
    usual = [p for p in PARTS if alignment.PLAIN.fullmatch(p)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for parts in (PARTS, usual) for _ in range(1500)]
    found = alignment.aligner(A, B)
    assert found.cuts
    for text, (a, b) in zip(texts, found.encode(texts)):
        ids = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
        exact = text and found._exact(*ids, (" " + text).encode())
        assert (a.tolist(), b.tolist()) == (ids if exact else ([], [])), repr(text)


def test_bitmaps_round_trip():
    rng = np.random.default_rng(4)
    pair = np.sort(rng.integers(0, 40, 30_000) ** 3)
    place = rng.integers(0, 300, 30_000)
    keys = pair << 16 | place
    want = Counter(zip(pair.tolist(), place.tolist()))
    got, documents, kinds = Counter(), Counter(), set()
    for plane, p, at, fresh in alignment.planes(keys):
        for part in alignment.bitmaps(p, at, fresh, 300):
            row, places = alignment.places_of(part["dense"], part["bits"])
            for r, x in zip(row.tolist(), places.tolist()):
                got[int(part["pair"][r]), x] += 1 << plane
            for q, n in zip(part["pair"].tolist(), part["documents"].tolist()):
                documents[q] += n
            kinds |= set(part["dense"].tolist())
            cut = part["bits"].slice(1, 2)
            if len(cut) == 2:
                assert set(alignment.places_of(part["dense"][1:3], cut)[0].tolist()) == {0, 1}
    assert got == want and kinds == {True, False}
    assert documents == Counter(q for q, _ in want)
    empty = alignment.places_of(np.empty(0, bool), pa.array([], pa.binary()))
    assert len(empty[0]) == len(empty[1]) == 0


def test_against_counters(spark, libraries):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(PARTS[:16]) for _ in range(rng.randrange(12)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "▁"), (203, "the ing " * 3000), (204, "a"), (204, "a"), (None, "a the"), (205, "日本 ́é")]
    df = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], "doc_id long, text string, block int, place int, pair string, links int")
    want, count, made = plain(libraries, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert result(alignment.token_alignment(df.repartition(3), A, B)) == sorted(want, key=repr)
    pairs = alignment.pair_counts(alignment.write_postings(df, A, B)).collect()
    assert {(r.a, r.b): r.links for r in pairs} == count
    documents = Counter(x for _, _, links in made for x in set(links))
    assert {(r.a, r.b): r.documents for r in pairs} == documents


def test_empty_and_whole_table(spark, sf, libraries):
    none = spark.createDataFrame([], "doc_id long, text string, links int")
    assert alignment.token_alignment(none, A, B).collect() == []
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want, _, _ = plain(libraries, [tuple(r) for r in docs.collect()])
    assert result(queries.op12_token_alignment(spark, sf)) == sorted(want, key=repr)


def test_extra_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "the ing", 4)], "doc_id long, text string, n_best int").withColumn("count", F.lit("x"))
    assert alignment.token_alignment(df, A, B).first().n_groups == 2
