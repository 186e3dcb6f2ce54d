"""Periodic runs and document fingerprints against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import fingerprint, periodic_runs, queries

EXTRA = "doc_id long, text string, runs int, part string, first string, tie int, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """All stretches of every period, kept under their smallest period."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, planted=True):
    words = WORD.findall(text or "")
    n = len(words)
    if planted and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = None
    for s, m, q in runs:
        if top is None or m * top[2] > top[1] * q or (m * top[2] == top[1] * q and (s, q) < (top[0], top[2])):
            top = (s, m, q)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
        digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def repeated(rng, letters, n):
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 30:
            a, p = rng.randrange(n), rng.randrange(1, n // 3)
            for i in range(a + p, min(n, a + rng.randrange(1, n))):
                words[i] = words[i - p]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    texts = [repeated(rng, rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 5, 23, 24, 30, 100, 300])) for _ in range(600)]
    # words whose factors recur inside one period, powers inside powers, Fibonacci words
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    unit = [0, 1] * 20 + [2]
    texts += [fib[-1], unit * 4, (unit * 3 + [3]) * 4, [0, 0, 1] * 30 + [0, 0, 2] * 30, [7] * 500]
    for texts_at_once in (texts, texts[::-1]):
        found = periodic_runs.find_runs([np.array(t, np.int64) for t in texts_at_once])
        for t, got in zip(texts_at_once, found):
            assert got == brute_runs(t)
    assert sum(len(brute_runs(t)) for t in texts) > 150
    assert periodic_runs.find_runs([]) == []


def test_synchronising_set_is_consistent_and_dense():
    rng = np.random.default_rng(3)
    block = rng.integers(0, 3, 400)
    tokens = np.concatenate([block, rng.integers(0, 3, 100), block])
    scale, hashes = 8, tokens.astype(np.uint64)
    windows = [tuple(tokens[i : i + scale].tolist()) for i in range(len(tokens))]
    hashes = np.array([zlib.crc32(repr(w).encode()) for w in windows], np.uint64)
    rest = np.arange(len(tokens), 0, -1)
    periodic = np.array([any(w[p:] == w[:-p] for p in range(1, scale // 3 + 1)) for w in windows])
    chosen = set(periodic_runs.synchronising_set(hashes, scale, rest, periodic).tolist())
    for i in range(len(block) - 2 * scale):
        assert (i in chosen) == (i + 500 in chosen)
    for i in range(len(tokens) - 3 * scale):
        stretch = tokens[i : i + 3 * scale - 1]
        if not any((stretch[p:] == stretch[:-p]).all() for p in range(1, scale // 3 + 1)):
            assert chosen & set(range(i, i + scale))


def test_runs_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [brute_row(*r) for r in rows if len((r.text or "").split()) < 900]
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(rows) and len(want) > 0.8 * len(rows)
    assert all(got[w[0]] == w for w in want)
    assert any(w[1] for w in want)


def test_runs_on_awkward_rows(spark):
    long = "a b c " * 50_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "x " * 30), (4, "x " * 30), (4, "x " * 30), (5, "x " * 23), (6, "é ü\x0b" * 40)]
    rows += [(i, " ".join(f"w{j % 7}" for j in range(60))) for i in range(10, 40)]
    df = spark.createDataFrame([(i, t, 1, "a", "b", 2, 3) for i, t in [*rows, (7, long)]], EXTRA)
    for planted in (False, True):
        got = periodic_runs.periodic_runs(df.repartition(3), planted=planted).collect()
        key = lambda r: (str(r[0]), r[1], r[6])
        have = sorted((tuple(r)[:-1] for r in got if r.doc_id != 7), key=key)
        assert have == sorted((brute_row(i, t, planted) for i, t in rows), key=key)
        at = next(r for r in got if r.doc_id == 7)
        if not planted:
            assert [tuple(x) for x in at.runs] == [(0, 150_000, 3)] and at.exponent_milli == 50_000_000
    assert periodic_runs.periodic_runs(df.limit(0)).collect() == []


# ---------------------------------------------------------------- fingerprints
def brute_digest(data):
    """The digest by one loop over the bytes."""
    found = [0] * fingerprint.BUCKETS
    for n, (second, third) in enumerate(fingerprint.SHAPES):
        for i in range(len(data) - third):
            parts = zip(fingerprint._SALTS[n], (data[i], data[i + second], data[i + third]))
            h = sum(int(salt[b]) for salt, b in parts) & 0xFFFFFFFF
            h ^= h >> 15
            found[(h * 0x2C1B3C6D & 0xFFFFFFFF) >> 24] += 1
    ranked = sorted(found)
    cuts = [ranked[fingerprint.BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    codes = [sum(n > c for c in cuts) for n in found]
    body = [codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, len(codes), 4)]
    length = min(255, int(np.floor(np.log1p(len(data)) / np.log(fingerprint.GROWTH))))
    top = max(cuts[2], 1)
    return bytes([length, min(15, cuts[0] * 16 // top) << 4 | min(15, cuts[1] * 16 // top), *body])


def brute_likeness(a, b):
    codes = lambda d: [(x >> s) & 3 for x in d[2:] for s in (6, 4, 2, 0)]
    body = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(x - y)] for x, y in zip(codes(a), codes(b)))
    ratio = abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))
    d = body + min(abs(a[0] - b[0]), fingerprint.LENGTH_MOST) + min(ratio, fingerprint.RATIO_MOST)
    return 1.0 - min(d, fingerprint.LIMIT) / fingerprint.LIMIT


def test_digests_equal_brute_force(monkeypatch):
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc \xc3\xa9") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 50, 700, 3000, 0)]
    for step in (1 << 20, 64):
        monkeypatch.setattr(fingerprint, "STEP", step)
        got = fingerprint.digests(texts)
        assert [r.tobytes() for r in got] == [brute_digest(t) for t in texts]
    pairs = [(a, b) for a in got for b in got]
    have = fingerprint.likeness(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert have.tolist() == pytest.approx([brute_likeness(a.tobytes(), b.tobytes()) for a, b in pairs])


def brute_next(rows):
    """Rows in order of id, text; each beside the next one, the last beside the first."""
    rows = sorted(rows, key=lambda r: r[0])
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        own, other, following = (brute_digest(x.encode()) for x in (text, changed, after))
        out.append((
            i, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), other.hex(),
            brute_likeness(own, other), brute_likeness(own, following),
        ))
    return out


def test_fingerprints_meet_the_next_document(spark):
    rng = random.Random(9)
    rows = [(i * 3, "".join(rng.choice("ab é日") for _ in range(rng.randrange(60)))) for i in range(90)]
    rows += [(500, None), (501, ""), (502, "x" * 200_000), (503, "é" * 7), (504, "ab"), (504, "ab"), (504, "ab")]
    df = spark.createDataFrame([(i, t, 1, "a", "b", 2, 3) for i, t in rows], EXTRA)
    want = [r for r in brute_next([r for r in rows if r[0] != 502])]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for parts, batch in ((1, "2000"), (5, "7"), (40, "1")):
        part = df.where("doc_id <> 502").repartition(parts)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            found = fingerprint.fingerprints_with_next(part)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = sorted(tuple(r) for r in found.collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        assert [r[:5] for r in got] == [r[:5] for r in sorted(want)]
        assert [r[5:] for r in got] == [pytest.approx(r[5:]) for r in sorted(want)]
    long = next(r for r in fingerprint.fingerprints_with_next(df).collect() if r.doc_id == 502)
    assert long.n_chars == 200_000 and 0 <= long.near_edited <= 1


def test_fingerprints_ties_nulls_empty(spark):
    df = spark.createDataFrame([(None, "p"), (1, "b" * 40), (1, "a" * 40), (None, None)], "doc_id long, text string")
    got = fingerprint.fingerprints_with_next(df).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 1), (1, 40), (1, 40)]
    again = fingerprint.fingerprints_with_next(df.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert fingerprint.fingerprints_with_next(df.limit(0)).collect() == []
    one = fingerprint.fingerprints_with_next(df.where("text = 'p'")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_edited_texts_are_nearer_than_the_next(spark, sf):
    rows = queries.op13_fingerprints(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("text").collect()]
    assert sorted(r.n_chars for r in rows) == sorted(len(t or "") for t in texts)
    kept = [r for r in rows if r.n_chars >= 40]
    assert sum(r.near_edited > r.near_next for r in kept) > 0.95 * len(kept)
