"""The ten operators against brute force, round trips and held-out labels, and on awkward rows."""

import re
import tempfile
import zlib
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash
from public_tokenizers import path
from pyspark.sql import functions as F

from tidemark.llm import ann, decontaminate, html_text, langid, mixing, queries, simhash, token_counts, token_ids, toxicity, warc

VOCABULARY = path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, cell int, ids int"
LONG = "word " * 60_000


def docs(spark, rows):
    """Rows (id, text, lang, source) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, s, 1, 5, "x", 2, 3) for i, t, g, s in rows], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark, [
        (1, None, None, None), (2, "", "en", "a"), (3, "  \n", "en", None), (None, "alpha beta", "en", "a"), (4, LONG, "en", "a"),
        (5, "Same text here now", "en", "a"), (5, "Same text here now", "en", "a"), (6, "same TEXT here now", None, "b"),
        (7, "é日本 <|endoftext|> x", "fr", "b"), (None, None, "de", None),
    ])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- 1 WARC
def test_warc_round_trip_and_revisits(spark):
    big = "<p>" + "a" * 2000
    pages = spark.createDataFrame(
        [(1, "http://a/1", big, 9), (2, None, big, 9), (3, "http://a/3", big, 9), (4, "u", "small", 9), (5, "u", "small", 9),
         (6, "x\r\ny", None, 9), (None, "n", big, 9), (7, "é", "é" * 700, 9), (7, "é", "é" * 700, 9)],
        "page_id long, url string, html string, shard int",
    )
    folder = warc.write_warc(pages)
    rows = warc.read_warc(spark, folder, payloads=True).collect()
    assert len(rows) == 9
    kinds = sorted(((r.page_id or 0), r.record_type, r.refers_to) for r in rows)
    assert kinds == [(0, "response", None), (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None),
                     (5, "response", None), (6, "response", None), (7, "response", None), (7, "response", None)]
    assert {r.payload_bytes for r in rows if r.page_id == 7} == {1400}
    assert [bytes(r.payload) for r in rows if r.page_id == 6] == [b""]
    again = warc.write_warc(pages.repartition(5))
    content = lambda f: {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in spark.read.format("binaryFile").option(
        "pathGlobFilter", "*.warc.gz").load(f).collect()}
    assert content(folder) == content(again)


def test_warc_rolls_and_empty(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.md5(F.col("id").cast("string")), 40).alias("html"))
    folder = warc.write_warc(pages, file_bytes=500)
    files = spark.read.parquet(f"{folder}/manifest").collect()
    assert len(files) > 64 and all(r.n_bytes < 1200 for r in files)
    assert warc.read_warc(spark, folder).count() == 400
    none = warc.write_warc(pages.limit(0))
    assert warc.read_warc(spark, none).count() == 0


# ---------------------------------------------------------------- 2 and 8 tokens
def test_token_files_equal_the_library(spark, awkward, library):
    got = token_ids.read_token_files(spark, token_ids.write_token_files(awkward, VOCABULARY)).collect()
    want = sorted(((r.doc_id, r.text or "") for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in want]
    start, sums = 0, defaultdict(list)
    for r in got:
        assert r.start == start
        start += r.n_tokens
        sums[r.doc_id].append((r.n_tokens, r.ids_crc32))
    expected = defaultdict(list)
    for d, t in want:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        expected[d].append((len(ids), zlib.crc32(ids.tobytes())))
    assert {k: sorted(v) for k, v in sums.items()} == {k: sorted(v) for k, v in expected.items()}


def test_token_files_empty_and_random_access(spark, empty, sf, library):
    assert token_ids.read_token_files(spark, token_ids.write_token_files(empty, VOCABULARY)).count() == 0
    source = table(spark, sf, "documents")
    folder = token_ids.write_token_files(source, VOCABULARY)
    dictionary = open(f"{folder.removeprefix('file:')}/dictionary", "rb").read()
    assert len(dictionary) > 1000
    name = spark.read.parquet(f"{folder}/manifest").orderBy("file").first().file
    file = token_ids.TokenFile(f"{folder}/{name}", dictionary)
    text = source.where(F.col("doc_id") == file.doc_id(0)).first().text
    assert file.ids(0).tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
    with pytest.raises(ValueError):
        token_ids.TokenFile(f"{folder}/{name}", b"another")


def test_token_counts_equal_the_library(spark, awkward, empty, library):
    got = token_counts.count_tokens(awkward, VOCABULARY).collect()
    want = [len(library.encode(r.text or "", add_special_tokens=False).ids) for r in awkward.collect()]
    assert sorted(r.n_tokens for r in got) == sorted(want)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and max(r.n_bytes for r in got) == len(LONG)
    assert token_counts.count_tokens(empty, VOCABULARY).count() == 0


def test_merging_of_odd_strings(library):
    alphabet = "aAbß éÉ'sTll12３½\n\t\x1c\x85ΣσΑİı日é🙂!!..<|startoftext|>__\x00aaaa%"
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list(alphabet), rng.integers(0, 50))) for _ in range(400)] + ["<|startoftext|>a<|endoftext|>", "aaaaaaa"]
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.counter(VOCABULARY).count(texts) == [len(i) for i in ids]
    assert [np.frombuffer(b, "<u2").tolist() for b in token_ids.encoder(VOCABULARY, "<u2")(texts)] == ids


# ---------------------------------------------------------------- 3 toxicity
def test_toxicity_held_out(spark, awkward, empty, sf):
    sf = sf.replace("0.001", "0.01")
    labels = table(spark, sf, "labels")
    got = queries.op3_toxicity(spark, sf)
    rows = got.join(labels, "doc_id").where("held_out").select("predicted", "toxic", "score").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)
    one = spark.createDataFrame([(5, 1), (6, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(awkward, one).collect()} <= {0.0, 1.0}
    assert toxicity.score_toxicity(empty, labels).count() == 0


# ---------------------------------------------------------------- 4 mixing
def test_mixing_meets_the_targets(spark, awkward, empty):
    cells = spark.createDataFrame([("a", "x", 900), ("a", "y", 50), ("b", "x", 30), ("b", "y", 20), ("c", "y", 0)], "s string, l string, tokens long")
    want = {"s": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double")}
    got = mixing.rake(cells, ["s", "l"], want, power=1.0, rounds=40).collect()
    mass = lambda k, v: sum(r.tokens * r.weight for r in got if r[k] == v) / 1000
    assert mass("s", "a") == pytest.approx(0.5, abs=1e-6) and mass("l", "x") == pytest.approx(0.93, abs=1e-6)
    for carry in (True, False):
        mixed = mixing.mix(awkward, carry=carry).select("doc_id", "__p", "__kept").collect()
        assert len(mixed) == 10 and all(0 <= r["__p"] <= 1 for r in mixed)
        assert len({r["__kept"] for r in mixed if r.doc_id == 5}) == 1
    assert mixing.mix(empty).count() == 0


# ---------------------------------------------------------------- 5 HTML
PAGE = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav>Home <a>About</a></nav>{}<footer>&copy; x</footer></body></html>"


def test_article_text(spark):
    pages = spark.createDataFrame(
        [(1, "http://h/1", PAGE.format("<article><h1>A&amp;B</h1><p>one\n  <b>tw</b>o<br>three<p>four</article><div class='ad'>buy</div>"), 1),
         (2, None, None, 1), (None, "http://h/3", "", 1), (4, "http://[bad", "plain &lt; text", 1)],
        "page_id long, url string, html string, uid int",
    )
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(pages).collect()}
    assert got == {1: ("A&B one two three four", 22), 2: ("", 0), None: ("", 0), 4: ("plain < text", 12)}
    assert html_text.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "body, want",
    [("<div class='layout has-sidebar'><article><p>text</p></article></div>", "text"),
     ("<div class='sidebar'><article><p>text</p></article></div>", "text"),
     ("<form id=f><article><p>text</p></article></form>", "text"),
     ("<form id=f><p>text</p></form>", "text"),
     ("<article><section id='related-work'>one</section><h2 id='search'>two</h2><p class='share'>no</p></article>", "one two"),
     ("<h1>head</h1><p>open<article><p>one</p><p>two</p></article>", "one two"),
     ("<b>open<article><p>one</b></p><p>two</p></article>", "one two"),
     ("<article>text</article><div class='related'><article>teaser</article></div>", "text"),
     ("<main>text<div class='comments'><article>reply</article></div></main>", "text"),
     ("<div class='cookie-banner'>no</div><aside><article>no</article></aside><p>text", "text"),
     ("<article>text<section id='comments'><p>reply</p></section><ul class='comment-list'><li>reply</li></ul></article>", "text"),
     ("<article>text</article><div class='user-comments'>reply</div><article class='comment'>reply</article>", "text"),
     ("<article><div class='cookie-bar'>no</div>te<div class='ad-slot-1'>no</div>xt<div class='social-links'>no</div></article>", "te xt"),
     ("<article><p hidden>no</p><p>text</p><p style='color:red; display: none'>no</p><p title='hidden'>more</p></article>", "text more"),
     ("<article><h2 class='menu'>Menu for tonight</h2><p>soup</p><h3 class='notice'>Notice</h3></article>", "Menu for tonight soup Notice"),
     ("<article><p class='comment-free'>one</p><div class='post-content'>two</div><div class='page-body'>three</div></article>", "one two three"),
     ("<main><article class='post'>text</article><article class='user-comment'>reply</article></main>", "text")],
)
def test_wrappers_keep_the_article(body, want):
    found = html_text.blocks(PAGE.format(body))
    least = min(k for k, _ in found)
    assert " ".join(t for k, t in found if k == least) == want


@pytest.mark.parametrize("chunk", [100_000, 40])
def test_repeats_inside_articles(spark, chunk):
    """An unmarked notice of three articles goes; copies, edited copies, what two articles share and shared phrases stay."""
    notice = "please tell your friends about this site and come back soon"
    body = [" ".join(f"a{n}w{i}" for i in range(40)) for n in range(6)]
    edited = body[5].replace("a5w19", "changed")
    quote = "begin of own text one two three four five six seven eight {} end"
    twice = "two articles of this host quote the same long sentence word for word here"
    parts = [[body[0], notice], [body[1], notice, quote.format("x")], [body[2], quote.format("y")], [body[3]], [body[3]],
             [body[5], body[4]], [edited, body[4]], [" ".join(f"b{i}" for i in range(50)), notice, twice], [" ".join(f"c{i}" for i in range(50)), twice]]
    pages = spark.createDataFrame(
        [(n, f"http://h/{n}", PAGE.format("<article>" + "".join(f"<p>{t}</p>" for t in p) + "</article>")) for n, p in enumerate(parts)]
        + [(99, "http://h/0", PAGE.format(f"<article><p>{body[0]}</p><p>{notice}</p></article>"))],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r.text for r in html_text.main_text(pages, chunk_tokens=chunk).collect()}
    want = {n: " ".join(t for t in p if t != notice) for n, p in enumerate(parts)}
    assert got == {**want, 99: body[0]}


def repeats_by_force(pages, depth):
    seen = defaultdict(set)
    for u, (key, words) in pages.items():
        for i in range(len(words) - depth + 1):
            seen[tuple(words[i : i + depth])].add(key)
    out = {}
    for u, (key, words) in pages.items():
        drop = {i + k for i in range(len(words) - depth + 1) if len(seen[tuple(words[i : i + depth])]) > 1 for k in range(depth)}
        out[u] = " ".join(w for i, w in enumerate(words) if i not in drop)
    return out


@pytest.mark.parametrize("chunk", [100_000, 60])
def test_suffix_arrays_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(chunk)
    notice = "this site uses cookies to make your visit a better one".split()
    pages = {}
    for n in range(40):
        words = [f"w{i}" for i in rng.integers(0, 400, 12)]
        at = int(rng.integers(0, 12))
        words[at:at] = notice if n % 3 else notice[:7]
        pages[bytes([n]) * 16] = (n // 2 if n > 30 else n, words)
    rows = [(u, k, "host", [(0, html_text.LOOSE, " ".join(w))]) for u, (k, w) in pages.items()]
    frame = spark.createDataFrame(rows, "uid binary, key long, host string, blocks array<struct<place int, kind int, text string>>")
    got = {bytes(r.uid): r.text for r in html_text.unique_runs(frame, ["uid"], 5, chunk).collect()}
    assert got == repeats_by_force(pages, 5)


@pytest.mark.parametrize("chunk", [100_000, 300, 60])
def test_common_blocks_count_articles(spark, chunk):
    """Blocks go where three articles and three tenths of the host's hold them; many copies of one article count once, wherever they lie."""
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    often, seldom, copied = text(12), text(12), text(12)
    body = [text(60) for _ in range(20)]
    parts = [[b, *([often] if n % 2 else []), *([seldom] if n < 5 else [])] for n, b in enumerate(body)]
    same = [text(40), copied, text(40)]
    pages = [("".join(f"<p>{t}</p>" for t in p), " ".join(t for t in p if t != often)) for p in [*parts, *[same] * 25]]
    df = spark.createDataFrame(
        [(n, f"http://h/{n}", PAGE.format(f"<article>{b}</article>")) for n, (b, _) in enumerate(pages)], "page_id long, url string, html string"
    )
    got = {r.page_id: r.text for r in html_text.main_text(df, chunk_tokens=chunk).collect()}
    assert got == {n: want for n, (_, want) in enumerate(pages)}


def test_chunks_move_few_windows(spark):
    """A host of many chunks moves its texts once and only windows that chunks may share: less than twice the texts' bytes."""
    rng = np.random.default_rng(3)
    notice = "this site uses cookies to make your visit a better one"
    words = [" ".join(f"w{i}" for i in rng.integers(0, 10**6, 300)) for _ in range(400)]
    rows = [(n, n, "host", [(0, html_text.LOOSE, f"{w} {notice}" if n % 50 == 0 else w)]) for n, w in enumerate(words)]
    frame = spark.createDataFrame(rows, "uid long, key long, host string, blocks array<struct<place int, kind int, text string>>")
    shuffled = lambda: sum(p.stat().st_size for p in Path(tempfile.gettempdir()).glob("blockmgr-*/*/shuffle_*.data"))
    before = shuffled()
    got = {r.uid: r.text for r in html_text.unique_runs(frame, ["uid"], chunk_tokens=4_000).collect()}
    assert shuffled() - before < 2 * sum(map(len, words))
    assert got == dict(enumerate(words))


# ---------------------------------------------------------------- 6 neighbours
def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).astype("f4").tolist()
    x[10] = x[20] = x[30] = x[0]
    rows = [(i, v, 1) for i, v in enumerate(x)] + [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (550, [None] * 8, 1), (600, [], 1), (None, x[1], 1), (7, x[7], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(frame, F.col("vec_id") % 50 == 0, block=64).collect())
    y = np.array(x, "f8")
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = []
    for q in range(0, 300, 50):
        near = sorted((-round(float(y[q] @ y[c]), 9), c) for c in range(300) if c != q)[:5]
        want += [(q, n + 1, c) for n, (_, c) in enumerate(near)]
    assert [r[:3] for r in got] == want
    assert all(abs(s - y[q] @ y[c]) < 1e-12 for q, _, c, s in got)
    assert ann.nearest(frame.limit(0), F.lit(True)).count() == 0
    few = ann.nearest(frame.where("vec_id in (0, 50)"), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 50)]


# ---------------------------------------------------------------- 7 language
def test_language_held_out_and_awkward(spark, awkward, empty, sf):
    sf = sf.replace("0.001", "0.01")
    known = table(spark, sf, "documents").select("doc_id", "lang")
    rows = queries.op7_language(spark, sf).where("held_out").join(known, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98
    model = langid.train(table(spark, sf, "documents"))
    got = awkward.select("text", langid.language(model).alias("l")).collect()
    assert {r.l.lang_pred for r in got if not r.text or not re.search(r"[^\W\d_]", r.text)} == {"und"}
    assert all(r.l.lang_pred in model.langs for r in got if r.text and r.text.strip())
    signs = spark.createDataFrame([("½ ²",), ("Ⅷ 12",), ("3 x",), ("٣",)], "text string")
    assert [r.l.lang_pred == "und" for r in signs.select(langid.language(model).alias("l")).collect()] == [True, True, False, True]
    assert langid.train(empty).langs == []
    assert {r.l.lang_pred for r in awkward.select(langid.language(langid.train(empty)).alias("l")).collect()} == {"und"}


def test_mixture_finds_both_languages(spark):
    rng = np.random.default_rng(4)
    draw = lambda letters, n: " ".join("".join(rng.choice(list(letters), 6)) for _ in range(n))
    alphabets = {"a": "abcdefgh", "b": "mnopqrst", "c": "éèüößñçà"}
    rows = [(draw(letters, 2000), g) for g, letters in alphabets.items()]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    texts = [draw(alphabets["a"], 140) + " " + draw(alphabets["b"], 60), draw(alphabets["c"], 50), "123 !", None]
    pred, score = langid.infer(texts, langid._Words(model))
    assert pred == ["a", "c", "und", "und"]
    assert abs(score[0] - 0.7) < 0.02 and score[1] == 1.0 and score[2] == 0.0


# ---------------------------------------------------------------- 9 leaks
def test_leaks_with_substitutions(spark, sf):
    rng = np.random.default_rng(2)
    item = [f"t{i}" for i in range(30)]
    changed = [w if i % 7 else "zz" for i, w in enumerate(item)]
    noise = lambda n: [f"n{i}" for i in rng.integers(0, 9999, n)]
    rows = [(1, noise(50) + item + noise(9)), (2, noise(50) + changed), (3, noise(80)), (4, item[:14] + ["in", "serted"] + item[14:]),
            (5, noise(9) + item[:8] + noise(30)), (6, ["Short", "one"]), (7, ["a", "short", "one"])]
    source = docs(spark, [(i, " ".join(w), "en", "s") for i, w in rows] + [(8, None, None, None), (9, "", "en", "s"), (None, " ".join(item), "en", "s")])
    tests = spark.createDataFrame([(1, " ".join(item).upper()), (2, "short ONE"), (3, None), (4, " ".join(item)), (5, "")], "item_id long, text string")
    found = {r.doc_id: (r.item_id, r.matched) for r in decontaminate.contamination(source, tests).collect()}
    assert found[1] == (1, 30) and found[4] == (1, 30) and found[6] == (2, 2) and found[None] == (1, 30)
    assert set(found) == {1, 2, 4, 6, None} and found[2][1] >= 15
    left = decontaminate.decontaminate(source, tests)
    assert left.columns == source.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 7, 8, 9]
    assert decontaminate.decontaminate(source, tests.limit(0)).count() == source.count()
    assert decontaminate.contamination(source.limit(0), tests).count() == 0


def test_leaks_of_short_items_and_long_passages(spark):
    """Short items quoted in longer texts, and verbatim passages below half of a long item."""
    noise = lambda n, m: [f"n{n}x{i}" for i in range(m)]
    nine, three, long = [f"q{i}" for i in range(9)], ["s0", "s1", "s2"], [f"t{i}" for i in range(250)]
    rows = [(1, noise(1, 50) + nine + noise(2, 9)), (2, noise(3, 4) + three), (3, noise(4, 30) + long[60:160] + noise(5, 30)),
            (4, noise(6, 30) + long[60:73]), (5, noise(7, 30) + long[60:72] + noise(8, 5)), (6, nine[:8] + noise(9, 20)), (7, nine), (8, three[:2])]
    source = docs(spark, [(i, " ".join(w), "en", "s") for i, w in rows])
    tests = spark.createDataFrame([(1, " ".join(nine)), (2, " ".join(three)), (3, " ".join(long))], "item_id long, text string")
    found = {r.doc_id: (r.item_id, r.matched, r.item_words) for r in decontaminate.contamination(source, tests).collect()}
    assert found == {1: (1, 9, 9), 2: (2, 3, 3), 3: (3, 100, 250), 4: (3, 13, 250), 7: (1, 9, 9)}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(source, tests).collect()) == [5, 6, 8]


# ---------------------------------------------------------------- 10 SimHash
def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_force(fps, bits=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fps, 2):
        if bin(a ^ b).count("1") <= bits:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprints(awkward):
    for r in awkward.collect():
        assert simhash.fingerprint(r.text) == slow_fingerprint(r.text)


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, 2000, dtype=np.uint64) for _ in range(2))
    got = simhash.manhattan(simhash.popcounts(a), simhash.popcounts(b))
    want = [sum(abs((int(x) >> s & 3).bit_count() - (int(y) >> s & 3).bit_count()) for s in range(0, 64, 2)) for x, y in zip(a, b)]
    assert got.tolist() == want and (got <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("block", [8, 32_768])
def test_components_equal_brute_force(spark, block):
    rng = np.random.default_rng(block)
    base = [int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)]
    fps = set(base)
    for f in base[:20]:  # chains and dense groups
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                f ^= 1 << int(bit)
            fps.add(f)
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    frame = spark.createDataFrame([(signed(f), 1) for f in fps], "fp long, first long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(frame, 3, block).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in edges)
    want = components_by_force(sorted(fps))
    from tidemark.llm.components import connected

    got = {r.node % 2**64: r.root for r in connected(simhash.links(frame, 3, block)).collect()}
    groups = defaultdict(set)
    for f, r in want.items():
        groups[r].add(f)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {
        frozenset(f for f in got if got[f] == r) for r in set(got.values())
    }


def test_simhash_awkward(spark, awkward, empty):
    got = simhash.simhash_components(awkward).collect()
    assert len(got) == 10
    component = {r.doc_id: r.component_id for r in got if r.doc_id}
    assert component[1] == component[2] == component[3] == 1 and component[5] == component[6] == 5
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 7]
    assert simhash.simhash_components(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_long_chain(spark):
    from tidemark.llm.components import connected

    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected(edges).collect()} == {0}
