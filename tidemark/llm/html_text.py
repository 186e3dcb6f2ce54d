"""Main text of HTML pages: page structure, then a suffix array per host that removes repeated text."""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import arrow_map, checked_broadcast, prepare, spread
from tidemark.session import durable

# Elements of the public HTML standard, by what they hold.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select "
                   "option datalist".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
CHROME = frozenset("nav header footer aside form button fieldset menu dialog".split())
MAIN = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr nobr blink".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role that mark an element as no part of the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "sidebar aside header masthead footer breadcrumb breadcrumbs cookie cookies consent notice notices popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social comment comments respond disqus related "
    "recommended widget toolbar pagination pager skip search complementary contentinfo alert disclaimer".split()
)
# Words that only say what shape the marked element has (``ad-slot-1``, ``comment-list``, ``user-comments``).
SHAPES = frozenset(
    "bar block body bottom box button buttons card col column container content form global group holder icon icons inline inner item "
    "items left link links list outer page panel post posts reader readers right row section site slot thread top unit user users "
    "wrap wrapper".split()
)
# Marks that hold for ids inside an article and for article elements themselves.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies disqus modal newsletter popup "
    "respond sharing sidebar social sponsor sponsored subscribe".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
UNSEEN = re.compile(r"""(?<![\w-])style\s*=\s*(?:"[^"]*|'[^']*|[^\s>]*)(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
WORD = re.compile(r"[^\W\d_]+")
NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Ends of an implied paragraph: an open one does not reach out of these.
HOLDS_P = frozenset("article main section div td th li blockquote body header footer aside nav form fieldset button dd figure "
                    "figcaption details dialog".split())
CLOSES_P = HOLDS_P - {"td", "th", "body", "button"} | frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl dt pre hr table address menu hgroup".split())
MAIN_TEXT, LOOSE, ASIDE = 0, 1, 2
# Articles of a host that make a block inside an article boilerplate: this many, and this share of the host's articles.
FEW, SHARE = 3, 0.3
NONE, SHARED, COMMON = 0, 2, 3  # of a run of tokens: one owner, two owners or more, in so many articles
# Windows of hosts of several chunks: places (low bits of the hash) for each window of the host, and bits of a slice of places.
ROOM, SLICE = 16, 26


def _marked(attributes: str, inside: bool, article: bool = False) -> bool:
    """Whether a class, role or id says that an element is no part of the article.

    Such a name holds a mark, and besides marks only words of shape (``ad-slot-1``, ``cookie-banner``, not
    ``has-sidebar`` or ``related-work``).  Inside an article an id names a part of it and decides only by a strong mark; an
    article element is marked by strong marks alone.
    """
    if "=" not in attributes:
        return False
    for name, *values in NAMES.findall(attributes):
        marks = STRONG if article or (inside and name.lower() == "id") else MARKS
        for token in "".join(values).split():
            words = set(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()))
            if words & marks and words <= marks | SHAPES:
                return True
    return False


def _unseen(attributes: str) -> bool:
    """An element that browsers do not show: the hidden attribute or a style without display or visibility."""
    if not attributes.strip():
        return False
    return bool(re.search(r"(?<![\w-])hidden(?![\w-])", QUOTED.sub("", attributes), re.I) or UNSEEN.search(attributes))


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks in order.

    MAIN_TEXT stands inside the article, ASIDE in menus, page headers, footers, sidebars, notices, adverts, forms and
    reader comments (by element, class, id or role, ``article`` elements for comments among them), LOOSE elsewhere in the body.  An article inside a marked element or
    a form is one where no article stands in fewer of them, and a form that holds all text of a page holds loose text.
    Scripts, styles, markup and hidden elements give nothing.  Character references are decoded, white space becomes
    one space.
    """
    found: list[tuple[int, str]] = []
    around: list[tuple[int, bool]] = []  # for each block: marked elements and forms around it, a form alone made it ASIDE
    text: list[str] = []
    # element, and for its content: hidden, aside, in the article, aside by element, marked elements and forms, those marked
    stack: list[tuple[str, bool, bool, bool, bool, int, int]] = []
    start = (False, False, False, False, 0, 0)
    hidden, aside, inside, fixed, soft, marks = start
    at = 0

    def close_block():
        if text:
            plain = " ".join(entities.unescape("".join(text)).split())
            if plain:
                found.append((ASIDE if aside else MAIN_TEXT if inside else LOOSE, plain))
                around.append((soft, not (fixed or inside or marks)))
            text.clear()

    def leave(name):
        """Closes the nearest open element of a name; paragraphs and inline elements do not reach out of their block."""
        nonlocal hidden, aside, inside, fixed, soft, marks
        held = name == "p" or name in INLINE
        for e in reversed(stack):
            if e[0] == name:
                break
            if held and e[0] in HOLDS_P:
                return
        else:
            return
        before = (hidden, aside, inside)
        while stack.pop()[0] != name:
            pass
        after = stack[-1][1:] if stack else start
        if before != after[:3]:
            close_block()
        hidden, aside, inside, fixed, soft, marks = after

    part = PART.match

    def search(page, at):
        """The next tag, comment or declaration; a lone '<' is text."""
        while (at := page.find("<", at)) >= 0:
            if found := part(page, at):
                return found
            at += 1
        return None

    m = search(page, 0)
    while m:
        if m.start() > at and not hidden:
            text.append(page[at : m.start()])
        at, name = m.end(), m[2]
        if name is None:
            if m[0].startswith("<![CDATA[") and not hidden:
                text.append(m[0][9:].removesuffix("]]>"))
            m = search(page, at)
            continue
        name = name.lower()
        if name not in INLINE:
            close_block()
        if m[1]:
            leave(name)
        elif name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID:
            if name in CLOSES_P:  # an open paragraph ends where the next block begins
                leave("p")
            state = (hidden, aside, inside)
            if name in HIDDEN or _unseen(m[3]):
                hidden = True
            elif name == "form":
                aside, soft = True, soft + 1
            elif name in CHROME and not (name == "header" and inside):
                aside = fixed = True
            elif name in MAIN and _marked(m[3], inside, True):
                aside = fixed = True
            elif name not in ("html", "body", *MAIN, *HEADINGS) and _marked(m[3], inside):
                aside, soft, marks = True, soft + 1, marks + 1
            elif name in MAIN:
                aside = aside and (fixed or inside)
                inside = True
            stack.append((name, hidden, aside, inside, fixed, soft, marks))
            if (hidden, aside, inside) != state and name in INLINE and text:
                kept = (hidden, aside, inside)
                hidden, aside, inside = state
                close_block()
                hidden, aside, inside = kept
        m = search(page, at)
    if at < len(page) and not hidden:
        text.append(page[at:])
    close_block()
    least = min((n for (k, _), (n, _) in zip(found, around) if k == MAIN_TEXT), default=0)
    if least or any(n > least for (k, _), (n, _) in zip(found, around) if k == MAIN_TEXT):
        found = [(ASIDE if k == MAIN_TEXT and n > least else k, t) for (k, t), (n, _) in zip(found, around)]
    elif all(k == ASIDE for k, _ in found):
        found = [(LOOSE if n and form else k, t) for (k, t), (n, form) in zip(found, around)]
    return found


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` tokens, and the rank of each suffix by them (prefix doubling)."""
    order, rank = ranked(tokens)
    done = 1
    while done < depth:
        step = min(done, depth - done)
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        order, rank = ranked(rank * (len(rank) + 1) + after + 1)
        done += step
    return order, rank


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An ascending order of the values, and the rank of each: equal values have equal ranks."""
    order = np.argsort(values)
    sorted_ = values[order]
    rank = np.empty(len(values), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))[: len(values)]
    return order, rank


def repeated(tokens: np.ndarray, page: np.ndarray, owner: np.ndarray, main: np.ndarray, depth: int, least: int) -> np.ndarray:
    """What is known of each token by the substrings of ``depth`` tokens around it: NONE, SHARED or COMMON.

    ``page`` must not decrease; substrings never cross pages.  Neighbours in the suffix array that agree on ``depth``
    tokens are one run.  Its distinct owners are counted, and those that hold it inside their article (``main``).
    """
    if len(tokens) < depth:
        return np.zeros(len(tokens), np.int8)
    last = np.searchsorted(page, page, side="right")  # end of each token's page
    order, rank = suffix_array(tokens, depth)
    order = order[order + depth <= last[order]]
    if not len(order):
        return np.zeros(len(tokens), np.int8)
    run = rank[order]
    order = order[np.bincount(run)[run] > 1]  # a run of one place is nobody else's
    if not len(order):
        return np.zeros(len(tokens), np.int8)
    run = np.cumsum(np.concatenate(([0], rank[order][1:] != rank[order][:-1])))
    every, inner = owners_of(run, owner[order], main[order] & main[order + depth - 1])
    return covered_by(order, judged(every, inner, least)[run], len(tokens), depth)


def owners_of(run: np.ndarray, owner: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct owners of each run, runs numbered from 0: of all its places, and of those inside an article."""
    size = int(run[-1]) + 1
    counts = []
    for chosen in (np.ones(len(run), bool), inside):
        r, o = run[chosen], owner[chosen]
        at = np.lexsort((o, r))
        r, o = r[at], o[at]
        fresh = np.ones(len(r), bool)
        fresh[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1])
        counts.append(np.bincount(r[fresh], minlength=size))
    return counts[0], counts[1]


def judged(every: np.ndarray, inner: np.ndarray, least: np.ndarray | int) -> np.ndarray:
    return np.where(inner >= least, COMMON, np.where(every >= 2, SHARED, NONE)).astype(np.int8)


def least_articles(articles: int) -> int:
    return max(FEW, math.ceil(SHARE * articles))


def covered_by(starts: np.ndarray, found: np.ndarray, size: int, depth: int) -> np.ndarray:
    """For each token the most that is known of the substrings that start at some places."""
    out = np.zeros(size, np.int8)
    for level in (SHARED, COMMON):
        out[cover(starts[found >= level], size, depth)] = level
    return out


def cover(starts: np.ndarray, size: int, depth: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + depth, -1)
    return np.cumsum(edge[:-1]) > 0


def token_id(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def windows(tokens: np.ndarray, depth: int) -> np.ndarray:
    """A hash of every run of ``depth`` tokens."""
    value = np.zeros(len(tokens) - depth + 1, np.uint64)
    for i in range(depth):
        value = value * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + len(value)].view(np.uint64)
        value ^= value >> np.uint64(31)
    return value.view(np.int64)


def packed(blocks: list[tuple[int, str]]) -> bytes:
    """(kind, text) of a page's blocks in order as one compressed value: their number, kinds, lengths and texts."""
    texts = [t.encode("utf-8", "surrogatepass") for _, t in blocks]
    head = np.array([len(texts), *(k for k, _ in blocks), *map(len, texts)], "<u4").tobytes()
    return zstandard.compress(head + b"".join(texts))


def unpacked(value: bytes) -> list[tuple[int, str]]:
    data = zstandard.decompress(value)
    n = int.from_bytes(data[:4], "little")
    kinds, sizes = np.frombuffer(data, "<u4", 2 * n, 4).reshape(2, n).tolist()
    found, at = [], 4 + 8 * n
    for kind, size in zip(kinds, sizes):
        found.append((kind, data[at : at + size].decode("utf-8", "surrogatepass")))
        at += size
    return found


def packed_places(places: np.ndarray) -> bytes:
    """Ascending distinct numbers below 2**32: their differences, byte by byte of all."""
    steps = np.diff(places, prepend=0).astype("<u4")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked_places(value: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.decompress(value), np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel(), dtype=np.int64)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values stand in ``known``, which ascends."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class _Chunk:
    """Token stream of one chunk of a host's pages: rows with key, host, articles and packed blocks."""

    def __init__(self, pages: list[dict], depth: int):
        self.depth, self.host = depth, token_id(pages[0]["host"])
        self.blocks = [unpacked(p["blocks"]) for p in pages]
        flat = [b for own in self.blocks for b in own]
        words = pc.split_pattern(pa.array([t for _, t in flat], pa.large_string()), " ")
        self.sizes = np.asarray(pc.list_value_length(words)).astype(np.int64)
        coded = pc.dictionary_encode(words.flatten())
        known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False).view(np.int64)
        self.tokens = known[np.asarray(coded.indices)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        own = np.array([len(x) for x in self.blocks])
        self.page = np.repeat(np.repeat(np.arange(len(pages)), own), self.sizes)
        self.owner = np.repeat(np.repeat(np.array([p["key"] for p in pages], np.int64), own), self.sizes)
        self.main = np.repeat(np.array([k == MAIN_TEXT for k, _ in flat], bool), self.sizes)
        # a host in one chunk counts its articles here, a larger one has been counted before
        here = {p["key"] for p, own in zip(pages, self.blocks) if any(k == MAIN_TEXT for k, _ in own)}
        self.least = least_articles(pages[0]["articles"] or len(here))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every window of ``depth`` tokens within a page."""
        if len(self.tokens) < self.depth:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.page[: len(self.page) - self.depth + 1] == self.page[self.depth - 1 :])
        return at, windows(self.tokens, self.depth)[at] ^ self.host

    def counted(self, bits: int, held: np.ndarray) -> dict[str, np.ndarray] | None:
        """The distinct windows at some of ``2**bits`` places with their owners, and the owners that hold them inside their articles."""
        at, hashes = self.windows()
        chosen = among(hashes & ((1 << bits) - 1), np.sort(held))
        at, hashes = at[chosen], hashes[chosen]
        if not len(at):
            return None
        order = np.argsort(hashes, kind="stable")
        hashes, at = hashes[order], at[order]
        fresh = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        every, inner = owners_of(np.cumsum(fresh) - 1, self.owner[at], self.main[at] & self.main[at + self.depth - 1])
        return {"window": hashes[fresh], "every": every, "inner": inner}

    def left(self, crossing: np.ndarray) -> list[str]:
        """The text left of each page, given (window, kind) of the windows that other chunks hold too, in order."""
        covered = repeated(self.tokens, self.page, self.owner, self.main, self.depth, self.least)
        if len(crossing):
            at, hashes = self.windows()
            place = np.minimum(np.searchsorted(crossing[:, 0], hashes), len(crossing) - 1)
            known = np.where(crossing[place, 0] == hashes, crossing[place, 1], NONE)
            covered = np.maximum(covered, covered_by(at, known, len(covered), self.depth))
        if not len(covered):
            return [""] * len(self.blocks)
        # of each block: its tokens that are SHARED at least, and the least that is known of any
        shared, least = np.add.reduceat(covered >= SHARED, self.starts, dtype=np.int64), np.minimum.reduceat(covered, self.starts)
        known = list(zip(self.sizes.tolist(), shared.tolist(), least.tolist(), self.starts.tolist()))
        texts, n = [], 0
        for own in self.blocks:
            texts.append(" ".join(_judged(own, known[n : n + len(own)], covered)))
            n += len(own)
        return texts


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, window, kind) of the windows that are SHARED or COMMON on their host.

    Rows are (window, owners, owners inside articles, articles needed, cell, article) in order of the window, one for each
    chunk that holds it.  Chunks hold different articles, so the owners add up; the chunks of one article that was split
    name it, and count once.
    """
    names = ["window", "every", "inner", "least", "cell", "part", "split"]
    kept = {n: np.empty(0, np.int64) for n in names}

    def crossing(rows):
        starts = np.flatnonzero(np.concatenate(([True], rows["window"][1:] != rows["window"][:-1])))
        counts = {n: rows[n].copy() for n in ("every", "inner")}
        split = np.flatnonzero(rows["split"])
        if len(split):  # of the rows of a split article only the first counts, that with it inside the article before others
            at = split[np.lexsort((-rows["inner"][split], rows["part"][split], rows["window"][split]))]
            same = (rows["window"][at][1:] == rows["window"][at][:-1]) & (rows["part"][at][1:] == rows["part"][at][:-1])
            for n in counts:
                counts[n][at[1:][same]] = 0
        sums = [np.add.reduceat(counts[n], starts) for n in ("every", "inner")]
        known = np.repeat(judged(*sums, rows["least"][starts]), np.diff(np.append(starts, len(rows["window"]))))
        found = known > NONE
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["cell"][found]), pa.array(rows["window"][found]), pa.array(known[found].astype(np.int32))],
            names=["cell", "window", "kind"],
        )

    for batch in batches:
        part = batch.column("part")
        new = {n: np.asarray(batch.column(n)).astype(np.int64) for n in names[:5]} | {
            "part": np.asarray(part.fill_null(0)), "split": np.asarray(part.is_valid()).astype(np.int64)
        }
        rows = {n: np.concatenate([kept[n], new[n]]) for n in names}
        # the last window may go on in the next batch
        cut = int(np.searchsorted(rows["window"], rows["window"][-1])) if len(rows["window"]) else 0
        if cut:
            yield crossing({n: v[:cut] for n, v in rows.items()})
        kept = {n: v[cut:] for n, v in rows.items()}
    if len(kept["window"]):
        yield crossing(kept)


def _judged(rows: list[tuple[int, str]], known: list[tuple[int, int, int, int]], covered: np.ndarray) -> list[str]:
    """The words left of a page's blocks, given (words, SHARED ones, the least known, first token) of each and what is known of tokens.

    Loose text loses every run that two owners share.  An article loses the blocks that are COMMON as a whole: in FEW
    articles at least and SHARE of the host's.  So a sentence that some articles share, or that shares a phrase, stays; an
    article of which more than half is repeated is an edited copy of another and stays whole.
    """
    inside = [k for (kind, _), k in zip(rows, known) if kind == MAIN_TEXT]
    copied = 2 * sum(k[1] for k in inside) > sum(k[0] for k in inside)
    left: list[str] = []
    for (kind, text), (size, _, least, start) in zip(rows, known):
        if kind == LOOSE:
            left += [w for w, c in zip(text.split(" "), covered[start : start + size].tolist()) if c < SHARED]
        elif kind == MAIN_TEXT and (copied or least < COMMON):
            left.append(text)
    return left


def unique_runs(pages: DataFrame, carry: list[str], depth: int = 8, chunk_tokens: int = 262_144) -> DataFrame:
    """``carry`` columns and the text of each page less what its host repeats, in page order (``_judged``).

    ``pages`` has key, host, blocks (place, kind, text) and the carried columns, a row for each page.  ``key`` is a page's article:
    pages with one key are copies and do not make each other boilerplate.
    """
    size = F.aggregate("blocks", F.lit(0), lambda n, b: n + F.size(F.split(b["text"], " ")))
    marked = F.exists("blocks", lambda b: b["kind"] == MAIN_TEXT)
    names = [*carry, "key", "host", "blocks"]

    def pack(cols):
        own = [sorted(b or [], key=lambda b: b["place"]) for b in cols["blocks"].to_pylist()]
        return {**cols, "blocks": [packed([(b["kind"], b["text"]) for b in x]) for x in own]}

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*carry, "key", "host").schema)
    rows = arrow_map(pages.select(*names), pack, f"{kept}, blocks binary")
    return _unique_runs(pages.select("host", "key", size.alias("n"), marked.alias("marked")), rows, carry, depth, chunk_tokens)


def _unique_runs(sizes: DataFrame, pages: DataFrame, carry: list[str], depth: int, chunk_tokens: int) -> DataFrame:
    """``unique_runs`` of pages with packed blocks; ``sizes`` has host, key, n (tokens) and marked (holds an article) of each.

    The pages of a host are dealt into chunks
    of about ``chunk_tokens`` tokens by the hash of their keys; a chunk's pages are one token stream with one suffix array.
    An article's copies lie in one chunk, or in chunks of their own where they outgrow one, so the owners of a run add up
    over chunks: the windows that chunks of one host share meet in one exchange by their hashes, each chunk giving a window once
    with its counts.  So a hot host is split and the result is that of one suffix array over the host.  Texts move
    once, compressed: the windows and the answers are made from the same exchange.

    Most windows stand in one chunk alone and need not move.  So chunks first send the places of their windows, the
    low bits of the hashes, about a byte and a half for each window; only windows at places of two chunks or more follow whole.
    """
    article = F.when(F.col("marked"), F.col("key"))
    # first per article, so that neither a hot host nor a hot article is gathered
    by_key = durable(sizes.groupBy("host", "key").agg(F.sum("n").alias("n"), F.max(article).isNotNull().cast("int").alias("article")))
    over = F.ceil(F.col("n") / chunk_tokens).cast("int")
    hot = durable(
        by_key.groupBy("host").agg(F.sum("n").alias("n"), F.sum("article").cast("int").alias("articles")).where(F.col("n") > chunk_tokens)
        .select("host", over.alias("chunks"), "articles")
    )
    # an article whose copies outgrow a chunk is dealt into chunks of its own
    heavy = durable(by_key.where(F.col("n") > chunk_tokens).select("host", "key", over.alias("copies")))
    placed = pages
    for table, on, names in ((hot, ["host"], ["chunks", "articles"]), (heavy, ["host", "key"], ["copies"])):
        if table.isEmpty():
            placed = placed.withColumns({n: F.lit(None).cast("int") for n in names})
        else:
            placed = placed.join(checked_broadcast(table, 16 << 20, 96), on, "left")
    own = F.xxhash64("host", "key", F.pmod(F.xxhash64(*carry), F.col("copies")))
    cell = F.when(F.col("copies").isNotNull(), own).otherwise(F.xxhash64("host", F.pmod(F.xxhash64("key"), F.coalesce("chunks", F.lit(1)))))
    part = F.when(F.col("copies").isNotNull(), F.col("key"))
    dealt = spread(placed.select(*carry, "key", "host", "blocks", "chunks", "articles", part.alias("part"), cell.alias("cell")), "cell")
    kept = pages.select(*carry).schema
    schema = T.StructType([*kept.fields, T.StructField("text", T.StringType())])

    def answer(pages_: pa.Table, crossing: np.ndarray) -> pa.Table:
        text = pa.array(_Chunk(pages_.to_pylist(), depth).left(crossing), pa.string())
        return pa.table({**{c: pages_.column(c) for c in carry}, "text": text})

    if hot.isEmpty():
        return dealt.groupBy("cell").applyInArrow(lambda pages_: answer(pages_, np.empty((0, 2), np.int64)), schema)

    def bits(chunks: int) -> int:
        return (ROOM * chunks * chunk_tokens).bit_length()

    def places(pages_: pa.Table) -> pa.Table:
        rows, at, parts, found = pages_.to_pylist(), np.empty(0, np.int64), [], None
        if rows[0]["articles"] is not None:  # only hosts of several chunks
            found = _Chunk(rows, depth)
            at = np.sort(found.windows()[1] & ((1 << bits(rows[0]["chunks"])) - 1))
            at = at[np.diff(at, prepend=-1) > 0]
        slices, starts = np.unique(at >> SLICE, return_index=True)
        if len(at):
            parts = np.split(at & ((1 << SLICE) - 1), starts[1:])
        n = len(parts)
        return pa.table({
            "owner": pa.array([found.host] * n if n else [], pa.int64()), "slice": pa.array(slices), "cell": pa.array([rows[0]["cell"]] * n, pa.int64()),
            "places": pa.array([packed_places(p) for p in parts], pa.binary()),
        })

    def met(rows: pa.Table) -> pa.Table:
        """Of each chunk the places of a slice that another chunk holds too."""
        own = [unpacked_places(p) for p in rows.column("places").to_pylist()]
        every, count = np.unique(np.concatenate(own), return_counts=True)
        both = [p[among(p, every[count > 1])] for p in own]
        found = [i for i, p in enumerate(both) if len(p)]
        return pa.table({
            "cell": rows.column("cell").take(pa.array(found, pa.int64())), "slice": rows.column("slice").take(pa.array(found, pa.int64())),
            "places": pa.array([packed_places(both[i]) for i in found], pa.binary()),
        })

    def counted(pages_: pa.Table, met_: pa.Table) -> pa.Table:
        names = ["window", "every", "inner", "least", "cell", "part"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        counts = None
        if pages_.num_rows and met_.num_rows:
            rows = pages_.to_pylist()
            found = _Chunk(rows, depth)
            held = [unpacked_places(p) + (s << SLICE) for s, p in zip(met_.column("slice").to_pylist(), met_.column("places").to_pylist())]
            counts = found.counted(bits(rows[0]["chunks"]), np.concatenate(held))
        if counts is None:
            return pa.schema(list(zip(names, kinds))).empty_table()
        n = len(counts["window"])
        values = [*counts.values(), np.full(n, found.least), np.full(n, rows[0]["cell"]), [rows[0]["part"]] * n]
        return pa.table([pa.array(v, t) for v, t in zip(values, kinds)], names=names)

    # all three read the texts by groupBy("cell"): so they share one exchange
    seen = dealt.groupBy("cell").applyInArrow(places, "owner long, slice long, cell long, places binary")
    both = seen.groupBy("owner", "slice").applyInArrow(met, "cell long, slice long, places binary")
    shared = dealt.groupBy("cell").cogroup(both.groupBy("cell")).applyInArrow(
        counted, "window long, every int, inner int, least int, cell long, part long"
    )
    across = shared.repartition("window").sortWithinPartitions("window").mapInArrow(_crossing, "cell long, window long, kind int")

    def extract(pages_: pa.Table, windows_: pa.Table) -> pa.Table:
        if not pages_.num_rows:
            return to_arrow_schema(schema).empty_table()
        found = np.column_stack([np.asarray(windows_.column(c)).astype(np.int64) for c in ("window", "kind")])
        return answer(pages_, found[np.argsort(found[:, 0], kind="stable")])

    return dealt.groupBy("cell").cogroup(across.groupBy("cell")).applyInArrow(extract, schema)


def _key(found: list[tuple[int, str]]) -> int:
    """The page's article: its main text, or its longest block outside menus."""
    main = " ".join(t for k, t in found if k == MAIN_TEXT) or max((t for k, t in found if k == LOOSE), key=len, default="")
    return token_id(main)


def main_text(
    pages: DataFrame, html: str = "html", url: str = "url", id_col: str = "page_id", depth: int = 8,
    chunk_tokens: int = 262_144,
) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page.

    Where a page marks its article (``article`` or ``main``), the text is that of the article, elsewhere the loose blocks
    of the body.  Both go less what other pages of the host repeat in runs of ``depth`` or more tokens (``unique_runs``):
    loose text run by run, an article block by block where FEW articles and SHARE of the host's hold the block; copies of
    an article do not count as repeats.
    Menus, adverts, footers and the like are part of the host's streams and never part of the text.

    A null or empty html gives an empty text; a null url is a host of its own name (empty); null ids and repeated rows are
    kept, each judged for itself; other columns are not read; an empty table gives an empty result.  Pages are parsed
    twice, for the sizes of hosts and for their blocks, so that no table of blocks is stored.
    """
    prepare(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"),
        F.monotonically_increasing_id().alias("row"),
    )

    def parsed(cols):
        for u, page in zip(cols["url"].to_pylist(), cols["html"].to_pylist()):
            found = blocks(page or "")
            marked = any(k == MAIN_TEXT for k, _ in found)
            yield host_of(u), _key(found), marked, [(ASIDE if marked and k == LOOSE else k, t) for k, t in found]

    def measure(cols):
        found = [(h, k, sum(t.count(" ") + 1 for _, t in b), m) for h, k, m, b in parsed(cols)]
        return dict(zip(("host", "key", "n", "marked"), zip(*found)))

    def parse(cols):
        found = [(h, k, packed(b)) for h, k, _, b in parsed(cols)]
        return {"page_id": cols["page_id"], "url": cols["url"], "row": cols["row"], **dict(zip(("host", "key", "blocks"), zip(*found)))}

    sizes = arrow_map(rows.select("url", "html"), measure, "host string, key long, n long, marked boolean")
    packs = arrow_map(rows, parse, "page_id long, url string, row long, key long, host string, blocks binary")
    texts = _unique_runs(sizes, packs, ["page_id", "url", "row"], depth, chunk_tokens)
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
