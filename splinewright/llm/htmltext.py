"""Main-text extraction from web pages with suffix arrays of their hosts.

Each page is parsed, by one pass over its characters, into blocks of visible text with what
stands around them: inside an article or main element, inside an element that is
boilerplate by its tag or class (menus, headers, footers, sidebars, notices, adverts,
forms, comments), or neither. Boilerplate by markup goes, and so does what stands beside
an article.

What is left of pages without an article is judged by their host's suffix array: the token
streams of such pages are laid end to end, suffixes sorted by prefix doubling, and
neighbours in that order that share `MIN_RUN` tokens or more form intervals. Runs whose
interval holds two distinct pages or more are boilerplate; a block goes if they cover half
of it, so that unique runs stay. A host of more than `PART_BYTES` doesn't fit a task: its
suffixes are dealt by their first `MIN_RUN` tokens, which keeps every interval whole, and
each page gets back which of its suffixes are repeated. Both ways count on the whole host
and give the same.

Inside articles a block of `MIN_RUN` tokens or more is boilerplate where three fifths of the
host's pages with an article (four at least) have it word for word and such blocks are less than half
of the article. What is left is joined in page order.

Defined cases: null or empty html gives an empty text; a null url, or one without a host,
shares the empty host; unclosed elements end where one around them ends, and of a tag that
never ends all goes up to the page's end; copies of a page are extracted alike and count
as one page; an id may be null or repeated; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, table

MIN_RUN = 6
SHARE = 0.6  # of a host's articles, that boilerplate within articles has
PART_BYTES = 8 << 20  # text of a host that one task holds as one suffix array

#: Elements by what they do to the text inside them.
DROP = set("script style noscript template svg math iframe object head title canvas audio video".split())
BOILER = set("nav footer aside form button select textarea menu dialog label fieldset".split())
MAIN = set("article main".split())
BOX = BOILER | MAIN | set("header div section ul ol table tbody tr td figure details body".split())
BREAK = BOX | set("p h1 h2 h3 h4 h5 h6 li dl dt dd blockquote pre hr br th thead tfoot caption figcaption summary address option html center".split())
BOILER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|sidebar\w*|side|aside|widget\w*|menu\w*|nav\w*|breadcrumbs?|"
    r"footer\w*|masthead|site-?header|page-?header|top-?bar|toolbar|comments?|comment-\w+|replies|reply|respond|disqus|share\w*|social\w*|related|recommended|newsletter|subscribe|signup|login|search\w*|pagination|pager|tags?|form)(?:$|[\s_-])",
    re.I,
)
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article(?:-?body|-?content)?|post-?(?:body|content)|entry-?content|main-?content|story(?:-?body)?|articlebody)(?:$|[\s_-])", re.I)

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_QUOTE = re.compile(r"=\s*([\"'])")
_ENDS = {tag: re.compile(rf"</{tag}(?![a-zA-Z0-9:-])", re.I) for tag in sorted(DROP)}
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

NEITHER, IN_MAIN, IN_BOILER = 0, 1, 2


def _tags(page: str):
    """(start, end, closing, name, attributes) of each tag in order, name None for comments and declarations; linear in the page.

    The consumer may send a position to go on from.
    """
    at, gone = 0, set()  # gone: quotes that don't occur any more
    while m := _OPEN.search(page, at):
        start, at = m.span()
        if page.startswith("<!--", start):
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            yield start, at, False, None, ""
            continue
        end, seen = page.find(">", at), at
        while end >= 0 and m.group(2) and (q := _QUOTE.search(page, seen, end)):
            close = -1 if q.group(1) in gone else page.find(q.group(1), q.end())
            if close < 0:
                gone.add(q.group(1))
                seen = q.end()
                continue
            seen = close + 1
            if close > end:
                end = page.find(">", seen)
        if end < 0:
            yield start, len(page), False, None, ""
            return
        on = yield start, end + 1, m.group(1) == "/", m.group(2) and m.group(2).lower(), page[at:end]
        at = end + 1
        if on is not None:
            at = on
            yield None


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page, in order."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    kind, at, page, endless = NEITHER, 0, page or "", set()

    def flush():
        words = entities.unescape("".join(text)).split()
        text.clear()
        if words:
            out.append((kind, " ".join(words)))

    tags = _tags(page)
    for start, end, closing, tag, inside in tags:
        text.append(page[at:start])
        at = end
        if tag is None:
            continue
        if tag in BREAK:
            flush()
        if tag in DROP:
            if closing or inside.endswith("/"):
                continue
            m = None if tag in endless else _ENDS[tag].search(page, at)
            if not m:
                endless.add(tag)
                if tag in ("head", "title"):
                    continue
            close = page.find(">", m.end()) if m else -1
            at = close + 1 if close >= 0 else len(page)
            tags.send(at)
            continue
        if tag not in BOX:
            continue
        if closing:
            while opened[tag]:
                name, kind = stack.pop()
                opened[name] -= 1
                if name == tag:
                    break
            continue
        stack.append((tag, kind))
        opened[tag] += 1
        if kind == IN_BOILER:
            continue
        names = " ".join(next(filter(None, g), "") for g in _NAMES.findall(inside))
        if tag in BOILER or tag == "header" and kind != IN_MAIN or names and tag != "body" and BOILER_NAME.search(names):
            kind = IN_BOILER
        elif tag in MAIN or names and MAIN_NAME.search(names):
            kind = IN_MAIN
    text.append(page[at:])
    flush()
    return out


def candidates(page: str | None) -> tuple[bool, list[str]]:
    """Whether the page has an article, and its blocks that markup leaves: the article's, or all that aren't boilerplate."""
    found = blocks(page)
    has_main = any(kind == IN_MAIN for kind, _ in found)
    return has_main, [text for kind, text in found if kind == (IN_MAIN if has_main else NEITHER)]


def suffix_array(tokens: np.ndarray, reach: int = 2 * MIN_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `reach` tokens or more, and how many tokens (up to that) each shares with the one before."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    while width < reach and n:
        ahead = np.zeros_like(rank)
        ahead[:-width] = rank[width:] + 1
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        steps = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty_like(rank)
        rank[order] = steps
        ranks.append(rank)
        width *= 2
    # Common prefixes of neighbours, from the ranks by powers of two: what is equal is passed over.
    lcp = np.zeros(n, np.int64)
    if n:
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
            common += same * (1 << k)
            a, b = a + same * (1 << k), b + same * (1 << k)
        lcp[1:] = common
    return order, lcp


def repeated(tokens: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each token: in how many distinct pages a run of MIN_RUN tokens around it stands."""
    n = len(tokens)
    out = np.zeros(n, np.int64)
    if n < MIN_RUN:
        return out
    order, lcp = suffix_array(tokens)
    # Neighbours that share MIN_RUN tokens form intervals; suffixes that cross a page's end are in none.
    whole = np.zeros(n, bool)
    whole[: n - MIN_RUN + 1] = page[: n - MIN_RUN + 1] == page[MIN_RUN - 1 :]
    interval = np.cumsum(lcp < MIN_RUN) - 1
    at, own = order[whole[order]], interval[whole[order]]
    pages = np.unique(own * np.int64(n + 1) + page[at]) // (n + 1)
    count = np.bincount(pages, minlength=n)[own]
    for j in range(MIN_RUN):
        out[at + j] = np.maximum(out[at + j], count)
    return out


def _covered(cover: np.ndarray, counts: list[int], texts: list[str]) -> str:
    """The blocks of which repeated runs cover less than half."""
    ends = np.cumsum(counts)
    return " ".join(t for t, e, c in zip(texts, ends, counts) if 2 * np.count_nonzero(cover[e - c : e]) < c)


def choose(pages: list[list[str]]) -> list[str]:
    """The main text of each of a host's pages without an article, by their suffix array."""
    vocab: dict = {}
    distinct: dict = {}
    for bs in pages:
        distinct.setdefault(tuple(bs), len(distinct))
    ids, page, lengths = [], [], []
    for k, bs in enumerate(distinct):
        words = [t.split(" ") for t in bs]
        for w in words:
            ids.extend(vocab.setdefault(x, len(vocab)) for x in w)
        ids.append(-1 - k)  # no run goes over the end of a page
        lengths.append([len(w) for w in words])
        page.append(np.full(sum(lengths[-1]) + 1, k))
    seen = repeated(np.array(ids, np.int64), np.concatenate(page)) if ids else np.empty(0)
    out, at = [], 0
    for bs, counts in zip(distinct, lengths):
        n = sum(counts)
        out.append(_covered(seen[at : at + n] >= 2, counts, bs))
        at += n + 1
    return [out[distinct[tuple(bs)]] for bs in pages]


def _runs_of(blocks_: list[str]) -> np.ndarray:
    """A fingerprint of the first MIN_RUN tokens of each of a page's suffixes that has so many."""
    words = " ".join(blocks_).encode("utf-8", "surrogatepass").split(b" ")
    if len(words) < MIN_RUN:
        return np.empty(0, np.int64)
    h = np.array([int.from_bytes(blake2b(w, digest_size=8).digest(), "little") for w in words], np.uint64)
    out = np.zeros(len(h) - MIN_RUN + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(MIN_RUN):
            out = (out ^ h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _without(blocks_: list[str], often: list[int] | None) -> str:
    """An article without the blocks that most of its host's articles have, if those are less than half of it."""
    gone = set(often if often is not None else ())
    size = [t.count(" ") + 1 for t in blocks_]
    drop = [n >= MIN_RUN and _name(t) in gone for t, n in zip(blocks_, size)]
    if 2 * sum(n for n, d in zip(size, drop) if d) >= sum(size):
        drop = [False] * len(drop)
    return " ".join(t for t, d in zip(blocks_, drop) if not d)


def _name(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


RESULT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    ws = Workspace(pages.sparkSession, "html")
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"://([^/?#]*)", 1)), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))

    def parse(batches):
        for batch in batches:
            found = [candidates(h) for h in batch["html"]]
            out = batch[["page_id", "url", "host"]].copy()
            out["has_main"] = [m for m, _ in found]
            out["texts"] = ["\n".join(bs) for _, bs in found]
            # Blocks long enough to be told as boilerplate, each once.
            out["names"] = [list({_name(t) for t in bs if t.count(" ") + 1 >= MIN_RUN}) if m else None for m, bs in found]
            yield out.astype({"page_id": "Int64"})

    parsed = ws.stage(src.mapInPandas(parse, "page_id long, url string, host string, has_main boolean, texts string, names array<long>"), "parsed", "zstd")
    articles, others = parsed.where("has_main"), parsed.where("not has_main")

    # Blocks that most articles of a host have: a page has few, so a host has few such.
    n = articles.select("host", F.xxhash64("texts").alias("copy")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    n = n.where("n >= 4")
    block = articles.select("host", F.xxhash64("texts").alias("copy"), "names").dropDuplicates(["host", "copy"]).select("host", F.explode("names").alias("name"))
    often = block.groupBy("host", "name").agg(F.count(F.lit(1)).alias("c")).where("c >= 4").join(n, "host").where(F.col("c") >= SHARE * F.col("n"))
    often = ws.stage(often.groupBy("host").agg(F.collect_list("name").alias("often")), "often")

    def articles_(batches):
        for batch in batches:
            texts = [_without(t.split("\n") if t else [], o) for t, o in zip(batch["texts"], batch["often"])]
            yield _rows(batch, texts)

    out = articles.select("page_id", "url", "host", "texts").join(often, "host", "left").mapInPandas(articles_, RESULT)

    # Hosts whose pages without an article fit a task.
    size = others.groupBy("host").agg(F.sum(F.octet_length("texts")).alias("size"))
    size = ws.stage(size, "sizes")
    large = size.where(F.col("size") > PART_BYTES)

    def small(group: pd.DataFrame) -> pd.DataFrame:
        return _rows(group, choose([t.split("\n") if t else [] for t in group["texts"]]))

    out = out.unionAll(others.join(large, "host", "left_anti").select("page_id", "url", "host", "texts").groupBy("host").applyInPandas(small, RESULT))
    if large.isEmpty():
        return out
    return out.unionAll(_large(ws, others.join(large, "host").withColumn("copy", F.xxhash64("texts", F.lit(1)))))


def _rows(batch: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"page_id": batch["page_id"].astype("Int64").array, "url": batch["url"].array, "text": texts, "n_chars": [len(t) for t in texts]})


def _large(ws: Workspace, others: DataFrame) -> DataFrame:
    """Pages of hosts that are too large for one array: suffixes meet by their first tokens, as an array's intervals would."""

    def suffixes(batches):
        for batch in batches:
            for h, c, t in zip(batch["host"], batch["copy"], batch["texts"]):
                runs = np.unique(_runs_of(t.split("\n"))) if t else ()
                if len(runs):
                    yield pd.DataFrame({"host": h, "copy": c, "run": runs})

    runs = others.dropDuplicates(["host", "copy"]).select("host", "copy", "texts").mapInPandas(suffixes, "host string, copy long, run long")
    runs = ws.stage(runs, "runs")
    twice = runs.groupBy("host", "run").agg(F.min("copy").alias("x"), F.max("copy").alias("y")).where("x <> y").select("host", "run")
    found = ws.stage(runs.join(twice, ["host", "run"]).groupBy("host", "copy").agg(F.collect_list("run").alias("runs")), "repeated")

    def keep(batches):
        for batch in batches:
            texts = []
            for t, found in zip(batch["texts"], batch["runs"]):
                bs = t.split("\n") if t else []
                counts = [b.count(" ") + 1 for b in bs]
                cover = np.zeros(sum(counts), bool)
                if found is not None and len(found):
                    at = np.flatnonzero(np.isin(_runs_of(bs), np.asarray(found, np.int64)))
                    for j in range(MIN_RUN):
                        cover[at + j] = True
                texts.append(_covered(cover, counts, bs))
            yield _rows(batch, texts)

    return others.join(found, ["host", "copy"], "left").select("page_id", "url", "texts", "runs").mapInPandas(keep, RESULT)


def op7_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html": op7_html}
ORACLES = {}
