"""Similarity self-join of documents on word n-grams (Jaccard), by vertical partitioning.

The global n-gram order (rarest first, ties by fingerprint) is cut into fragments of equal
load. Every text's n-grams, in that order, are cut at the same places. Candidate pairs are
counted fragment by fragment, and their partial overlaps are summed per pair and compared
exactly.

Candidates come from prefixes: two texts that link have an n-gram in common among the
rarest fifth of each (of the smaller one even among the rarest ninth). Where two texts
meet first, what each has left in the order bounds their overlap; pairs that can't reach
the threshold by it, or by their set sizes, are no candidates. N-grams of a single text
come first in the order, end in the count and only take places.

Not all pairs of a group are made. First every prefix n-gram's texts are compared with the
one of them that is shared most; what then still lies in different components and meets in
a prefix n-gram is compared pair by pair. So a group of near copies costs about as many pairs as
it has members, and no link between different texts is lost.

Texts with equal sets are one class from the start. N-grams that a hundredth of all
texts or more have (at most 100 times the mean set size of them) skip the counting, so
that no posting list of theirs is gathered; they come last in the order and count in
overlaps like all others.

Defined cases: words are runs of non-white-space with A-Z lower-cased; a text of fewer
than n words is one n-gram; null or empty texts have no n-grams and link with nothing;
repeated rows are of one class; a null id is never a component's name unless nothing
else is there; an empty table gives an empty result; only id and text are read. N-grams
are told apart by 56-bit fingerprints, classes by 64-bit ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Workspace, components, table

#: N-grams per fragment: what one task holds at once.
FRAGMENT = 1_500_000
SLICE = 1000  # documents hashed at a time
HEAVY = 0.01
PIECE = 20_000  # n-grams of a text in a fragment of the order, about, at most
BLOCK = 256  # pairs of one text, or texts of one n-gram, that are joined in one place

_BASE = 0x9E3779B97F4A7C15 | 1


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as far as texts are long."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _series(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (self._series(x, size) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Distinct fingerprints of the word n-grams, sorted."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _POWERS.get(len(joined) + 1)
    with np.errstate(over="ignore"):
        # Polynomial hashes of all prefixes; a stretch's hash is the difference, moved to the start.
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
        ends = np.concatenate((np.flatnonzero(joined == 32), [len(joined)]))
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = min(n, len(words))
        a, b = starts[: len(starts) - k + 1], ends[k - 1 :]
        h = (prefix[b] - prefix[a]) * down[a]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return np.unique(h >> np.uint64(8))


def _signature(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def classes(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, sig, often): often, on one row of each slice, lists n-grams that many of its texts have."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                sets = [shingles(t, n) for t in part["text"]]
                sigs = [_signature(h) if len(h) else None for h in sets]
                distinct = {s: h for s, h in zip(sigs, sets) if s is not None}
                often = [None] * len(part)
                if distinct:
                    h, c = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
                    many = c >= max(4, HEAVY / 2 * len(part))
                    often[0] = [{"h": int(a), "c": int(b)} for a, b in zip(h[many].view(np.int64), c[many])]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_shingles": [len(h) for h in sets], "sig": pd.array(sigs, "Int64"), "often": often}).astype({"doc_id": "Int64"})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, "doc_id long, n_shingles long, sig long, often array<struct<h: long, c: long>>")


def _runs(key: np.ndarray):
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return starts, np.diff(np.concatenate((starts, [len(key)])))


def _postings(docs: DataFrame, n: int, id_col: str, text_col: str, fragments: int, heavy: np.ndarray) -> DataFrame:
    """Packed postings (fragment, heads, hashes): heads are (class, set size, count) of each text in the fragment."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                seen = {}
                for t in batch["text"].iloc[at : at + SLICE]:
                    if len(h := shingles(t, n)):
                        seen[_signature(h)] = h
                if not seen:
                    continue
                sigs = np.array(list(seen), np.int64)
                sizes = np.array([len(h) for h in seen.values()])
                h = np.concatenate(list(seen.values()))
                own = np.repeat(np.arange(len(sigs)), sizes)
                frag = ((h >> np.uint64(20)) % np.uint64(fragments)).astype(np.int64)
                if len(heavy):
                    at_h = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                    # Frequent n-grams need no count: they are dealt by text, to fragments of their own.
                    frag = np.where(heavy[at_h] == h, fragments + sigs[own] % fragments, frag)
                order = np.lexsort((own, frag))
                frag, own, h = frag[order], own[order], h[order]
                starts, counts = _runs(frag)
                rows = []
                for s, c in zip(starts, counts):
                    o = own[s : s + c]
                    rs, rc = _runs(o)
                    heads = np.column_stack((sigs[o[rs]], sizes[o[rs]], rc)).astype(np.int64)
                    rows.append((int(frag[s]), heads[:, 0].tobytes(), heads[:, 1:].astype(np.int32).tobytes(), _shorten(h[s : s + c])))
                yield pd.DataFrame(rows, columns=["fragment", "sigs", "sizes", "hashes"])

    src = docs.select(F.col(text_col).alias("text"))
    return src.mapInPandas(run, "fragment int, sigs binary, sizes binary, hashes binary")


def _shorten(h: np.ndarray) -> bytes:
    """Fingerprints have 56 bits: seven bytes each."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack(group: pd.DataFrame):
    """Class, set size and hash of each posting of a packed group."""
    sigs = np.concatenate([np.frombuffer(x, np.int64) for x in group["sigs"]])
    sizes = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in group["sizes"]])
    h = np.frombuffer(b"".join(group["hashes"]), np.uint8).reshape(-1, 7)
    h = np.column_stack((h, np.zeros(len(h), np.uint8))).view(np.uint64).ravel()
    return np.repeat(sigs, sizes[:, 1]), np.repeat(sizes[:, 0], sizes[:, 1]), h


def _shared(fragments: int):
    """Within a fragment: the postings of n-grams that two texts or more have, packed anew by class, and how many have each frequency."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sig, size, h = _unpack(group)
        order = np.lexsort((sig, h))
        sig, size, h = sig[order], size[order], h[order]
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])))
        sig, size, h = sig[first], size[first], h[first]
        if group["fragment"].iloc[0] >= fragments:
            df = np.full(len(h), 255)
        else:
            _, c = _runs(h)
            df = np.repeat(np.minimum(c, 254), c)
        keep = df > 1
        sig, size, h, df = sig[keep], size[keep], h[keep], df[keep].astype(np.uint8)
        if not len(h):
            return pd.DataFrame([], columns=["bucket", "sigs", "sizes", "hashes", "dfs", "load"])
        bucket = sig % fragments
        order = np.lexsort((sig, bucket))
        sig, size, h, df, bucket = sig[order], size[order], h[order], df[order], bucket[order]
        rows = []
        for s, c in zip(*_runs(bucket)):
            o = sig[s : s + c]
            rs, rc = _runs(o)
            rows.append((int(bucket[s]), o[rs].tobytes(), np.column_stack((size[s : s + c][rs], rc)).astype(np.int32).tobytes(), _shorten(h[s : s + c]), df[s : s + c].tobytes(), None))
        rows[0] = (*rows[0][:-1], np.bincount(df, minlength=256).tolist())
        return pd.DataFrame(rows, columns=["bucket", "sigs", "sizes", "hashes", "dfs", "load"])

    return run


def _cuts(load: np.ndarray, pieces: int) -> np.ndarray:
    """Places in the order (frequency and, as its fraction, fingerprint) that cut the postings into equal pieces."""
    upto = np.cumsum(load)
    if not upto[-1]:
        return np.full(pieces - 1, 256.0)
    goals = upto[-1] * np.arange(1, pieces) / pieces
    df = np.searchsorted(upto, goals, "right")
    return df + (goals - (upto[df] - load[df])) / np.maximum(load[df], 1)


def _live(percent: int, cuts: np.ndarray):
    """Texts of which enough is shared to link at all: their shared n-grams in order, where fragments begin, how long the prefix is."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sig, size, h = _unpack(group)
        df = np.concatenate([np.frombuffer(x, np.uint8) for x in group["dfs"]])
        order = np.lexsort((h, df, sig))
        sig, size, h, df = sig[order], size[order], h[order], df[order]
        place = np.searchsorted(cuts, df + h / 2.0**56, "right")
        h = h.view(np.int64)
        starts, counts = _runs(sig)
        n = size[starts].astype(np.int64)
        least = -(-percent * n // 100)  # of a text's n-grams, this many lie in any text that it links with
        prefix = counts - least + 1  # the rarest, unshared ones first, that must hold one of them
        edges = np.arange(len(cuts) + 2)
        rows = [(int(sig[s]), int(k), int(c), int(p), np.searchsorted(place[s : s + c], edges), h[s : s + c]) for s, c, k, p in zip(starts, counts, n, prefix) if p > 0]
        return pd.DataFrame(rows, columns=["sig", "n", "s", "pre", "at", "grams"])

    return run


def _near(percent: int):
    """Set sizes that can reach the threshold."""
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def _enough(percent: int):
    """What is left of both texts from their first common n-gram, at pa and pb, can reach the threshold."""
    return F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def _crowded(pairs: DataFrame, key: str) -> DataFrame:
    """Adds salts: in how many places the rows of a key are joined."""
    salts = pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts"))
    return pairs.join(salts, key)


def _verify(ws: Workspace, live: DataFrame, pairs: DataFrame, percent: int, pieces: int) -> DataFrame:
    """Pairs (a, b) whose overlaps, counted in each fragment and summed, are large enough."""
    f = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("f")
    piece = F.slice("grams", F.get("at", F.col("f")) + 1, F.get("at", F.col("f") + 1) - F.get("at", F.col("f")))
    parts = live.select("sig", "n", "at", "grams", f).select("sig", "n", "f", piece.alias("g")).where(F.size("g") > 0)
    # A text of many pairs is copied to as many salts as it needs, never gathered with all of them.
    pairs = _crowded(pairs.select("a", "b"), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    left = pairs.join(parts.select(F.col("sig").alias("b"), F.col("n").alias("nb"), "f", F.col("g").alias("gb")), "b")
    right = pairs.select("a", "salt").distinct().join(parts.select(F.col("sig").alias("a"), F.col("n").alias("na"), "f", F.col("g").alias("ga")), "a")
    both = left.join(right, ["a", "salt", "f"])
    sums = both.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("ga", "gb")).cast("long")).alias("i"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return ws.stage(sums.where(F.col("i") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b"), "links")


def class_components(ws: Workspace, live: DataFrame, percent: int, pieces: int) -> DataFrame:
    """(sig, comp): components of linked classes, for the classes that may link."""
    posts = live.select("sig", "n", "s", F.posexplode(F.slice("grams", 1, F.col("pre"))).alias("p", "h"))
    posts = posts.select("h", "sig", "n", "s", (F.col("n") - F.col("s") + F.col("p")).alias("p"))
    # Of an n-gram's texts the one that is shared most is compared with all others.
    lead = F.max(F.struct(F.col("s") / F.col("n"), "n", "sig", "p")).alias("lead")
    heads = posts.groupBy("h").agg(lead, F.count(F.lit(1)).alias("m")).where("m > 1").select("h", "lead")
    posts = ws.stage(posts.drop("s").join(heads, "h").select("h", "sig", "n", "p", F.col("lead.sig").alias("a"), F.col("lead.n").alias("na"), F.col("lead.p").alias("pa")), "posts")
    pairs = posts.select("a", "na", "pa", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb")).where("a <> b").where(_near(percent) & _enough(percent))
    pairs = ws.stage(pairs.select("a", "b").distinct(), "pairs")
    links = _verify(ws, live, pairs, percent, pieces)
    comp = ws.stage(components(ws, links).select(F.col("node").alias("sig"), F.col("component").alias("comp")), "comp")
    # What meets in a prefix n-gram and lies in different components goes on. Of two texts that
    # link, the smaller one has the n-gram among the first that even an equal text must share.
    known = posts.select("h", "sig", "n", "p").join(comp, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    early = (F.col("n") - F.col("p")) * (100 + percent) >= F.col("n") * (2 * percent)
    known = known.withColumn("early", early)
    open_ = known.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum(F.col("early").cast("int")).alias("m"))
    open_ = open_.where("x <> y and m > 0").select("h", F.ceil(F.col("m") / BLOCK).cast("int").alias("salts"))
    known = known.join(open_, "h")
    small = known.where("early").select("h", F.pmod(F.xxhash64("sig"), F.col("salts")).cast("int").alias("salt"), F.col("sig").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("comp").alias("ca"))
    large = known.select("h", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("comp").alias("cb"))
    rest = small.join(large, ["h", "salt"]).where("ca <> cb and na <= nb").where(_near(percent) & _enough(percent))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = ws.stage(rest.join(done, ["a", "b"], "left_anti"), "rest")
    if rest.isEmpty():
        return comp
    more = _verify(ws, live, rest, percent, pieces)
    # Components are joined, not their texts again.
    name = lambda side: comp.select(F.col("sig").alias(side), F.col("comp").alias("c" + side))
    ties = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    tied = ws.stage(components(ws, ties).select(F.col("node").alias("old"), F.col("component").alias("new")), "tied")
    moved = comp.join(tied, comp["comp"] == tied["old"], "left").select("sig", F.coalesce("new", "comp").alias("comp"))
    alone = tied.join(comp, comp["sig"] == tied["old"], "left_anti").select(F.col("old").alias("sig"), F.col("new").alias("comp"))
    return moved.unionAll(alone)


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id (smallest id with the same set)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "ngrams")
    found = ws.stage(classes(docs, n, id_col, text_col), "classes")
    facts = found.agg(F.sum("n_shingles").alias("g"), F.count("sig").alias("d"), F.max("n_shingles").alias("longest")).first()
    fragments = max(12, -(-(facts["g"] or 0) // FRAGMENT))
    often = found.where("often is not null").select(F.explode("often").alias("o")).groupBy("o.h").agg(F.sum("o.c").alias("c"))
    # At most (mean set size / HEAVY) n-grams can be this frequent.
    heavy = np.sort(np.array([r["h"] for r in often.where(F.col("c") >= max(64, HEAVY * facts["d"])).collect()], np.int64).view(np.uint64))
    packed = _postings(docs, n, id_col, text_col, fragments, heavy)
    shared = packed.repartition(2 * fragments, "fragment").groupBy("fragment").applyInPandas(_shared(fragments), "bucket int, sigs binary, sizes binary, hashes binary, dfs binary, load array<long>")
    shared = ws.stage(shared, "shared")
    del packed
    ws.release()
    load = np.zeros(256)
    for r in shared.select(F.posexplode("load").alias("df", "c")).groupBy("df").agg(F.sum("c").alias("c")).collect():  # 256 numbers
        load[r["df"]] = r["c"]
    pieces = max(4, -(-(facts["longest"] or 0) // PIECE))
    cuts = _cuts(load, pieces)
    live = shared.drop("load").repartition(fragments, "bucket").groupBy("bucket").applyInPandas(_live(percent, cuts), "sig long, n long, s long, pre int, at array<int>, grams array<long>")
    live = ws.stage(live, "live")
    ws.drop(shared)
    ws.release()
    comp = class_components(ws, live, percent, pieces)
    named = found.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("m"))
    named = named.join(comp, "sig", "left")
    least = named.where("comp is not null").groupBy("comp").agg(F.min("class_id").alias("least"))
    # Only classes of several texts, or with links, differ from their own rows.
    named = named.where("m > 1 or comp is not null").join(least, "comp", "left")
    named = ws.stage(named.select("sig", "class_id", F.coalesce("least", "class_id").alias("component_id")), "named")
    ws.drop(live)
    out = found.select("doc_id", "n_shingles", "sig").join(named, "sig", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that name their component, all columns kept.

    An id names one text: of rows with one id one stays. Rows without an id all stay.
    """
    kept = ngram_components(docs, n, percent, id_col, text_col).where("doc_id = component_id")
    ids = kept.select(F.col("doc_id").alias(id_col)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(ids, id_col, "left_semi")
    # Repeated rows of an id follow each other after the join: no further shuffle or sort.
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(id_col))
    named = named.select("*", nth.alias("__nth")).where("__nth = 1").drop("__nth")
    return named.select(*docs.columns).unionAll(docs.where(F.col(id_col).isNull()))


def op6_ngram_join(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)
, s AS (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w)
, p AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s)
, o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
    FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2)
, l AS (SELECT a, b FROM o WHERE 100 * i >= 80 * (na + nb - i))
, e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)
, r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
, c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component, s.doc_id) AS component_id FROM s LEFT JOIN c ON c.node = s.doc_id
"""

QUERIES = {"op6_ngram_join": op6_ngram_join}
ORACLES = {"op6_ngram_join": ORACLE}
