"""Operators on embeddings and pages, and the pipeline."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from splinewright.llm import catalog, embeddings, htmltext, topk, urlfilter

VECTORS = "vec_id long, embedding array<float>, label int, bucket int, rep long, v string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows, centre = [], rng.normal(size=(6, 24))
    for i in range(400):
        x = centre[i % 6] + rng.normal(size=24) * rng.choice([0.05, 0.25, 1.0])
        rows.append((i, [float(v) for v in x.astype(np.float32)], i % 3))
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 24, 1), (403, [None] * 24, 1), (404, [math.nan] + [1.0] * 23, 1), (405, [math.inf] + [1.0] * 23, 1), (406, rows[0][1], None), (407, rows[0][1], 0), (500, rows[0][1], 0), (None, rows[3][1], 0), rows[9]]
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], VECTORS)


def test_near_duplicates_against_brute_force(spark, vectors):
    got = embeddings.near_duplicates(vectors, 0.93).toPandas()
    rows = vectors.select("vec_id", "embedding", "label").collect()
    ok = [r["vec_id"] is not None and r["label"] is not None and bool(r["embedding"]) and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"]) for r in rows]
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    x = {i: np.array(rows[i]["embedding"]) for i in range(n) if ok[i]}
    pairs = 0
    for i in x:
        for j in x:
            if i < j and rows[i]["label"] == rows[j]["label"] and x[i] @ x[j] / math.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.93:
                links[i] += 1
                links[j] += 1
                pairs += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    found = got["n_links"].sum() / 2
    assert 0.9 * pairs <= found <= pairs
    least = {}
    for i in range(n):
        least.setdefault(find(i), []).append(-1 if rows[i]["vec_id"] is None else rows[i]["vec_id"])
    want = Counter((rows[i]["vec_id"], links[i], min(least[find(i)])) for i in range(n) if ok[i])
    have = Counter((r.vec_id, r.n_links, r.component_id) for r in got.itertuples() if r.vec_id == r.vec_id)
    assert sum((want & have).values()) >= 0.9 * sum(want.values())
    alone = got[got["vec_id"].isin(range(400, 407))]
    assert (alone["n_links"] == 0).all() and (alone["component_id"] == alone["vec_id"]).all() and alone["kept"].all()
    assert len(got) == n and embeddings.near_duplicates(vectors.limit(0)).count() == 0


def test_near_duplicates_of_doubles_and_repeated_ids(spark):
    """Doubles are compared as such, however large; rows of one id with different vectors have links of their own."""
    rows = [(1, [1e200, 1.0]), (2, [1e200, 5.0]), (7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [0.01, 1.0]), (20, [1.0, 1.0 + 1e-12]), (21, [1.0, 1.0]), (21, [1.0, 1.0])]
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == Counter([(1, 2, 1), (2, 2, 1), (7, 2, 1), (7, 1, 7), (8, 1, 7), (20, 2, 20), (21, 2, 20), (21, 2, 20)])


def test_blocks_give_the_same(vectors, monkeypatch):
    want = Counter(map(tuple, embeddings.near_duplicates(vectors).collect()))
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    assert Counter(map(tuple, embeddings.near_duplicates(vectors).collect())) == want


def test_top_k_against_brute_force(vectors, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    got = [tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 100 == 0, 10).collect()]
    rows = [(r["vec_id"], np.floor(1024 * np.array(r["embedding"], float))) for r in vectors.collect() if r["vec_id"] is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    want = []
    for q, v in rows:
        if q % 100 == 0:
            best = sorted((-int(v @ x), i) for i, x in rows if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_leaves_non_finite_vectors_out(spark):
    """A query with NaN has no results; candidates with Infinity or NaN take no slot, even in a populated cell."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(1, 40)]
    bad = [(100, [math.nan, 1.0, 1.0, 1.0]), (101, [math.inf, 1.0, 1.0, 1.0]), (102, [1.0, -math.inf, 1.0, 1.0]), (103, [math.nan, 90.0, 90.0, 90.0])]
    query = (200, [1.0, 1.0, 1.0, 1.0])
    frame = spark.createDataFrame([*rows, *bad, query], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 100 == 0, 10).collect()]
    q = np.full(4, 1024)
    best = sorted((-int(q @ np.floor(1024 * np.array(v))), i) for i, v in rows)[:10]
    assert sorted(got) == [(200, k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_top_k_of_repeated_and_huge_query_rows(spark):
    """Repeated rows are one query, rows of one id with other vectors are queries of their own; scores past 2^53 are an error."""
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(1, 30)] + [(100, [1.0, 2.0])] * 3 + [(200, [1.0, 0.0]), (200, [0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 4).collect()
    per = Counter(r["query_id"] for r in got)
    assert per == {100: 4, 200: 8}
    for q, vs in ((100, [(1, 2)]), (200, [(1, 0), (0, 1)])):
        want = []
        for v in vs:
            best = sorted((-int(1024 * 1024 * (v[0] * x[0] + v[1] * x[1])), i) for i, x in rows if i != q)[:4]
            want += [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == sorted(want)
    for x in (1e12, 1e300):
        with pytest.raises(ValueError, match="2\\^53"):
            topk.top_k(spark.createDataFrame([(100, [x]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)


def test_top_k_moves_rows_in_proportion(spark, monkeypatch):
    """Clustered data: a member is copied to a few queries' blocks, however many there are in all (5 and 20 here)."""
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES_BLOCK", 16)
    moved = {}
    original = topk._solve

    def counted(k):
        run = original(k)

        def wrapped(group):
            moved[n].add(int((~group["is_query"]).sum()))
            return run(group)

        return wrapped

    monkeypatch.setattr(topk, "_solve", counted)
    rng = np.random.default_rng(3)
    for n in (8000, 32000):
        moved[n] = spark.sparkContext.accumulator(0)
        x = np.repeat(np.eye(40), n // 40, axis=0) * 30 + rng.normal(size=(n, 40)) * 0.1
        rows = [(i, x[j].tolist()) for i, j in enumerate(rng.permutation(n))]
        assert topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).count() == 10 * (n // 100)
    assert moved[8000].value <= 4 * 8000 and moved[32000].value <= 4 * 32000, moved  # to every block of queries, twice: 10 and 40 a member


def test_url_rules(spark):
    urls = {
        "http://a.com/en/x": ("a.com", "/en/x", "com/en/", "block"), "https://www.EXAMPLE.com/en/7?x#y": ("www.example.com", "/en/7", "example.com/en/7", "allow"), "http://example.net/de/85": ("example.net", "/de/85", "example.net/de/8", "block"),
        "http://example.net/de/9": ("example.net", "/de/9", "net/de/", "allow"), "http://x.org/es/": ("x.org", "/es/", "org/es/", "block"), "http://xexample.com/en/7": ("xexample.com", "/en/7", "com/en/", "block"),
        "http://www.cheappills.example.org/fr/1": ("www.cheappills.example.org", "/fr/1", None, "block"), "http://adult-x.example.net/en/": ("adult-x.example.net", "/en/", None, "block"), "http://newsblog.example.org": ("newsblog.example.org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x", "block") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, urlfilter.RULES).collect()}
    assert got == dict(enumerate(urls.values()))
    assert urlfilter.filter_urls(pages.limit(0), urlfilter.RULES).count() == 0


def test_url_verdicts_do_not_depend_on_table_size(spark):
    """A concatenated name is split in a table of one url as in a large one, and tokens of any length count whole."""
    url, long = "http://winbigcasino.example.com/a/1", "abcdefghij" * 3
    few = [url, f"http://x.org/{long}/it"]
    for urls in (few, few * 500, few + [f"http://{a}{b}host.org/" for a in "abcdefghij" for b in "klmnopqrst"]):
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        got = {r["page_id"]: r["verdict"] for r in urlfilter.filter_urls(pages, []).collect()}
        assert got[0] == "block" and got[1] == "allow"
        tokens = urlfilter.url_tokens(pages, "url")
        assert tokens[long] and "winbigcasino" not in tokens and "akhost" not in tokens


def test_url_names_in_disguise_and_of_any_length(spark):
    """Look-alike digits and accents don't hide words; names of 200,000 letters are judged in time."""
    import time

    urls = {"http://ca5ino-b0nus.example/": "block", "http://câsino.example/": "block", "http://p0rntube.example/": "block", "http://museum.example/page12": "allow", "http://例え.example/": "allow", "http://" + "casino" * 30_000 + ".example/": "block", "http://" + "qx" * 100_000 + ".example/": "allow"}
    rows = [(i, u, 1, "v") for i, u in enumerate(urls)] * 2 + [(None, None, 1, "v")]
    t = time.time()
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, w int, verdict string"), []).collect()
    assert time.time() - t < 60 and len(got) == len(rows)
    assert all(r["verdict"] == ("allow" if r["page_id"] is None else [*urls.values()][r["page_id"]]) for r in got)


def test_segmentation():
    seg = urlfilter.Segmenter(Counter({"cheap": 5, "pills": 5, "pill": 5, "in": 50, "the": 9}))
    assert seg.split("cheappills") == ["cheap", "pills"] and seg.split("qqq") == ["qqq"] and seg.split("") == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header class="top">Site name</header><nav><ul><li><a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side &amp; more</aside>{article}<div id="comments"><p>first!</p></div><form><input value=1><label>Mail</label></form><footer>&copy; 2020</footer></body></html>"""


def test_html(spark):
    art = "<article><h1>Title &lt;1&gt;</h1><p><b>Bold  text&#33;<br>next\n line<p>Second<script>x()</script> part</p><div class='ad'>Buy</div><aside>note</aside><p>Last &eacute;nd</p></article>"
    plain = "<div><p>" + " ".join(f"word{i}" for i in range(30)) + "</p><p>Shared boilerplate text of this host on every page</p></div>"
    other = "<div><p>" + " ".join(f"term{i}" for i in range(30)) + "</p><p>Shared boilerplate text of this host on every page</p></div>"
    rows = [(0, "http://a.b/x", PAGE.format(article=art)), (1, "http://c.d/1", f"<body>{plain}</body>"), (2, "http://c.d/2", f"<body>{other}</body>"), (3, None, None), (4, "x", ""), (5, "http://a.b/y", "<p>unclosed <b>tags"), (0, "http://a.b/x", PAGE.format(article=art)), (6, "http://a.b/z", "<<>> < a & b &bogus; <")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    found = htmltext.extract(pages).collect()
    got = {r["page_id"]: r["text"] for r in found}
    assert got[0] == "Title <1> Bold text! next line Second part Last énd"
    assert got[1] == " ".join(f"word{i}" for i in range(30)) and got[2].startswith("term0") and got[2].endswith("term29")
    assert got[3] == got[4] == "" and got[5] == "unclosed tags" and len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_suffix_array_finds_what_brute_force_finds():
    rng = np.random.default_rng(0)
    tokens, page = rng.integers(0, 3, 200), np.repeat(np.arange(4), 50)
    tokens[120:130] = tokens[20:30]
    got, n = htmltext.repeated(tokens, page), htmltext.MIN_RUN
    runs = {}
    for i in range(len(tokens) - n + 1):
        if page[i] == page[i + n - 1]:
            runs.setdefault(tuple(tokens[i : i + n]), []).append(i)
    want = np.zeros(len(tokens), int)
    for at in runs.values():
        for i in at:
            want[i : i + n] = np.maximum(want[i : i + n], len({page[k] for k in at}))
    assert (got == want).all()
    order, lcp = htmltext.suffix_array(tokens, 256)
    assert [tuple(tokens[i:]) for i in order] == sorted(tuple(tokens[i:]) for i in range(len(tokens)))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [0] + [common(tokens[i:], tokens[j:]) for i, j in zip(order, order[1:])]


def brute_text(pages):
    """{page_id: text} of (page_id, host, has_main, blocks): repeated runs found by comparing all of them, in plain Python."""
    n, out = htmltext.MIN_RUN, {}
    where, names = {}, {}
    for _, host, has_main, bs in pages:
        words = " ".join(bs).split(" ")
        if not has_main:
            for i in range(len(words) - n + 1):
                where.setdefault((host, tuple(words[i : i + n])), set()).add(tuple(bs))
        else:
            for b in bs:
                names.setdefault((host, b), set()).add(tuple(bs))
    for i, host, has_main, bs in pages:
        if has_main:
            total = len({tuple(b) for _, h, m, b in pages if m and h == host})
            drop = [len(b.split(" ")) >= n and total >= 4 and len(names[host, b]) >= max(4, 0.6 * total) for b in bs]
            if 2 * sum(len(b.split(" ")) for b, d in zip(bs, drop) if d) >= sum(len(b.split(" ")) for b in bs):
                drop = [False] * len(bs)
            out[i] = " ".join(b for b, d in zip(bs, drop) if not d)
            continue
        words = [(k, w) for k, b in enumerate(bs) for w in b.split(" ")]
        cover = [False] * len(words)
        for at in range(len(words) - n + 1):
            if len(where[host, tuple(w for _, w in words[at : at + n])]) > 1:
                cover[at : at + n] = [True] * n
        out[i] = " ".join(b for k, b in enumerate(bs) if 2 * sum(c for c, (j, _) in zip(cover, words) if j == k) < sum(j == k for j, _ in words))
    return out


@pytest.mark.parametrize("part_bytes", [8 << 20, 0])
def test_html_equals_brute_force_where_markup_says_little(spark, monkeypatch, part_bytes):
    """Boilerplate without telling tags, and inside articles: the query equals brute force in one array and by dealt suffixes, and the array changes pages."""
    import random

    monkeypatch.setattr(htmltext, "PART_BYTES", part_bytes)
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(n))
    menu, legal, letter = text(9), text(20), text(12)
    rows = []
    for i in range(60):
        own = "".join(f"<p>{text(rng.randrange(3, 40))}</p>" for _ in range(rng.randrange(1, 5)))
        if i % 3 == 0:
            body = f"<div>{menu}</div><div>{own}</div><div>{legal if i % 2 else text(4) + ' ' + legal}</div>"
        elif i % 3 == 1:
            body = f"<div>{text(8)}</div><article>{own}<p>{letter if i % 4 else text(12)}</p></article>"
        else:
            body = f"<div>{own}</div>"
        rows.append((i, f"http://{'one.example' if i < 40 else 'two.example'}/p{i}", body))
    rows += [(60, "http://one.example/copy", rows[0][2]), (61, "http://one.example/copy", rows[1][2]), (62, "http://one.example/", f"<div>{rows[2][2]}<p>x</p></div>"), (63, "http://one.example/e", "")]
    pages = spark.createDataFrame([(*r, "t", True, "h") for r in rows], "page_id long, url string, html string, text string, has_main boolean, host string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()}
    parsed = [(i, u.split("/")[2], *htmltext.candidates(h)) for i, u, h in rows]
    assert got == brute_text(parsed)
    changed = {k: sum(got[i] != " ".join(bs) for i, _, m, bs in parsed if m == k) for k in (True, False)}
    assert changed[False] >= 20 and changed[True] >= 10


def test_hostile_html_takes_linear_time():
    """Tags, quotes, comments and elements that never end, and odd nesting, a megabyte each."""
    import time

    for part, n in (("<a ", 350_000), ("<a =\"", 200_000), ("<a x='>", 150_000), ("<title>", 150_000), ("<script>", 120_000), ("<!--", 250_000), ("<!", 500_000), ("<div>", 200_000), ("</section><div>", 70_000), ("<", 1_000_000), ("=\"", 500_000), ("<div class=", 90_000), ("&#", 500_000)):
        t = time.time()
        htmltext.blocks(part * n)
        assert time.time() - t < 5, part
    assert htmltext.blocks("a<p x='>b</p>") == [(0, "a"), (0, "b")] and htmltext.blocks('<p title="a>b">c') == [(0, "c")]
    assert htmltext.blocks("İİ<SCRIPT>x</Script >y") == [(0, "İİy")]


def test_every_operator_has_its_query():
    names = catalog.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as P

    from splinewright.llm import mixing, ngramjoin, packing, toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [k for k, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "mixing", "best_fit_packing"]
    a = P.drop_toxic(spark, docs, sf_dir)
    model = toxicity.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert sorted(r["doc_id"] for r in a.collect()) == sorted(r["doc_id"] for r in docs.collect() if toxicity.score_text(r["text"], model) < toxicity.THRESHOLD)
    b = P.drop_near_duplicates(spark, a, sf_dir)
    assert sorted(r["doc_id"] for r in b.collect()) == sorted({r["component_id"] for r in ngramjoin.ngram_components(a).collect()})
    from test_documents import brute_components

    left = sorted((r["doc_id"], r["text"]) for r in a.collect())
    _, roots = brute_components([t for _, t in left])
    assert sorted(r["doc_id"] for r in b.collect()) == sorted({left[k][0] for k in roots})
    c = P.mix_sources(spark, b, sf_dir)
    assert a.columns == b.columns == c.columns == docs.columns
    report = {r["doc_id"]: r["copies"] for r in mixing.mix_report(b).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in c.collect()) == Counter(report)
    d = P.pack_sequences(spark, c, sf_dir)
    used, bound = packing.certificate(d)
    assert bound <= used <= bound + 1 and Counter(r["doc_id"] for r in d.collect() if r["piece"] == 0) == Counter(report)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    tokens = Counter({r["doc_id"]: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in b.collect()})
    assert sum(r["length"] for r in d.collect()) == sum(n * report.get(i, 0) for i, n in tokens.items())
    assert P.run(spark, sf_dir).count() == d.count()


def test_pipeline_on_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    """Nulls, copies, ties and columns with inner names pass through every stage; an empty table gives an empty result."""
    import corpus_pipeline

    for docs in (odd_docs, no_docs):
        empty = docs is no_docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == odd_docs.columns, name
            ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert {r["doc_id"] for r in out.select("doc_id").collect()} <= ids
            assert out.count() == 0 if empty else out.count() > 0, name
            docs = out
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert packed.count() >= docs.count() and (packed.count() == 0) == empty
