"""Operators on documents against brute force, on odd inputs."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from splinewright.llm import licenses, mixing, ngramjoin, packing, sharding, toxicity
from splinewright.llm._common import Workspace, components


def ids_of(tokenizer, text):
    return np.array((tokenizer.encode(text, add_special_tokens=False).ids if text else []) + [0], "<u4")


def test_packing_round_trip(odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    got = packing.pack(odd_docs, path, 256).toPandas()
    texts = odd_docs.select("doc_id", "text").toPandas()
    assert len(got.groupby(["sequence_id", "offset"])) == len(got)
    total = 0
    for doc_id, text in zip(texts["doc_id"], texts["text"]):
        ids = ids_of(tok, text)
        own = got[got["doc_id"].isna()] if doc_id != doc_id else got[got["doc_id"] == doc_id]
        assert set(own["ids_crc32"]) == {zlib.crc32(ids[s : s + n].tobytes()) for s, n in packing.cut(len(ids), 256)}
        total += len(ids)
    assert got["length"].sum() == total
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 256
    used, bound = packing.certificate(packing.pack(odd_docs, path, 256), 256)
    assert bound <= used <= bound + 1
    assert packing.pack(no_docs, path).count() == 0


def test_packing_exchanges_documents(odd_docs, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 7)
    used, bound = packing.certificate(packing.pack(odd_docs, packing.default_tokenizer(), 256), 256)
    assert bound <= used <= bound + 1


def test_packing_exchanges_all_bins_with_gaps(spark, monkeypatch):
    """Two lengths that fill a sequence together, dealt unevenly over partitions: the bound is met, though many bins have gaps."""
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 60)
    monkeypatch.setattr(packing, "RELEASED_BINS", 1, raising=False)  # of the cap that once was
    docs = spark.createDataFrame([(i, " a" * (149 if i % 2 else 105)) for i in range(1200)], "doc_id long, text string")
    got = packing.pack(docs, packing.default_tokenizer(), 256)
    lengths = {r["length"] for r in got.select("length").distinct().collect()}
    assert lengths == {150, 106}
    assert packing.certificate(got, 256) == (600, 600)


def test_lower_bound_is_a_bound():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = rng.integers(1, 101, 60)
        bins, offs, fill = packing.best_fit_decreasing(x, 100)
        assert fill.max() <= 100 and packing.lower_bound(x, 100) <= len(fill)
    assert packing.lower_bound(np.full(9, 51), 100) == 9
    assert packing.lower_bound(np.full(9, 34), 100) == 5


def test_special_string_is_the_tokenizers_business():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    text = "a <|endoftext|> b"
    assert packing._encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_sharding(odd_docs, no_docs):
    got = sharding.shard(odd_docs, 7).toPandas()
    want = odd_docs.select("doc_id", "text").toPandas()
    assert len(got) == len(want)
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and set(got["shard"]) == set(range(7)) and set(got["law"]) == {"rows"}
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    facts = Counter((None if i != i else int(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in zip(want["doc_id"], want["text"]))
    assert facts == Counter((None if i != i else int(i), s, c) for i, s, c in zip(got["doc_id"], got["size"], got["text_crc32"]))
    assert sharding.shard(no_docs, 7).count() == 0


def test_sharding_keeps_groups_and_splits_hot_ones(spark):
    rows = [(i, "hot" if i < 130 else f"pair {i // 2}") for i in range(400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).toPandas()
    assert set(got.groupby("shard").size()) == {40}
    text = dict(rows)
    shards = defaultdict(set)
    for d, s in zip(got["doc_id"], got["shard"]):
        shards[text[d]].add(s)
    assert sum(len(v) == 1 for k, v in shards.items() if k != "hot") >= 100
    hot = Counter(s for d, s in zip(got["doc_id"], got["shard"]) if d < 130)
    assert sum(n * n for n in hot.values()) >= 0.2 * 130**2  # links kept; a tenth of them by chance


def test_sharding_goes_on_until_the_cut_no_longer_falls(spark):
    """A group of a third of all rows keeps most of the links that full shards allow; nearly all small ones end whole."""
    rows = [(i, "hot" if i < 1300 else f"four {i // 4}") for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 40).toPandas()
    assert set(got.groupby("shard").size()) == {100}
    text = dict(rows)
    shards = defaultdict(set)
    for d, s in zip(got["doc_id"], got["shard"]):
        shards[text[d]].add(s)
    whole = sum(len(v) == 1 for k, v in shards.items() if k != "hot")
    hot = Counter(s for d, s in zip(got["doc_id"], got["shard"]) if d < 1300)
    assert sum(n * n for n in hot.values()) >= 100_000  # 130,000 in 13 full shards
    assert whole >= 0.95 * (len(shards) - 1)


def brute_components(texts, n=5, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(sets))]


def test_ngram_join(odd_docs, no_docs):
    want = odd_docs.select("doc_id", "text").toPandas()
    sets, roots = brute_components(want["text"])
    least = defaultdict(list)
    for i, r in enumerate(roots):
        if want["doc_id"][i] == want["doc_id"][i]:
            least[r].append(int(want["doc_id"][i]))
    expected = Counter((None if d != d else int(d), len(s), min(least[r]) if least[r] else None) for d, s, r in zip(want["doc_id"], sets, roots))
    got = Counter(tuple(r) for r in ngramjoin.ngram_components(odd_docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == expected
    assert ngramjoin.ngram_components(no_docs).count() == 0


def test_ngram_join_blocks(spark, monkeypatch):
    """Many near copies that are not all alike: blocks must find the same components as brute force."""
    import random

    monkeypatch.setattr(ngramjoin, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(w))
    _, roots = brute_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.ngram_components(docs).collect()}
    assert got == dict(enumerate(roots))


def test_deduplicate_keeps_one_of_each(odd_docs):
    kept = ngramjoin.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    named = {r["component_id"] for r in ngramjoin.ngram_components(odd_docs).where("doc_id is not null").collect()}
    assert Counter(i for i in ids if i is not None) == Counter(named) and ids.count(None) == 1


def test_mixing(odd_docs, no_docs):
    got = mixing.mix_report(odd_docs).toPandas()
    total = got["size"].sum()
    per = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert abs(per["target"].sum() - total) < 1e-6 * total
    assert (got["taken"] <= 3 * got["size"]).all() and (per["target"] <= 3 * per.index + 1e-9).all()
    first = [p[0] for p in got["positions"] if len(p)]
    assert first == sorted(first)
    assert all(0 <= x <= 1 for p in got["positions"] for x in p)
    out = mixing.mix(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == got["copies"].sum()
    assert mixing.mix_report(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_mixing_hits_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "abcde"[i % 5 if i % 3 else 0]) for i in range(900)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, part in got.groupby("source_size"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 5


def test_mixing_fills_until_nothing_fits(spark):
    """One very long document among short ones: what it leaves is filled by as many others as fit, copies counted as one."""
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "abc"[i % 3]) for i in range(900)]
    rows += [(1000 + i, " ".join(["w"] * 900), s) for i, s in enumerate("abc")] + [rows[7]] * 5
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(got) == len(rows)
    for _, part in got.groupby("source_size"):
        left = part["target"].iloc[0] - part["taken"].sum()
        assert 0 <= left + 1e-6
        passes = part["copies"].min()
        units = part[part["copies"] == passes].groupby("doc_id")["size"].sum()
        assert not len(units) or (units > left).all()
    assert (got.groupby("doc_id")["copies"].nunique() == 1).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (20, 21), (12, 30), (5, 5)] + [(100, k) for k in range(101, 160)]
    got = {r["node"]: r["component"] for r in components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[4] == 1 and got[30] == 10 and got[21] == 20 and got[159] == 100 and 5 not in got
    assert components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def brute_scan(text, model):
    """(families, count) of licence lines, in plain Python."""
    z0, fams, found = np.array(model["bias"]), model["families"], []
    for line in (text or "").split("\n"):
        w = licenses.words_of(line)
        z = z0 + sum((np.array(model["weights"][g]) for g in set(licenses.grams_of(w)) if g in model["weights"]), np.zeros(len(z0)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        k = int(p.argmax())
        if k and p[k] >= licenses.PROBABILITY:
            own = {" ".join(x) for x in zip(w, w[1:])}
            if max(len(own & set(t)) / len(t) for t in model["pairs"][fams[k]]) >= licenses.CONTAINED:
                found.append(fams[k])
    return ",".join(sorted(set(found))), len(found)


def test_licenses(spark, odd_docs, no_docs):
    model = licenses.train(forms=6)
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "The license plate was lost.", "This work is licensed under the GNU General Public License, version 3."]
    rows = [(i, "some words here\n" + x + "\nmore of them") for i, x in enumerate(lines)] + [(9, "\n".join(lines)), (10, None), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["families"], r["n_licenses"]) for r in licenses.scan(docs, model=model).collect()}
    assert got == {i: brute_scan(t, model) for i, t in rows}
    assert [got[i][0] for i in (0, 1, 2, 3, 4)] == ["MIT", "Apache-2.0", "CC-BY-NC", "", "GPL"] and got[9][1] == 4
    assert {r["n_licenses"] for r in licenses.scan(odd_docs, model=model).collect()} == {0}
    assert licenses.scan(no_docs, model=model).count() == 0


def test_wrapped_licenses(spark):
    """A notice wrapped at a column is one paragraph; lines that end a sentence, or are short, are their own; a long line is scanned whole."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    plain = "Nothing of the kind was said at the meeting of the council of the town of old.\nReleased under the MIT License.\nEnd"
    rows = [(0, "Intro.\n\n" + mit), (1, plain), (2, "word " * 20_000 + "\nReleased under the MIT License."), (2, "x"), (3, "\n" * 5000), (None, mit)]
    got = licenses.scan(spark.createDataFrame([(*r, "c", 3) for r in rows], "doc_id long, text string, families string, k int"), model=licenses.train(forms=6)).collect()
    assert Counter((r["doc_id"], r["families"], r["n_licenses"]) for r in got) == Counter([(0, "MIT", 1), (1, "MIT", 1), (2, "MIT", 1), (2, "", 0), (3, "", 0), (None, "MIT", 1)])
    assert {r["doc_id"]: r["n_paragraphs"] for r in got if r["n_paragraphs"] > 1}[0] == 3


def test_tokens_of_a_whole_table_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    encode, tok = packing._encoder(path), Tokenizer.from_file(path)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"]] + ["", " ", "\u00e9\u0301\ud7ff\U0001f600 \t\r\n x", "a" * 5000]
    assert all(encode(t) == tok.encode(t, add_special_tokens=False).ids for t in texts)


def toxic_docs(seed, n):
    import random

    rng = random.Random(seed)
    syll = ["tha", "ren", "ing", "ou", "est", "ion", "ver", "con", "lo", "mi", "der", "pra"]
    bad = ["idiot", "moron", "worthless", "vermolen", "vermolach", "vermolung"]
    out = []
    for i in range(n):
        w = ["".join(rng.choice(syll) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(15, 60))]
        y = int(i % 4 == 0)
        if y:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        out.append((" ".join(w) + ".", y))
    return out


def test_toxicity_held_out_and_disguised():
    model = toxicity.train(toxic_docs(1, 700))
    test = toxic_docs(2, 300)
    s = [toxicity.score_text(t, model) >= toxicity.THRESHOLD for t, _ in test]
    assert sum(p for p, (_, y) in zip(s, test) if y) >= 0.95 * sum(y for _, y in test)
    assert sum(p for p, (_, y) in zip(s, test) if not y) <= 0.03 * sum(1 - y for _, y in test)
    for word in ("idiot", "i.d.i.o.t", "i d i o t", "id_iot", "1diot", "vermolheit"):
        assert toxicity.score_text(f"tharen ingou {word} estion", model) >= toxicity.THRESHOLD, word
    assert 0 <= toxicity.score_text(None, model) == toxicity.score_text("", model) < toxicity.THRESHOLD


def brute_kernel(a, b):
    """The normalized kernel, written out over all subsequences of three characters."""

    def phi(w):
        w = "^" + w + "^"
        out = Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    pa, pb = phi(a), phi(b)
    dot = lambda x, y: sum(x[u] * y[u] for u in x)
    return dot(pa, pb) / np.sqrt(dot(pa, pa) * dot(pb, pb))


def test_toxicity_scores_match_the_kernel():
    """Features, and the folded weights, give the same as the kernel written out."""
    words = ["idiot", "ixdiot", "aaaa", "banana", "x"]
    f = toxicity.features(words, toxicity._places(words))
    assert np.allclose(f @ f.T, [[brute_kernel(a, b) for a in words] for b in words])
    model = {"weights": np.zeros(toxicity.CLASSES**3), "bias": -0.25}
    word, u, value, norm = toxicity.subsequences(["idiot"])
    model["weights"][u] = value / norm
    assert np.allclose(toxicity.margins(words, model), [brute_kernel("idiot", w) - 0.25 for w in words])


def test_toxicity_is_not_a_matter_of_length():
    """A word repeated without spaces, or very long, is judged like its parts; text scores are those of the words one by one."""
    model = toxicity.train(toxic_docs(1, 700))
    for w in ("path", "tharen", "verprainst"):
        one = toxicity.score_text(w, model)
        assert one < toxicity.THRESHOLD
        for n in (2, 5, 20, 500):
            assert toxicity.score_text((w + "/") * n, model) < toxicity.THRESHOLD, (w, n)
    texts = [t for t, _ in toxic_docs(5, 40)] + ["tharen " * 3000 + "idiot", "x" * 5000, "", None]
    together = toxicity.score_texts(texts, model)
    for t, s in zip(texts, together):
        m = max((toxicity.margins([w], model)[0] for w in set(toxicity.words_of(t))), default=toxicity.FLOOR)
        assert np.isclose(s, 1 / (1 + np.exp(-(model["a"] * np.clip(m, -3, 3) + model["b"]))))
    assert together[40] >= toxicity.THRESHOLD


def test_platt_keeps_the_slope_finite_and_positive():
    y = np.array([0.0] * 90 + [1.0] * 10)
    for m in (np.where(y > 0, 2.0, -1.0), np.where(y > 0, -1.0, 2.0), np.zeros(100), np.where(y > 0, 1e-9, -1e-9)):
        a, b = toxicity.platt(m, y)
        assert 0 < a < 100 and abs(b) < 100
    a, b = toxicity.platt(np.where(y > 0, 2.0, -1.0), y)
    assert 1 / (1 + np.exp(-(2 * a + b))) > 0.8 and 1 / (1 + np.exp(a - b)) < 0.1
    assert toxicity.platt(np.array([1.0]), np.array([1.0])) == (4.0, 0.0)
    assert toxicity.combine([(None, np.empty(0), np.empty(0))]) is None


def test_toxicity_query_on_labelled_rows(spark):
    """The registered query on its whole tables: held-out recall and false alarms."""
    sf = "/root/testdata/sf0.1"
    got = toxicity.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    toxic, clean = got[got["toxic"] == 1], got[got["toxic"] == 0]
    # Measured: 101 of 120. Missed are repeated junk without any telling word, and a language with 22 toxic rows to learn from.
    assert len(toxic) >= 100 and toxic["predicted"].mean() >= 0.8 and clean["predicted"].mean() <= 0.03


def test_toxicity_query_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.train_on(odd_docs, labels) is None  # one class only
    out = toxicity.scores(odd_docs, None, "score")
    assert {r["score"] for r in out.collect()} == {0.0} and out.columns == [*odd_docs.columns, "score"]
    model = toxicity.train(toxic_docs(1, 300))
    assert toxicity.scores(odd_docs, model, "score").count() == odd_docs.count() and toxicity.scores(no_docs, model, "score").count() == 0
    held = odd_docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).where("doc_id is not null").collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)
