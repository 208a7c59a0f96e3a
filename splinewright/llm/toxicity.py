"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over all subsequences of three characters within `SPAN`
characters, the product of their decayed occurrences (DECAY to the power of the span),
and is normalized by both words' own kernels. Gaps and inserted characters therefore
weaken a match but don't break it, and neither length nor repetition within a word makes
it stronger; a word of more than `WINDOW` characters is judged by overlapping windows.
Landmarks are words of the labelled sentences; the machine is linear in the Nyström
features K(w, L) K(L, L)^(-1/2). As these are linear in the subsequence counts, the
fitted machine folds into one weight per subsequence.

It is trained on labelled sentences. Every sentence of a clean document is clean. A
toxic document's label says only that some of its sentences are toxic: those that hold a
word which chance would hardly put into toxic documents so often. These words are the
sentence's witnesses; in turns with the machine, those remain that the machine finds toxic,
and the worst one of each sentence. A sentence scores as its worst word, a document as its worst
sentence. The mean of `FOLDS` machines, each fitted without one part of the documents, is
the machine that scores; a logistic curve fitted on the margins of those parts, each by
the machine that didn't see it, turns its margins into scores.

Training takes a bounded sample of the labelled rows (`TRAIN_DOCS` of each class among
texts of up to `TRAIN_BYTES` bytes), drawn by a hash of the id and freed of near copies,
in one task on an executor, fold by fold. The model has a fixed size and goes out with the tasks.

Defined cases: a null or empty text scores as one without words; letters spelt out with
single spaces between them count as one word; equal texts score equally; without labelled
rows of both classes every score is 0; where a class is missing among the rows for the
logistic curve, a fixed one takes its place; of repeated ids one text is learnt; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table

TRAIN_DOCS = 3000
TRAIN_BYTES = 20_000
LANDMARKS = 320
SPAN, DECAY = 6, 0.6
THRESHOLD = 0.3
WINDOW = 32
CLASSES = 43
END = 42  # stands before and after each word
FLOOR = -3.0  # the margin of a text without words, and the lowest of any
WORDS = 4000  # words whose subsequences are held at a time
CACHE = 100_000  # words whose margins a worker remembers; affects time only
FOLDS = 4
FALSE_FINDS = 1.0
IMPURE = 0.1  # share of clean documents that may hold a telling word, per share of toxic ones
SLICE = 500  # texts scored at a time

#: Digits and signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Accented letters with a class of their own.
ACCENTED = "áàâäéèêëíîïóôöúùûüñçßœ"
#: Characters that take no room.
UNSEEN = "­​‌‍⁠﻿"

#: Punctuation and other signs leave a word's letters side by side.
_CLEAN = {c: None for c in range(33, 128) if not chr(c).isalpha()} | {ord(c): None for c in UNSEEN} | {ord(c): ord(x) for c, x in LOOKALIKES.items()}
_SPELT = re.compile(r"(?<!\S)\S(?: \S)+(?!\S)")
_SENTENCE = re.compile(r"[.!?|;]+(?=\s|$)|\n+")


def words_of(text: str | None) -> list[str]:
    """The text's words: lower case, look-alikes as letters, without signs, spelt-out ones joined, long ones in windows."""
    clean = _SPELT.sub(lambda m: m.group().replace(" ", ""), (text or "").lower().translate(_CLEAN))
    out = clean.split()
    if max(map(len, out), default=0) > WINDOW:
        step = WINDOW // 2
        out = [w[k : k + WINDOW] for w in out for k in range(0, max(1, len(w) - step), step)]
    return out


def _classes() -> np.ndarray:
    """Character class by code point: 1 to 26 letters, then accented ones, then all others."""
    out = np.full(0x3000, 40, np.int64)
    for k in range(26):
        out[ord("a") + k] = k + 1
    for k, c in enumerate(ACCENTED):
        out[ord(c)] = 27 + k % 13
    return out


_CLASS = _classes()


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, decayed occurrences) of all words' distinct subsequences, and each word's kernel norm."""
    lengths = np.array([len(w) + 2 for w in words])
    n = int(lengths.sum())
    c = np.full(n, END, np.int64)
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(n, bool)
    inner[starts] = inner[starts + lengths - 1] = False
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    c[inner] = _CLASS[np.minimum(code, len(_CLASS) - 1)]
    own = np.repeat(np.arange(len(words)), lengths)
    keys = []
    for b in range(2, SPAN):
        if n <= b:
            continue
        i = np.flatnonzero(own[:-b] == own[b:])
        for a in range(1, b):
            u = (c[i] * CLASSES + c[i + a]) * CLASSES + c[i + b]
            keys.append(((own[i] << 17) + u << 2) + (b - 2))
    keys = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    value = (DECAY ** np.arange(3, SPAN + 1))[keys & 3]
    place = keys >> 2
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.empty(0, np.int64)
    place, value = place[first], np.add.reduceat(value, first) if len(first) else value
    word, u = place >> 17, place & ((1 << 17) - 1)
    norm = np.sqrt(np.bincount(word, value * value, len(words)))
    return word, u, value, np.maximum(norm, 1e-9)


def margins(words: list[str], model: dict) -> np.ndarray:
    """The machine's margin of each word."""
    if not words:
        return np.empty(0)
    word, u, value, norm = subsequences(words)
    return np.bincount(word, model["weights"][u] * value, len(words)) / norm + model["bias"]


def features(words: list[str], place: np.ndarray) -> np.ndarray:
    """Normalized counts of the subsequences that have a place (not -1), one row a word."""
    out = np.zeros((len(words), place.max() + 1))
    word, u, value, norm = subsequences(words)
    at = place[u]
    out[word[at >= 0], at[at >= 0]] = value[at >= 0]
    return out / norm[:, None]


def _places(words: list[str]) -> np.ndarray:
    """A place for each subsequence of the words."""
    found = np.unique(subsequences(words)[1])
    place = np.full(CLASSES**3, -1)
    place[found] = np.arange(len(found))
    return place


def _disguised(words: list[str], rng) -> list[str]:
    """Each word with a letter inserted, and with one doubled."""
    out = []
    for w in words:
        k = int(rng.integers(1, len(w)))
        out += [w[:k] + chr(97 + int(rng.integers(26))) + w[k:], w[:k] + w[k - 1] + w[k:]]
    return out


def _sentences(text: str) -> list[list[str]]:
    found = ([w for w in words_of(s) if len(w) > 2] for s in _SENTENCE.split(text))
    return [s for s in found if s]


def _distinct(docs: list[tuple[str, int]]) -> list[tuple[str, list[list[str]], int]]:
    """(text, sentences, label) without documents of which a third or more was in earlier ones: copies say nothing new."""
    seen: set = set()
    one: dict = {}  # equal words are one object: most of a fold's memory would be copies of them
    out = []
    for text, y in docs:
        sentences = [[one.setdefault(w, w) for w in s] for s in _sentences(text or "")]
        words = [w for s in sentences for w in s]
        grams = {zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))}
        grams = {g for g in grams if g % 8 == 0} or grams  # by hash, an eighth says as much
        if words and len(grams & seen) * 3 < len(grams):
            out.append((text, sentences, y))
        seen |= grams
    return out


def _chance(k: int, n: int, share: float) -> float:
    """Chernoff's bound of the log probability of k or more toxic documents among n."""
    q = k / n
    if q <= share:
        return 0.0
    return -n * (q * np.log(q / share) + ((1 - q) * np.log((1 - q) / (1 - share)) if q < 1 else 0.0))


def _telling(docs) -> dict[str, float]:
    """Words that chance would hardly put into toxic documents so often, or that begin like such words, by how little."""
    n = Counter(y for *_, y in docs)
    df = {0: Counter(), 1: Counter()}
    for label in (1, 0):
        for _, sentences, y in docs:
            if y == label:
                own = {w for s in sentences for w in s}
                own |= {w[:k] + "*" for w in own for k in (4, 5) if len(w) > k}
                # Of clean documents only what toxic ones have is counted.
                df[y].update(own if y else own & df[1].keys())
    share = n[1] / (n[0] + n[1])
    chance = {w: _chance(k, k + df[0][w], share) for w, k in df[1].items() if k >= 3}
    least = np.log(FALSE_FINDS / max(1, len(chance)))
    pure = lambda w: df[0][w] * n[1] <= IMPURE * df[1][w] * n[0]
    sure = {w: p for w, p in chance.items() if p < least and pure(w)}
    out = {}
    for w in df[1]:
        p = sure.get(w, 0.0)
        if not df[0][w]:
            p = min(p, sure.get(w[:4] + "*", 0.0), sure.get(w[:5] + "*", 0.0))
        if p and w[-1] != "*":
            out[w] = p
    return out


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Linear support vector machine by dual coordinate descent; the last column of x is constant."""
    rng = np.random.default_rng(7)
    w, alpha, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1) + 1e-9
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), c[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the margin with Platt's smoothed labels: Newton steps that are halved until the loss falls.

    The slope is kept above zero; with a class missing, the curve is a fixed one.
    """
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    if not pos or not neg:
        return 4.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(w):
        z = m * w[0] + w[1]
        return float(np.sum(np.logaddexp(0, z) - t * z) + 1e-3 * w[0] ** 2)

    x = np.column_stack([m, np.ones(len(m))])
    w = np.array([1.0, float(np.log((pos + 1) / (neg + 1)))])
    best = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (p - t) + np.array([2e-3 * w[0], 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([2e-3 + 1e-9, 1e-9])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-10 and not (new := loss(w - size * step)) < best:
            size /= 2
        if size <= 1e-10:
            break
        done = best - new < 1e-10 * (1 + best)
        w, best = w - size * step, new
        if done:
            break
    return max(float(w[0]), 0.1), float(w[1])


def fold(docs: list[tuple[str, int]], k: int) -> tuple[dict | None, np.ndarray, np.ndarray]:
    """The machine of all (text, label) rows but those of part k, and the margins and labels of these."""
    docs = _distinct(docs)
    part = [zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS for text, *_ in docs]
    model = _machine([d for p, d in zip(part, docs) if p != k])
    held = [d for p, d in zip(part, docs) if p == k] if model else []
    return model, _text_margins([text for text, *_ in held], model, {}), np.array([y for *_, y in held], float)


def combine(folds: list[tuple[dict | None, np.ndarray, np.ndarray]]) -> dict | None:
    """The mean of the machines, which is again one weight per subsequence, and the curve of the margins of rows unseen."""
    folds = [f for f in folds if f[0]]
    if not folds:
        return None
    a, b = platt(np.concatenate([m for _, m, _ in folds]), np.concatenate([y for _, _, y in folds]))
    return {"weights": np.mean([m["weights"] for m, *_ in folds], axis=0), "bias": float(np.mean([m["bias"] for m, *_ in folds])), "a": a, "b": b}


def train(docs: list[tuple[str, int]]) -> dict | None:
    """The model of (text, label) rows, all folds in one place."""
    return combine([fold(docs, k) for k in range(FOLDS)])


def _machine(fit: list[tuple[str, list[list[str]], int]]) -> dict | None:
    """Weights and bias of the machine fitted on all these documents."""
    if len({y for *_, y in fit}) < 2:
        return None
    telling = _telling(fit)
    clean: Counter = Counter(w for _, sentences, y in fit if not y for s in sentences for w in s)
    # Toxic sentences: those of toxic documents with a telling word; their first witness is the most telling one.
    toxic = [s for _, sentences, y in fit if y for s in sentences if any(w in telling for w in s)]
    if not toxic:
        return None
    witness = Counter(w for s in toxic for w in s if w in telling)
    vocabulary = sorted(clean)
    common = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))[:1500]]
    rng = np.random.default_rng(11)
    pool = sorted(set(clean) - set(common))
    rare = [pool[k] for k in rng.choice(len(pool), min(3000, len(pool)), replace=False)] if pool else []
    negatives = common + rare
    marks = [w for w, _ in sorted(witness.items(), key=lambda x: (-x[1], x[0]))[: LANDMARKS * 3 // 4]]
    marks = marks + common[: LANDMARKS - len(marks)]
    place = _places(marks)
    f_marks = features(marks, place)
    val, vec = np.linalg.eigh(f_marks @ f_marks.T)
    good = val > 1e-6 * val[-1]
    root = vec[:, good] / np.sqrt(val[good])  # K^(-1/2) on its range

    def project(words):
        rows = [features(words[k : k + 128], place) @ f_marks.T for k in range(0, len(words), 128)]
        return np.vstack(rows) @ root

    model: dict = {}
    neg = project(negatives)
    for turn in range(6):
        known = sorted(witness, key=lambda w: (-witness[w], w))[:900]
        strange = _disguised([w for w in known if len(w) > 1], rng)
        x = np.vstack([project(known + strange), neg])
        x = np.hstack([x, np.ones((len(x), 1))])
        y = np.concatenate([np.ones(len(known) + len(strange)), -np.ones(len(neg))])
        w = _svm(x, y, np.where(y > 0, 300.0, 100.0))
        weights = np.zeros(CLASSES**3)
        weights[place >= 0] = (f_marks.T @ (root @ w[:-1]))[place[place >= 0]]
        model = {"weights": weights, "bias": float(w[-1])}
        # Words of clean sentences that come too near join the negatives.
        margin = np.concatenate([margins(vocabulary[k : k + WORDS], model) for k in range(0, len(vocabulary), WORDS)]) if vocabulary else np.empty(0)
        near = [vocabulary[k] for k in np.argsort(-margin, kind="stable")[:6000] if margin[k] > -0.9]
        had = set(negatives)
        fresh = [x for x in near if x not in had and x not in telling][:1500]
        # A toxic sentence's witnesses are from now on those that the machine finds toxic, its worst one at least.
        margin = dict(zip(telling, margins(list(telling), model)))
        before, witness = witness, Counter()
        for s in toxic:
            own = [w for w in s if w in telling]
            worst = max(margin[w] for w in own)
            witness.update(w for w in own if margin[w] > 0 or margin[w] == worst)
        if turn and not fresh and witness == before:
            break
        if fresh:
            negatives = negatives + fresh
            neg = np.vstack([neg, project(fresh)])
    return model


def _text_margins(texts: list[str | None], model: dict, known: dict) -> np.ndarray:
    """Each text's worst word. known: margins of words so far, which this adds to."""
    out = np.full(len(texts), FLOOR)
    for at in range(0, len(texts), SLICE):
        own = [set(words_of(t)) for t in texts[at : at + SLICE]]
        if len(known) > CACHE:
            known.clear()
        fresh = list({w for ws in own for w in ws if w not in known})
        for k in range(0, len(fresh), WORDS):
            part = fresh[k : k + WORDS]
            known.update(zip(part, margins(part, model).tolist()))
        for k, ws in enumerate(own):
            if ws:
                out[at + k] = max(map(known.__getitem__, ws))
    return np.clip(out, FLOOR, -FLOOR)


def score_texts(texts: list[str | None], model: dict | None, known: dict | None = None) -> np.ndarray:
    if not model:
        return np.zeros(len(texts))
    z = model["a"] * _text_margins(texts, model, {} if known is None else known) + model["b"]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score_text(text: str | None, model: dict | None) -> float:
    return float(score_texts([text], model)[0])


def held_out(doc_id) -> "F.Column":
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train_on(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model of labelled rows outside the held-out fold."""
    y = labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    short = docs.where(F.octet_length("text") <= TRAIN_BYTES)
    y = y.join(short.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    picked = y.where("toxic = 1").orderBy(order, "doc_id").limit(TRAIN_DOCS).unionAll(y.where("toxic = 0").orderBy(order, "doc_id").limit(TRAIN_DOCS))
    # At most 2 * TRAIN_DOCS ids, each with one text.
    rows = short.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def fit(batches):
        parts = [b for b in batches if len(b)]
        if parts:
            rows = pd.concat(parts, ignore_index=True).sort_values(["place", "doc_id"])
            docs = list(zip(rows["text"], rows["toxic"].astype(int)))
            for k in range(FOLDS):  # one after the other: two at once would need twice the memory
                model, m, y = fold(docs, k)
                if model:
                    yield pd.DataFrame({"fold": [k], "weights": [model["weights"].tobytes()], "bias": [model["bias"]], "m": [m.tobytes()], "y": [y.tobytes()]})

    # FOLDS models come back, and a margin for each row.
    found = rows.select("doc_id", "toxic", "text", order.alias("place")).repartition(1).mapInPandas(fit, "fold int, weights binary, bias double, m binary, y binary").collect()
    found = sorted(found, key=lambda r: r["fold"])
    return combine([({"weights": np.frombuffer(r["weights"]), "bias": r["bias"]}, np.frombuffer(r["m"]), np.frombuffer(r["y"])) for r in found])


def scores(docs: DataFrame, model: dict | None, column: str) -> DataFrame:
    """Adds a score to every row; other columns pass through."""
    known: dict = {}  # a worker's own, filled as it scores

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.tolist(), model, known), dtype="float64")

    return docs.withColumn(column, score(F.col("text")))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train_on(docs, table(spark, sf_dir, "labels"))
    out = scores(docs.select("doc_id", "text"), model, "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES = {}
