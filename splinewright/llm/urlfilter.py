"""URL filter: rules for hosts and path beginnings, and a trained scorer for the rest.

Method: host word segmentation. Names in the host are split at punctuation, then each
concatenated name is split into words by unigram Viterbi; multinomial naive Bayes scores
the words of host and path. The unigram counts are those of the labelled names below plus,
with as much weight in all, the delimited tokens of all urls given, counted whole by
Spark. A token is a word from a share of `WORD_SHARE` of all tokens on, so at most
1 / WORD_SHARE words are held however many urls there are; a label of a host that nothing
divides is no token: that it occurs doesn't make it a word. So verdicts follow the tokens'
shares, not the number of urls. For scoring, accents go and digits inside a word count as
the letters that they look like. Rules win over the scorer: the longest rule that fits.

Defined cases: a null url, or one without `://`, has an empty host and path and is
allowed, as is one without any known word; names of any length are read whole, in time
proportional to it, though no word has over `LONGEST` letters; user info and ports stay in the host as
written; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, table

WORD_SHARE = 2e-6
LONGEST = 24

#: Digits that stand for letters.
LOOKALIKES = str.maketrans("0134579", "oieastg")

#: The rules of the query, as (verdict, rule).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

#: Labelled names from which the scorer learns.
BLOCK_NAMES = """
adult adult-x adult-video adult-chat adult-dating xxx xxx-tube xxx-movies porn porn-hub free-porn porn-tube sex sex-cam
live-sex sex-shop nude nude-girls naked-cams webcam-girls erotic erotic-chat escort escort-girls hentai fetish milf
cheap-pills cheap-meds buy-pills pills pills-online viagra buy-viagra cialis cheap-cialis online-pharmacy-deals
casino online-casino casino-bonus best-casino poker online-poker free-poker slots free-slots jackpot-slots roulette
betting sports-betting bet-now bookmaker gambling payday-loans fast-loans cash-loans easy-money make-money get-rich
win-prize free-prize free-iphone claim-reward replica-watches fake-rolex cheap-replica warez cracked-software crack-keygen
torrent free-torrent illegal-stream phishing malware spyware scam miracle-diet weight-loss-pills hot-singles spam click-bait
""".split()
ALLOW_NAMES = """
blog my-blog tech-blog news daily-news world-news local-news weather sports-news science journal science-journal magazine
library city-library museum school high-school college university research institute hospital clinic health health-care
pharmacy doctor recipes cooking kitchen garden home-garden travel hotels city-guide map transport railway airport music
music-school film theatre art art-gallery photo books book-store shop online-shop store market bank insurance energy
wiki encyclopedia dictionary forum help support docs developer software open-source data cloud mail web www m static
government council court law police parliament community church charity family kids toys games football cycling running
history nature animals planet space history-museum english french german spanish en fr de es index page article post
""".split()


def split_url(url: str | None) -> tuple[str, str]:
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def compile_rules(rules: list[tuple[str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    """Rules by their host, longest first: (path, verdict, rule)."""
    out: dict = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, verdict, rule))
    for host in out:
        out[host].sort(key=lambda r: -len(r[0]))
    return out


def match_rule(host: str, path: str, rules: dict) -> tuple[str, str] | None:
    """(verdict, rule) of the longest rule that fits the host or a domain above it, and the path."""
    best = None
    labels = host.split(".")
    for k in range(len(labels)):
        for start, verdict, rule in rules.get(".".join(labels[k:]), ()):
            if path.startswith(start) and (best is None or len(rule) > len(best[1])):
                best = (verdict, rule)
    return best


class Segmenter:
    """Splits concatenated names into known words by unigram Viterbi."""

    def __init__(self, counts: Counter):
        self.total = sum(counts.values()) or 1
        self.cost = {w: -math.log(c / self.total) for w, c in counts.items()}
        self.longest = max(map(len, counts), default=1)
        self.cache: dict[str, list[str]] = {}

    def _unknown(self, n: int) -> float:
        return math.log(self.total) + 2.5 * n

    def split(self, name: str) -> list[str]:
        if name in self.cache:
            return self.cache[name]
        best = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            # A stretch of any length may be unknown; only known words up to the longest are tried.
            options = [(best[end - 1][0] + self._unknown(1) - (math.log(self.total) if end > 1 and best[end - 1][1] < 0 else 0), -(end - 1) - 1)]
            for start in range(max(0, end - self.longest), end):
                cost = self.cost.get(name[start:end])
                if cost is not None:
                    options.append((best[start][0] + cost, start))
            best.append(min(options, key=lambda o: (o[0], -o[1])))
        out, end = [], len(name)
        while end:
            start = best[end][1]
            if start < 0:  # one more unknown character
                start = -start - 1
                if out and out[-1][0]:
                    out[-1] = (True, name[start:end] + out[-1][1])
                else:
                    out.append((True, name[start:end]))
            else:
                out.append((False, name[start:end]))
            end = start
        words = [w for _, w in reversed(out)]
        if len(self.cache) < 100_000:
            self.cache[name] = words
        return words


def train(names: Counter) -> dict:
    """Unigram counts, and naive Bayes log odds of block against allow, with add-one smoothing."""
    seeds = {"block": [w for n in BLOCK_NAMES for w in n.split("-")], "allow": [w for n in ALLOW_NAMES for w in n.split("-")]}
    counts: Counter = Counter({w: 50 for ws in seeds.values() for w in ws if len(w) > 1})
    plain, known = Segmenter(counts), set(counts)
    # The urls' tokens weigh as much as the labelled names together, however many there are.
    share = plain.total / (sum(names.values()) or 1)
    for w, c in names.items():
        parts = plain.split(w)
        # A name that known words make up entirely is not a word itself.
        if len(w) > LONGEST:
            continue
        if len(parts) == 1 or not all(len(x) > 2 and x in known for x in parts):
            counts[w] += c * share
    by = {k: Counter(ws) for k, ws in seeds.items()}
    vocab = set(by["block"]) | set(by["allow"])
    odds = {w: math.log((by["block"][w] + 1) / (sum(by["block"].values()) + len(vocab))) - math.log((by["allow"][w] + 1) / (sum(by["allow"].values()) + len(vocab))) for w in vocab}
    prior = math.log(0.2 / 0.8)
    return {"counts": counts, "odds": odds, "prior": prior}


def words_of(host: str, path: str, segment: Segmenter) -> list[str]:
    return [w for t in [*plain_tokens(host), *plain_tokens(path)] for w in segment.split(t)]


def plain_tokens(text: str) -> list[str]:
    """Runs of letters, accents taken off; digits between letters as the letters that they look like, others apart."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    plain = re.sub(r"(?<=[a-z])[0134579]+(?=[a-z])", lambda m: m.group().translate(LOOKALIKES), plain)
    return re.findall(r"[a-z]+", plain)


def judge(url: str | None, rules: dict, segment: Segmenter, model: dict) -> tuple:
    host, path = split_url(url)
    log_odds = model["prior"] + sum(model["odds"].get(w, 0.0) for w in words_of(host, path, segment))
    hit = match_rule(host, path, rules)
    verdict = hit[0] if hit else ("block" if log_odds > 0 else "allow")
    return host, path, hit[1] if hit else None, verdict, log_odds


def url_tokens(pages: DataFrame, url_col: str) -> Counter:
    """Counts of the delimited tokens of all urls, but for labels of hosts that are one token."""
    url = F.lower(F.col(url_col))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    divided = F.filter(F.split(host, r"\."), lambda x: x.rlike("^[a-z]+([_-][a-z]+)+$"))
    rest = F.regexp_replace(url, r"(?s)^.*?://[^/?#]*", "")
    text = F.concat_ws(" ", divided, rest)
    token = F.explode(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}])([a-z]{2,})(?![\p{L}\p{N}])"), 1))
    counts = Workspace(pages.sparkSession, "urls").stage(pages.where(url.contains("://")).select(token.alias("w")).groupBy("w").count(), "tokens")
    total = counts.agg(F.sum("count")).first()[0] or 0
    rows = counts.where(F.col("count") >= WORD_SHARE * total).collect()  # 1 / WORD_SHARE rows at most
    return Counter({r["w"]: r["count"] for r in sorted(rows)})


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, log_odds."""
    model = train(url_tokens(pages, url_col))
    compiled = compile_rules(rules)

    def run(batches):
        segment = Segmenter(model["counts"])
        for batch in batches:
            rows = [judge(u, compiled, segment, model) for u in batch["u"]]
            out = pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "log_odds"])
            out.insert(0, "page_id", batch["i"].astype("Int64").to_numpy())
            yield out.astype({"page_id": "Int64"})

    src = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"))
    return src.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string, log_odds double")


def op5_urls(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op5_urls": op5_urls}
ORACLES = {}
