"""URL filter: host and path rules, then naive Bayes over segmented host and path tokens.

A rule is a host and the start of a path; it fits its host and all subdomains,
and the longest fitting rule decides.  Other pages are judged by a method: each
host label is split into words by a unigram Viterbi segmentation (casinowin:
casino win), path parts are cut at non-letters, and a multinomial naive Bayes
classifier scores the tokens.

Training is weakly supervised: a page whose host has one of the seed words is an
unwanted example, any other page a wanted one; each seed word stands for some
unwanted pages beside, average ones but for the seed word, so that one that no
page has weighs too.  All tokens of an example count.  So the model knows the
seed words, the words that stand beside them (which block hosts without any seed
word), and the words of wanted hosts, which can outweigh a seed word among them.
Both classes count alike beforehand: how many pages of a crawl are unwanted says
nothing about a host.
Token counts are taken over all pages; tokens are hashed to a fixed number of
buckets, so the model is bounded.

The unigram model is the ranked word list of a public tokenizer's vocabulary
file, whose path is a parameter, and the seed words.

Cases: a url that is null or has no ``://`` has an empty host and path, fits no
rule and is allowed, as any page without known words; repeated
rows get equal results; ids may be null; other input columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narravane.llm.secrets import WORDS_PATH, ranked_words

#: Rules of the registered query: (verdict, host, start of the path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Words that mark a host as an unwanted training example.
SEEDS = frozenset(
    "casino poker gambling bet bets betting jackpot slots lottery adult porn xxx sex escort pills viagra pharma spam ads adserver "
    "banner popup tracker malware phishing warez torrent crack keygen loan payday".split()
)
#: Unwanted pages that each seed word stands for.
SEED_EXAMPLES = 3
BUCKETS = 1 << 16
_LABEL = re.compile(r"[^a-z0-9]+")


class Segmenter:
    """Unigram Viterbi segmentation of a lower-case name."""

    def __init__(self, ranks: dict[str, int]) -> None:
        harmonic = sum(1 / (r + 2) for r in ranks.values()) or 1.0
        self.cost = {w: math.log((r + 2) * harmonic) for w, r in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.unknown = math.log(harmonic * (len(ranks) + 2)) + 2.0

    def words(self, name: str) -> list[str]:
        """The cheapest split; unknown letters of a run stay together, digits are a word of their own."""
        out: list[str] = []
        for run in re.findall(r"[a-z]+|[^a-z]+", name):
            out += self._split(run) if run[0].isalpha() else [run]
        return out

    def _split(self, run: str) -> list[str]:
        n = len(run)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        open_cost, open_start = math.inf, 0  # an unknown word that ends here and may go on
        for j in range(1, n + 1):
            if best[j - 1] + self.unknown < open_cost:
                open_cost, open_start = best[j - 1] + self.unknown, j - 1
            open_cost += 2.5
            best[j], back[j] = open_cost, open_start
            for i in range(max(0, j - self.longest), j):
                c = self.cost.get(run[i:j])
                if c is not None and best[i] + c < best[j]:
                    best[j], back[j] = best[i] + c, i
        out, j = [], n
        while j:
            out.append(run[back[j] : j])
            j = back[j]
        return out[::-1]


@lru_cache(maxsize=2)
def segmenter(path: str) -> Segmenter:
    ranks = ranked_words(path)
    return Segmenter(dict.fromkeys(SEEDS, len(ranks)) | ranks)


def host_words(host: str, split: Segmenter) -> list[str]:
    """Words of all labels of a host but its last one and ``www``."""
    labels = host.partition(":")[0].split(".")
    return [w for label in labels[:-1] if label != "www" for part in _LABEL.split(label) if part for w in split.words(part)]


def tokens(host: str, path: str, split: Segmenter) -> list[str]:
    return [f"h:{w}" for w in host_words(host, split)] + [f"p:{w}" for w in re.findall(r"[a-z]+", path.lower())]


def unwanted(names: list[str]) -> bool:
    """Whether the tokens are an unwanted example: a word of the host is a seed word."""
    return any(t[:2] == "h:" and t[2:] in SEEDS for t in names)


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct of its text and verdict, or null."""
    fits = None
    for verdict, domain, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fit = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        hit = F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(fit, hit) if fits is None else fits.when(fit, hit)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


@dataclass
class Bayes:
    """Log odds (unwanted to wanted) of the token buckets."""

    odds: np.ndarray

    def score(self, names: list[str]) -> float:
        return sum(float(self.odds[_bucket(t)]) for t in names)


def train(pages: DataFrame, words_path: str = WORDS_PATH) -> Bayes:
    """Counts tokens by class over all ``pages`` (host, path)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = segmenter(words_path)
        for frame in frames:
            seen: Counter = Counter()
            for host, path in zip(frame["host"], frame["path"], strict=True):
                names = tokens(host, path, split)
                label = unwanted(names)
                seen[(-1, label)] += 1
                seen.update((_bucket(t), label) for t in names)
            yield pd.DataFrame([(b, l, n) for (b, l), n in seen.items()], columns=["bucket", "label", "n"])

    rows = pages.select("host", "path").mapInPandas(count, "bucket int, label boolean, n long").groupBy("bucket", "label").agg(F.sum("n").alias("n")).collect()
    counts, pages_seen = np.zeros((2, BUCKETS)), 0  # at most two rows a bucket
    for r in rows:
        if r.bucket < 0:
            pages_seen += r.n
        else:
            counts[int(r.label), r.bucket] = r.n
    counts[1] += SEED_EXAMPLES * len(SEEDS) * counts.sum(axis=0) / max(1, pages_seen)
    for seed in SEEDS:
        counts[1, _bucket(f"h:{seed}")] += SEED_EXAMPLES
    used = max(1, int((counts.sum(axis=0) > 0).sum()))
    smooth = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * used))
    return Bayes(np.where(counts.sum(axis=0) > 0, smooth[1] - smooth[0], 0.0))


def judged(pages: DataFrame, rules=RULES, words_path: str = WORDS_PATH) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, score) for each row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    model = train(parts, words_path)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = segmenter(words_path)
        for frame in frames:
            named = [tokens(h, p, split) for h, p in zip(frame["host"], frame["path"], strict=True)]
            frame["words"] = [" ".join(t[2:] for t in names if t[0] == "h") for names in named]
            frame["score"] = [model.score(names) for names in named]
            yield frame

    scored = parts.mapInPandas(score, "page_id long, host string, path string, words string, score double")
    scored = scored.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", by_method).alias("verdict"), "words", "score")
