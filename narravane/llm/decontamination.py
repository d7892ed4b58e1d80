"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to k edits, k being
``errors`` hundredths of m, rounded (none if that is below one).  It is cut into
pieces of q characters, at least k + 2 of them where it is long enough; an
occurrence within the budget holds at least as many pieces unchanged as there are
pieces beyond k, on diagonals at most k apart.  The pieces of a block of items
are a sorted array of hashes.  All q-grams of a text are hashed in numpy; those
that pass a bit table are looked up; places where enough hits stand on near
diagonals form windows, and Myers' bit-parallel algorithm gives the least edit
distance in each.

Texts and items are compared in lower case with each run of white space as one
space; positions are code points of the original text.  Items are a stated
query set: they are processed in blocks of bounded size, each block against all
documents, so neither the driver nor a task holds more than a block.  A piece
takes about 20 bytes, so a block is large and a test collection of usual size is
one block and one scan.

Cases: a null or blank item is skipped, a null or blank text has no match; an
item shorter than 100/``errors`` characters must occur exactly; an item longer
than a block is a block of its own; repeated items or documents give a row each;
other input columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.llm.textarrays import _POWERS, mix

#: Characters of test items that one pass over the documents takes.
BLOCK_CHARS = 20_000_000
#: Lengths of pieces; an item takes the largest that leaves enough of them.
PIECES = (1, 2, 3, 4, 5, 6, 8, 12, 24)
#: Characters of a text that are hashed in one step.
STEP = 1 << 18
#: Texts of one slice, in characters (a longer one is a slice of its own).
SLICE = 1 << 18
SCHEMA = "doc_id long, item_id long, distance int, start long, end long"

_SOLID = re.compile(r"\S+")
_U = np.uint64
_BITS = 22


def fold(text: str) -> str:
    """Lower case without change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(text: str) -> str:
    return " ".join(fold(text).split())


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a substring of ``text`` and where the first such substring ends.

    ``anchored``: the substring starts at the start of ``text``.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, at = score, j
        ph = (ph << 1 | anchored) & full
        pv = (mh << 1 & full) | (full & ~(xv | ph))
        mv = ph & xv
    return best, at


def budget(length: int, errors: int) -> int:
    """Edits that an item of this length may have."""
    return 0 if length * errors < 100 else (length * errors + 50) // 100


def piece_length(length: int, k: int) -> int:
    """The length of pieces of which there are two more than edits, or one more where the item is too short."""
    for pieces in (k + 2, k + 1):
        fitting = [q for q in PIECES if q * pieces <= length]
        if fitting:
            return fitting[-1]
    return 1


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_LETTER = mix(np.arange(1, (1 << 16) + 1, dtype=_U) * _U(0xD6E8FEB86659FD93))


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of ``q`` characters; equal runs have equal hashes wherever they stand."""
    n = len(codes)
    if n < q:
        return np.zeros(0, _U)
    value = _LETTER[codes & np.uint32(0xFFFF)]
    wide = codes > 0xFFFF
    if wide.any():
        value[wide] = mix(codes[wide].astype(_U) * _U(0x9E3779B97F4A7C15))
    up, down = _POWERS.get(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(value * up[:n], out=sums[1:])
    return (sums[q:] - sums[:-q]) * down[: n - q + 1]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _U(0x9E3779B97F4A7C15)) >> _U(64 - _BITS)


class Matcher:
    """Finds all items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], errors: int) -> None:
        self.items = []
        places: dict[int, list[tuple[int, int]]] = {}  # piece length: (item, offset)
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            k = budget(len(text), errors)
            q = piece_length(len(text), k)
            places.setdefault(q, []).extend((len(self.items), at * q) for at in range(len(text) // q))
            self.items.append((item_id, text, k))
        self.budgets = np.array([k for _, _, k in self.items], np.int64)
        self.lengths = np.array([len(t) for _, t, _ in self.items], np.int64)
        self.tables = []
        for q, entries in sorted(places.items()):
            item, offset = (np.array(x, np.int64) for x in zip(*entries, strict=True))
            own = {i: gram_hashes(_codes(self.items[i][1]), q) for i in set(item.tolist())}
            hashes = np.array([own[i][o] for i, o in entries], _U)
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[_bucket(hashes)] = True
            self.tables.append((q, hashes[order], item[order], offset[order], bits))
        # pieces beyond the budget stay unchanged
        self.least = np.array([max(1, len(t) // piece_length(len(t), k) - k) for _, t, k in self.items], np.int64)

    def _hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place, offset) of each piece that stands in ``codes``; ``offset`` is its place in the item."""
        found = [(np.zeros(0, np.int64),) * 3]
        for q, hashes, item, offset, bits in self.tables:
            for start in range(0, max(1, len(codes) - q + 1), STEP):
                grams = gram_hashes(codes[start : start + STEP + q - 1], q)
                at = np.flatnonzero(bits[_bucket(grams)])
                low, high = np.searchsorted(hashes, grams[at], "left"), np.searchsorted(hashes, grams[at], "right")
                n = high - low
                at, low, n = at[n > 0], low[n > 0], n[n > 0]
                if len(at):
                    which = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    found.append((item[which], np.repeat(at + start, n), offset[which]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item_id, distance, start, end) of the best match of each item in each text; positions in the normal form."""
        if not self.items:
            return []
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        item, place, offset = self._hits(_codes("\0".join(texts)))
        if not len(item):
            return []
        text = np.searchsorted(starts, place, "right") - 1
        diagonal = place - starts[text] - offset
        order = np.lexsort((diagonal, text, item))
        item, text, diagonal = item[order], text[order], diagonal[order]
        number = np.cumsum(np.concatenate(([False], (item[1:] != item[:-1]) | (text[1:] != text[:-1]))))
        # the hits of an item in a text, up to its budget of diagonals further on
        longest = int(self.lengths.max())
        key = number * (int(starts[-1]) + 3 * longest) + diagonal + longest
        good = np.flatnonzero(np.searchsorted(key, key + self.budgets[item], "right") - np.arange(len(key)) >= self.least[item])
        out = []
        for mine in np.split(good, np.flatnonzero(np.diff(number[good])) + 1) if len(good) else []:
            item_id, pattern, k = self.items[item[mine[0]]]
            t = int(text[mine[0]])
            best = self._best(pattern, k, np.unique(diagonal[mine]).tolist(), texts[t])
            if best:
                out.append((t, item_id, *best))
        return out

    @staticmethod
    def _best(pattern: str, k: int, diagonals: list[int], text: str) -> tuple[int, int, int] | None:
        """The best match with a piece on one of the rising ``diagonals``."""
        m = len(pattern)
        for s in diagonals:
            if s >= 0 and text.startswith(pattern, s):
                return 0, s, s + m
        if not k:
            return None
        best, i = None, 0
        while i < len(diagonals):
            j = i
            while j + 1 < len(diagonals) and diagonals[j + 1] - diagonals[j] <= m:
                j += 1
            low, high = max(0, diagonals[i] - k), diagonals[j] + m + k
            distance, end = myers(pattern, text[low:high])
            if distance <= k and (best is None or distance < best[0]):
                before = text[low : low + end][::-1]
                best = distance, low + end - myers(pattern[::-1], before[: m + k], anchored=True)[1], low + end
            i = j + 1
        return best


def _places(text: str) -> list[tuple[int, int]]:
    """Start of each word in the normal form and in the text itself."""
    at, out = 0, []
    for word in _SOLID.finditer(text):
        out.append((at, word.start()))
        at += word.end() - word.start() + 1
    return out


def _original(places: list[tuple[int, int]], position: int) -> int:
    at, start = places[bisect_right(places, (position, 1 << 62)) - 1]
    return start + position - at


def contaminated(docs: DataFrame, items: DataFrame, errors: int = 10) -> DataFrame:
    """(doc_id, item_id, distance, start, end): each item found in each document, at its best place."""
    if not 0 <= errors <= 30:
        raise ValueError("errors must be from 0 to 30 hundredths")
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL")
    items = items.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    # buckets of about half a block, joined to blocks; only the buckets' sizes reach the driver
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    items = items.withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(total * 2 // BLOCK_CHARS + 1)))
    found = None
    for block in _blocks(sorted((r.bucket, r.n) for r in items.groupBy("bucket").agg(F.sum(F.length("text")).alias("n")).collect())):
        some = [(r.item_id, r.text) for r in items.where(F.col("bucket").isin(block)).select("item_id", "text").collect()]
        rows = docs.mapInPandas(_search(some, errors), SCHEMA)
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else docs.limit(0).mapInPandas(_search([], errors), SCHEMA)


def _blocks(buckets: list[tuple[int, int]]) -> list[list[int]]:
    """Consecutive buckets of at most ``BLOCK_CHARS`` characters in all; a larger bucket stands alone."""
    out, size = [], BLOCK_CHARS + 1
    for bucket, n in buckets:
        if size + n > BLOCK_CHARS:
            out.append([])
            size = 0
        out[-1].append(bucket)
        size += n
    return out


def _search(items: list[tuple[int, str]], errors: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(items, errors)
        for frame in frames:
            texts, at = frame["text"].tolist(), 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= SLICE:
                    size += len(texts[end])
                    end += 1
                ids, some = frame["doc_id"].iloc[at:end].tolist(), texts[at:end]
                out, places = [], {}
                for t, item_id, distance, first, last in matcher.matches([normal(x) for x in some]):
                    where = places.setdefault(t, None) or _places(some[t])
                    places[t] = where
                    out.append((ids[t], item_id, distance, _original(where, first), _original(where, last - 1) + 1))
                if out:
                    table = pd.DataFrame(out, columns=["doc_id", "item_id", "distance", "start", "end"])
                    yield table.astype({"doc_id": "Int64", "item_id": "Int64"})
                at = end

    return run
