"""Secret scan: fixed patterns, and values in credential contexts that are hard to guess.

A value that follows a credential word is scored by a guess-cost dynamic
programme in the way of password strength estimators: the cheapest segmentation
into dictionary words, dates, repeats, keyboard walks and sequences, and
brute-force spans.  A value that needs at least 10**``least`` guesses counts as
a secret (kind ``guess``); placeholders and plain words cost less.

The dictionary is a ranked word list, taken from a public tokenizer's
vocabulary file whose path is a parameter.

Cases: null and empty texts have no spans; repeated rows get equal results;
very long texts and values are scanned whole, in time that grows with their
length; other input columns are ignored
(report) or kept (redaction).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from narravane.llm.spans import Span, outside, redacted, report

WORDS_PATH = "/opt/tokenizers/word_bpe_49k.json"
#: Decimal logarithm of the guesses from which a value counts as a secret.
LEAST = 10.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private|client|encryption|signing)[_\x20-]?(?:key|secret|token))"""
    r"""["']?\x20*(?:[:=]|\bis\b)\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;<>()\[\]{}]+))""",
    re.I | re.A,
)
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)", re.A)
_SUBSTITUTES = str.maketrans("4@310$57", "aaeiosst")
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (x + 0.5 * y, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
#: A context match holds one of these in lower case.
_STEMS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key")
_DIGIT, _LETTER = re.compile(r"\d"), re.compile(r"[^\W\d_]")
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*range(48, 58), *range(97, 103)]] = True
#: Guesses from which a value of several words counts as a secret, and not as prose.
LEAST_PHRASE = 20.0
#: Cost of a further segment: one more choice to guess.
_JOIN = math.log10(2)


@lru_cache(maxsize=2)
def ranked_words(path: str) -> dict[str, int]:
    """Rank of each whole word of three letters or more in the order of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (w.removesuffix("</w>") for w, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if w.endswith("</w>"))
    ranks: dict[str, int] = {}
    for w in words:
        if len(w) >= 3 and w.isalpha():
            ranks.setdefault(w, len(ranks) + 1)
    return ranks


@lru_cache(maxsize=2)
def word_list(path: str) -> Words:
    return Words.of(ranked_words(path))


def _character(c: str) -> float:
    """Cost of a brute-force character by the size of its class."""
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isalpha() else math.log10(33)


@dataclass(frozen=True)
class Words:
    """A ranked word list with the prefixes of its words and of their reversals."""

    ranks: dict[str, int]
    prefixes: frozenset[str]
    reversed_prefixes: frozenset[str]

    @classmethod
    def of(cls, ranks: dict[str, int]) -> Words:
        cut = lambda word: (word[:k] for k in range(1, len(word) + 1))
        return cls(ranks, frozenset(p for w in ranks for p in cut(w)), frozenset(p for w in ranks for p in cut(w[::-1])))


def _case_cost(upper: int, length: int, first: bool) -> float:
    """Choices of the upper-case letters of a word."""
    if upper and upper < length and not (upper == 1 and first):
        return math.log10(sum(math.comb(length, i) for i in range(1, min(upper, length - upper) + 1)))
    return _JOIN if upper else 0.0


class _Value:
    """The segments of a value, by their first character.

    A repeat, walk or sequence goes on to the end of its run, or starts with its run (a repeat: in the first unit);
    so there are as many of each kind as characters, a few times over, and not as many as pairs of them.
    """

    def __init__(self, value: str, words: Words) -> None:
        self.value, self.words, self.n = value, words, len(value)
        low = value.lower()
        # a lower-case form of other length would shift the places
        self.low = low if len(low) == self.n else value
        self.plain = self.low.translate(_SUBSTITUTES)
        self.upper = list(accumulate((c.isupper() for c in value), initial=0))
        self.letters = list(accumulate(map(_character, value), initial=0.0))
        self.repeats = [0] * 17  # characters that equal the one a unit on, from the current place
        self.walk = self.turns = self.same_step = 0

    def word(self, i: int, j: int) -> float | None:
        """Cost of value[i:j] as a word: plain, backwards or with substitutes."""
        ranks, best = self.words.ranks, None
        for form, extra in ((self.low[i:j], 0.0), (self.low[i:j][::-1], _JOIN), (self.plain[i:j], 2 * _JOIN)):
            rank = ranks.get(form)
            if rank and (best is None or math.log10(rank) + extra < best):
                best = math.log10(rank) + extra
        return None if best is None else best + _case_cost(self.upper[j] - self.upper[i], j - i, self.value[i].isupper())

    def _word_ends(self, i: int) -> set[int]:
        ends = set()
        for text, prefixes in ((self.low, self.words.prefixes), (self.plain, self.words.prefixes)):
            j = i + 1
            while j <= self.n and text[i:j] in prefixes:
                ends.add(j)
                j += 1
        # a word backwards ends in value[i]: its reversal starts there
        j = i + 1
        while j <= self.n and self.low[i:j] in self.words.reversed_prefixes:
            ends.add(j)
            j += 1
        return {j for j in ends if j - i >= 3}

    def segments(self, i: int) -> Iterator[tuple[int, float]]:
        """(end, cost) of the segments from ``i``; to be called for falling places, from the last on."""
        value, n = self.value, self.n
        for j in self._word_ends(i):
            if (cost := self.word(i, j)) is not None:
                yield j, cost
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            yield m.end(), math.log10(365 * 80 if m.end() - i > 4 else 80)
        yield from self._walks(i)
        yield from self._sequences(i)
        for unit in range(1, 17):
            self.repeats[unit] = self.repeats[unit] + 1 if i + unit < n and value[i] == value[i + unit] else 0
            count = self.repeats[unit] // unit + 1
            if count >= (3 if unit == 1 else 2):
                inner = self.letters[i + unit] - self.letters[i]
                inner = min(inner, (self.word(i, i + unit) if unit >= 3 else None) or inner)
                first = i < unit or value[i - unit : i] != value[i : i + unit]
                for k in range(3 if unit == 1 else 2, count + 1) if first else (count,):
                    yield i + k * unit, inner + math.log10(k)

    def _step(self, i: int) -> tuple[float, int] | None:
        """Direction of a keyboard walk from place ``i`` to the next, if the keys are neighbours."""
        if not 0 <= i < self.n - 1 or self.low[i] == self.low[i + 1]:
            return None
        here, there = _PLACE.get(self.low[i]), _PLACE.get(self.low[i + 1])
        if not here or not there or max(abs(there[0] - here[0]), abs(there[1] - here[1])) > 1:
            return None
        return there[0] - here[0], there[1] - here[1]

    def _walks(self, i: int) -> Iterator[tuple[int, float]]:
        step = self._step(i)
        if not step:
            self.walk = self.turns = 0
            return
        self.turns = 1 if not self.walk else self.turns + (self._step(i + 1) != step)
        self.walk += 1
        if self.walk < 2:
            return
        cost = lambda keys, turns: math.log10(47) + turns * math.log10(5) + math.log10(keys)
        if self._step(i - 1):
            yield i + self.walk + 1, cost(self.walk + 1, self.turns)
            return
        turns, last = 1, step
        for k in range(1, self.walk):
            now = self._step(i + k)
            turns, last = turns + (now != last), now
            yield i + k + 2, cost(k + 2, turns)

    def _rise(self, i: int) -> int:
        """1 or -1 where the next character is the one after or before this in its alphabet, else 0."""
        if not 0 <= i < self.n - 1 or not (self.low[i].isalnum() and self.low[i + 1].isalnum()):
            return 0
        rise = ord(self.low[i + 1]) - ord(self.low[i])
        return rise if abs(rise) == 1 else 0

    def _sequences(self, i: int) -> Iterator[tuple[int, float]]:
        rise = self._rise(i)
        self.same_step = 0 if not rise else self.same_step + 1 if self._rise(i + 1) == rise else 1
        if self.same_step < 2:
            return
        cost = lambda keys: _character(self.low[i]) + (_JOIN if rise < 0 else 0.0) + math.log10(keys)
        for k in (self.same_step,) if self._rise(i - 1) == rise else range(2, self.same_step + 1):
            yield i + k + 1, cost(k + 1)


def guess_costs(value: str, words: Words) -> list[float]:
    """Decimal logarithm of the guesses of the cheapest segmentation of each suffix of ``value``."""
    n = len(value)
    tail = [math.inf] * n + [-_JOIN]  # a segment that ends the value joins nothing
    brute = math.inf  # the first segment is a brute-force span
    parts = _Value(value, words)
    for i in range(n - 1, -1, -1):
        brute = _character(value[i]) + min(brute, _JOIN + tail[i + 1])
        best = brute
        for end, cost in parts.segments(i):
            cost += _JOIN + tail[end]
            if cost < best:
                best = cost
        tail[i] = best
    return tail[:n]


def guess_cost(value: str, words: Words) -> float:
    """Decimal logarithm of the guesses of the cheapest segmentation of ``value``."""
    return guess_costs(value, words)[0] if value else 0.0


def _long_hex(text: str) -> bool:
    """Whether 24 hexadecimal digits stand in a row; a quick test for the whole text."""
    other = np.flatnonzero(~_HEX_BYTE[np.frombuffer(text.encode(), np.uint8)])
    if not len(other):
        return len(text) >= 24
    return other[0] >= 24 or len(text.encode()) - 1 - other[-1] >= 24 or bool((np.diff(other) > 24).any())


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping for each kind."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _long_hex(text):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def guessed_spans(text: str, words: Words, least: float = LEAST) -> list[Span]:
    """Values in credential contexts that need at least 10**``least`` guesses.

    A context may stand inside the value of another one; it is looked at if that value is no secret.  Such values end
    at one place, so the costs of the suffixes of the outer one are used again.
    """
    out: list[Span] = []
    at, known, known_end, costs = 0, -1, -1, []
    while m := _CONTEXT.search(text, at):
        group = m.lastindex or 3
        start, value = m.start(group), m[group]
        kept = value.rstrip(".,:!?") if group == 3 else value
        end = start + len(kept)
        at = max(start, m.start() + 1)
        said = text[max(m.start(), start - 8) : start].rstrip(" \"'").lower().endswith("is")
        mixed = _DIGIT.search(kept) and _LETTER.search(kept)
        if len(kept) < 6 or (said and not mixed):
            continue
        if not (end == known_end and start >= known):
            known, known_end, costs = start, end, guess_costs(kept, words)
        if costs[start - known] >= (LEAST_PHRASE if " " in kept else least):
            out.append(("guess", start, end))
            at = end
    return out


def finder(words_path: str = WORDS_PATH, least: float = LEAST):
    """A function from a text to its base spans and its added spans."""
    words = word_list(words_path)

    def find(text: str) -> tuple[list[Span], list[Span]]:
        base, low = base_spans(text), text.lower()
        if not any(stem in low for stem in _STEMS):
            return base, []
        return base, outside(guessed_spans(text, words, least), base)

    return find


def secret_report(docs: DataFrame, words_path: str = WORDS_PATH, least: float = LEAST) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans) for each row of ``docs``."""
    return report(docs, partial(finder, words_path, least), ("assign", "access", "hex"), ("guess",))


def without_secrets(docs: DataFrame, words_path: str = WORDS_PATH, least: float = LEAST) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``[SECRET]``."""
    return redacted(docs, partial(finder, words_path, least), lambda kind: "[SECRET]")
