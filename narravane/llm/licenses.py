"""License scans: ordered signature rules behind a keyword gate, overlaps resolved by priority and containment.

A text is brought into normal form (words with one space between them), which
one translation of its bytes does.  The words of the text open the gate: a rule
is tried only if the text has one of the words that each of its matches has, so
nearly all texts try none.  All matches of the rules that are tried are found in
the whole text.  Kinds of rules have a priority; a match inside one of a kind
before it, inside a longer one of its own kind, or in the same place as one of a
rule before it, is dropped.  A match of an exclusion, which says that a license
is named but not given, only drops what it contains.

Cases: a null text counts as empty and has no words; texts are scanned whole,
whatever their length; equal rows have equal results; an empty table gives no
rows; columns beside id and text are ignored.  Null ids stay null.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.llm.license_rules import KINDS, Rule, rules

#: Phrases that are always labels, by their words.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: How sure a base phrase is.
BASE_SURE = 0.9

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


class Detection(NamedTuple):
    label: str
    kind: str
    start: int  # words, end exclusive
    end: int


@cache
def _base() -> re.Pattern[bytes]:
    return re.compile(rb"(?<![^ ])(?:" + b"|".join(p.encode() for p in BASE) + rb")(?![^ ])")


@cache
def _gate() -> dict[bytes, tuple[int, ...]]:
    """The places of the rules that a word lets through."""
    by_key: dict[bytes, list[int]] = {}
    for i, rule in enumerate(rules()):
        for key in rule.keys:
            by_key.setdefault(key, []).append(i)
    return {k: tuple(v) for k, v in by_key.items()}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _matches(text: bytes, tried: list[Rule]) -> Iterator[tuple[int, int, int]]:
    """(place of the rule among those tried, start, end) of every match; a rule's matches may overlap."""
    for i, rule in enumerate(tried):
        found = rule.pattern.search(text)
        while found:
            yield i, found.start(), found.end()
            after = text.find(b" ", found.start())
            found = rule.pattern.search(text, after + 1) if after >= 0 else None


def resolved(found: list[tuple[int, int, int]], kinds: list[int]) -> list[tuple[int, int, int]]:
    """The matches (rule, start, end) that stay; ``kinds`` gives the priority of each rule, the smallest first."""
    kept: list[tuple[int, int, int]] = []
    starts: list[int] = []
    reach: list[int] = []  # the farthest end of the kept ones up to each start
    for kind in sorted({kinds[m[0]] for m in found}):
        far, own = -1, []
        for match in sorted((m for m in found if kinds[m[0]] == kind), key=lambda m: (m[1], -m[2], m[0])):
            _, start, end = match
            k = bisect_right(starts, start)
            if end <= far or (k and reach[k - 1] >= end):
                continue
            far = end
            own.append(match)
        kept += own
        starts, reach, top = [], [], -1
        for _, start, end in sorted(kept, key=lambda m: m[1]):
            top = max(top, end)
            starts.append(start)
            reach.append(top)
    return kept


def find(text: bytes) -> tuple[int, list[tuple[str, int]], list[Detection]]:
    """The number of words, the base phrases as (label, first word), and the detections of the rules, in order."""
    words = words_of(text)
    distinct = set(words)
    if not (b"under" in distinct or b"version" in distinct or b"cc" in distinct) and _gate().keys().isdisjoint(distinct):
        return len(words), [], []
    plain = b" ".join(words)
    place = lambda offset: plain.count(b" ", 0, offset)
    base = [(BASE[m.group().decode()], place(m.start())) for m in _base().finditer(plain)]
    tried = [rules()[i] for i in sorted({i for w in _gate().keys() & distinct for i in _gate()[w]})]
    order = {kind: i for i, kind in enumerate(KINDS)}
    kept = resolved(list(_matches(plain, tried)), [order[r.kind] for r in tried])
    detections = [Detection(tried[i].label, tried[i].kind, place(s), place(e) + 1) for i, s, e in sorted(kept, key=lambda m: (m[1], m[2])) if tried[i].label]
    return len(words), base, detections


def sureness(base: list[tuple[str, int]], detections: list[Detection]) -> float:
    """How sure it is that the text gives a license: the chance that some label is right, by the surest sign of each."""
    best: dict[str, float] = {label: BASE_SURE for label, _ in base}
    for d in detections:
        best[d.label] = max(best.get(d.label, 0.0), KINDS[d.kind])
    wrong = 1.0
    for sure in sorted(best.values()):
        wrong *= 1.0 - sure
    return 1.0 - wrong


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch["text"].to_pylist():
            n, base, detections = find(text or b"")
            own = {label for label, _ in base}
            at = [w for _, w in base]
            shown = ",".join(f"{d.label}:{d.kind}:{d.start}:{d.end}" for d in detections)
            rows.append((n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {d.label for d in detections})), sureness(base, detections), shown))
        kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.string())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], [c.split()[0] for c in _SCHEMA.split(", ")])


def license_report(docs: DataFrame) -> DataFrame:
    """Base phrases, labels, sureness and detections (label:kind:start:end in words) of each text; see the contract of the query."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")).mapInArrow(_scan, _SCHEMA)
