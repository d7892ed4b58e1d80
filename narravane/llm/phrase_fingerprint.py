"""Document fingerprints from Lempel-Ziv phrases.

Each text is parsed, left to right over its UTF-8 bytes, into the phrases of an
LZ78 dictionary: the next phrase is the longest one known plus one byte.  Texts
that compress well together share phrases.  The set of phrase hashes is reduced
to a one-permutation minimum-hash signature, and the share of equal positions
of two signatures estimates the Jaccard similarity of the phrase sets.

``with_next`` also fingerprints an edited form of each text, and compares with
the next document in descending order of doc_id.  One shuffle deals the texts
into ranges of that order.  A range judges all of its rows but the last, whose
next document is the first row of the following range: these pairs, one a range,
are joined from the ends of the ranges, which are read from the same shuffle.

Cases: null and empty texts have the empty fingerprint, which is like itself
(1.0) and unlike others (0.0); the next document of a single one is itself;
rows with equal or null doc_id follow each other in the order of a text hash,
null ids last; very long texts are parsed whole; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.llm.textarrays import span_hashes

#: Positions of a signature; each holds 16 bits.
POSITIONS = 128
#: Rows of a doc_id range, about.
RANGE_ROWS = 8_000
#: Bytes of text that are hashed in one numpy step.
STEP_BYTES = 1 << 20

_U = np.uint64
_EMPTY = np.uint32(0xFFFFFFFF)


def parse(text: bytes, known: set[bytes], start: int = 0, limit: int | None = None) -> tuple[list[int], int]:
    """Ends of the new phrases from ``start``, and where the parse stopped.

    With a ``limit`` it stops before the first phrase that would end behind it.
    Phrases are added to ``known``, whose members' prefixes are members too.
    """
    ends: list[int] = []
    i, n, k = start, len(text), 3
    stop = n if limit is None else limit
    while i < n:
        j = i + k
        if text[i:j] in known:
            j += 1
            while j <= n and text[i:j] in known:
                j += 1
        else:
            while j - 1 > i and text[i : j - 1] not in known:
                j -= 1
        if j > n:  # the rest is a known phrase
            return ends, n if limit is None else i
        if j > stop:
            return ends, i
        known.add(text[i:j])
        ends.append(j)
        k = j - i
        i = j
    return ends, i


def signatures(hashes: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """One-permutation minimum-hash signatures, (owners x POSITIONS) of 16 bits; positions without a hash borrow from the next one."""
    least = np.full((owners, POSITIONS), _EMPTY, np.uint32)
    place = (hashes >> _U(57)).astype(np.int64) % POSITIONS
    np.minimum.at(least.ravel(), owner * POSITIONS + place, ((hashes >> _U(20)) & _U(0xFFFFFFFE)).astype(np.uint32))
    full = least != _EMPTY
    where = np.where(np.hstack((full, full)), np.arange(2 * POSITIONS), 4 * POSITIONS)
    source = np.minimum.accumulate(where[:, ::-1], axis=1)[:, ::-1][:, :POSITIONS]
    some = full.any(axis=1)
    gap = np.where(some[:, None], source - np.arange(POSITIONS), 0)
    value = np.take_along_axis(least, source % POSITIONS, axis=1).astype(_U)
    value = (value + gap.astype(_U) * _U(0x9E3779B97F4A7C15)) * _U(0xD6E8FEB86659FD93)
    out = (value >> _U(48)).astype(np.uint16)
    out[~some] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _edit(text: str, after: str) -> tuple[str, int]:
    """``text`` with its last half replaced by the start of ``after``, and how many characters stayed."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half], len(text) - half


class _Step:
    """Texts whose fingerprints are made together; the last one may only be looked at."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size = 0
        self.spans: list[tuple[int, list[int], int]] = []  # offset of a part, ends in it, first start
        self.members: list[list[tuple[int, int]]] = []  # for each owner: span and how many of its phrases

    def add(self, part: bytes, ends: list[int], start: int) -> int:
        self.spans.append((self.size, ends, start))
        self.parts.append(part)
        self.size += len(part)
        return len(self.spans) - 1

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of the owners, and whether they have a phrase at all."""
        counts = [len(e) for _, e, _ in self.spans]
        first = np.concatenate(([0], np.cumsum(counts)))
        ends = np.array([e + at for at, es, _ in self.spans for e in es], np.int64)
        starts = np.empty_like(ends)
        starts[1:] = ends[:-1]
        for (at, _, start), f, c in zip(self.spans, first[:-1], counts, strict=True):
            if c:
                starts[f] = at + start
        hashes = span_hashes(np.frombuffer(b"".join(self.parts), np.uint8), starts, ends)
        pieces, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for o, spans in enumerate(self.members):
            for s, c in spans:
                pieces.append(np.arange(first[s], first[s] + c))
                owner.append(np.full(c, o))
        index, owner = np.concatenate(pieces), np.concatenate(owner)
        filled = np.bincount(owner, minlength=len(self.members)) > 0
        return signatures(hashes[index], owner, len(self.members)), filled


def _rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results of all but the last of ``texts``, each with the following one as its next document."""
    step = _Step()
    edited, n = [], len(texts) - 1
    for i, text in enumerate(texts):
        raw = text.encode()
        if i == n:
            known: set[bytes] = set()
            step.members.append([(span := step.add(raw, parse(raw, known)[0], 0), len(step.spans[span][1]))])
            break
        changed, kept = _edit(text, texts[i + 1])
        other = changed.encode()
        common = len(text[:kept].encode())
        known = set()
        ends, at = parse(raw, known, 0, common)
        shared, twin = len(ends), known.copy()
        ends += parse(raw, known, at)[0]
        a = step.add(raw, ends, 0)
        b = step.add(other[at:], [e - at for e in parse(other, twin, at)[0]], 0)
        step.members.append([(a, len(ends))])
        step.members.append([(a, shared), (b, len(step.spans[b][1]))])
        edited.append((changed, hashlib.sha256(other).hexdigest()))
    sig, filled = step.signatures()
    own, twin, after = sig[0 : 2 * n : 2], sig[1 : 2 * n : 2], np.vstack((sig[2 : 2 * n : 2], sig[2 * n :]))
    has = (filled[0 : 2 * n : 2], filled[1 : 2 * n : 2], np.append(filled[2 : 2 * n : 2], filled[2 * n :]))
    text = [[row.astype(">u2").tobytes().hex() if f else "" for row, f in zip(m, h, strict=True)] for m, h in ((own, has[0]), (twin, has[1]))]
    near = [np.where(has[0] & h, likeness(own, m), (has[0] == h).astype(float)) for m, h in ((twin, has[1]), (after, has[2]))]
    columns = [pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([x for _, x in edited], pa.string()), pa.array(text[0], pa.string()), pa.array(text[1], pa.string()), pa.array(near[0], pa.float64()), pa.array(near[1], pa.float64())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the rows of a range, in its order, but for the last one."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if size > STEP_BYTES and len(ids) > 1:
                yield _rows(ids, texts)
                ids, texts = ids[-1:], texts[-1:]
                size = len(texts[0])
    if len(ids) > 1:
        yield _rows(ids, texts)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of a range and the last one (first: whether it is the first)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is None:
            yield _marked(batch.slice(0, 1), True)
        last = batch.slice(batch.num_rows - 1, 1)
    if last is not None:
        yield _marked(last, False)


def _marked(row: pa.RecordBatch, first: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([row["part"], pa.array([first]), row["doc_id"], row["text"]], ["part", "first", "doc_id", "text"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _rows([row["doc_id"], None], [row["text"] or "", row["next"] or ""])


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness; see the contract of the query.

    The ranges and their ends are read from one shuffle, so ``spark.sql.exchange.reuse`` must be on, as it is by default.
    """
    if docs.sparkSession.conf.get("spark.sql.exchange.reuse") != "true":
        raise ValueError("spark.sql.exchange.reuse must be on")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    ranges = rows.count() // RANGE_ROWS + 1
    # the order of the documents; the last key splits rows that are equal in all, in any order
    keys = {"_missing": F.col("doc_id").isNull(), "_falling": F.bitwise_not("doc_id"), "_hash": F.xxhash64(F.coalesce("text", F.lit(""))), "_row": F.monotonically_increasing_id()}
    rows = rows.select("doc_id", "text", *[k.alias(name) for name, k in keys.items()])
    dealt = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().alias("part"))
    inside = dealt.mapInArrow(_stream, SCHEMA)
    # The last row of a range meets the first one of the range after it.  Bounds of ranges are rows, so all ranges up to
    # the last filled one are filled; two ends stay alone, the first of all and the last of all, and they meet.
    ends = dealt.mapInArrow(_ends, "part int, first boolean, doc_id long, text string")
    row = F.struct("doc_id", "text")
    halves = ends.groupBy((F.col("part") - F.col("first").cast("int")).alias("gap")).agg(F.max(F.when(~F.col("first"), row)).alias("row"), F.max(F.when(F.col("first"), row)).alias("next"))
    gap = F.when(F.col("row").isNull() | F.col("next").isNull(), -1).otherwise(F.col("gap"))
    pairs = halves.groupBy(gap.alias("gap")).agg(F.max("row").alias("row"), F.max("next").alias("next")).where("row IS NOT NULL")
    pairs = pairs.select("row.doc_id", "row.text", F.col("next.text").alias("next"))
    return inside.unionByName(pairs.mapInArrow(_pairs, SCHEMA))
