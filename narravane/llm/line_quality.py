"""Document quality from a linear-chain conditional random field over lines.

Every line has a hidden label, good or bad.  Its features describe the line and
its two neighbours (character classes, word lengths, repetition inside the
document), and a transition score ties neighbouring labels.  Forward-backward
gives each line's probability of being good; the score of a document is their
mean, weighted by line length.

Training takes the documents of a bounded sample of labelled rows.  A line of
such a document carries the document's label.  So that labels change inside
documents too, each of them is taken once more with a block of lines from a
document of the other label put into it; its features (neighbours, repetition)
are those of the mixed text.  Only line features reach the driver.  Scoring runs
over all documents in Arrow batches.

Cases: a null or empty text has one empty line and gets a score from it; very
long texts are scored whole; repeated rows and null ids are scored like any
others; repeated labels of a document are averaged and rounded; without any
usable label the model is undecided and scores are 0.5; other input columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narravane.functions.scratch import written
from narravane.llm.textarrays import LOWER, mix, slices, span_hashes, words

#: Labelled documents that training takes at most, the first ones in the order of a hash.
TRAIN_DOCS = 2000
#: Lines of a document that may be among them, and of all of them at most.
DOC_LINES, TRAIN_LINES = 20_000, 400_000
#: Bytes of text that one step of a task works on.
SLICE = 1 << 18
#: Score from which a document counts as good.
THRESHOLD = 0.3

_U = np.uint64
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower or non-ASCII, 2 upper, 3 digit, 4 sentence mark, 5 symbol, 6 space
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in ".,;:?'-"]] = 4
_CLASS[[ord(c) for c in "!#$%&*|~^=<>{}[]@\\/_+\"`()"]] = 5
_CLASS[[0x20, *range(9, 14)]] = 6

#: Features of a line before those of its neighbours are added.
LINE_FEATURES = 24


def line_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x LINE_FEATURES), lengths of the lines, and the n+1 bounds of the rows in them."""
    rows = len(off) - 1
    breaks = np.flatnonzero(raw == 10)
    starts = np.concatenate((off[:-1], breaks + 1))
    owner = np.concatenate((np.arange(rows), np.searchsorted(off, breaks, "right") - 1))
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[bounds[1:] - 1] = off[1:]
    size = ends - starts
    lines = len(starts)

    kind = _CLASS[raw]
    share = []
    for c in range(1, 6):
        sums = np.concatenate(([0], np.cumsum(kind == c, dtype=np.int64)))
        share.append((sums[ends] - sums[starts]).astype(float))
    lower, upper, digit, mark, symbol = share
    length, letters = np.maximum(size, 1), np.maximum(lower + upper, 1)

    ws, we, wrow = words(raw, off)
    # empty lines start where another begins, so a word's line is the last one that starts at or before it
    wline = np.minimum(np.searchsorted(starts, ws, "right") - 1, lines - 1) if lines else np.zeros(0, np.int64)
    count = np.bincount(wline, minlength=lines).astype(float)
    some = np.maximum(count, 1)
    per = lambda mask: np.bincount(wline[mask], minlength=lines) / some
    wlen = we - ws
    tail = kind[we - 1] if len(we) else np.zeros(0, np.uint8)
    head = kind[ws] if len(ws) else np.zeros(0, np.uint8)
    low = span_hashes(LOWER[raw], ws, we)

    def repeated(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether a key stands elsewhere in its group too."""
        tagged = mix(keys + group.astype(_U) * _U(0x9E3779B97F4A7C15))
        order = np.argsort(tagged)
        s = tagged[order]
        same = s[1:] == s[:-1]
        out = np.zeros(len(s), bool)
        out[order[1:]] |= same
        out[order[:-1]] |= same
        return out

    word_again = repeated(low, wline)
    run = np.zeros(len(low), bool)
    run[1:] = (low[1:] == low[:-1]) & (wrow[1:] == wrow[:-1])
    three = np.zeros(len(low), bool)
    if len(low) > 2:
        inside = np.flatnonzero(wrow[2:] == wrow[:-2])
        gram = mix(mix(low[inside]) * _U(3) + mix(low[inside + 1] + _U(7)) * _U(5) + low[inside + 2])
        three[inside] = repeated(gram, wrow[inside])
    line_again = repeated(span_hashes(raw, starts, ends), owner) & (size > 0)

    log = np.log1p(size) / 8
    columns = [
        np.ones(lines), log, log * log, size == 0, count == 1, np.minimum(count, 60) / 60,
        upper / letters, (upper > 0.6 * letters) & (upper > 2), digit / length, mark / length, symbol / length, (symbol > 0.04 * length),
        np.minimum(np.bincount(wline, wlen, minlength=lines) / some, 20) / 10,
        per(wlen <= 3), per(wlen >= 14), per(tail == 5), per((head == 5) & (wlen == 1)), per(head == 2),
        per(tail == 4), per(word_again), per(run), per(three), per(three) > 0.5, line_again,
    ]
    return np.column_stack(columns).astype(np.float64).reshape(lines, LINE_FEATURES), size, bounds


def with_neighbours(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Adds the features of the line before and of the line after; zeros where there is none."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[bounds[:-1]], after[bounds[1:] - 1] = 0, 0
    return np.hstack((features, before, after))


@dataclass
class Chain:
    """Weights of a two-label chain; a line's bad label and two of four transitions score 0."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * LINE_FEATURES))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def marginals(self, x: np.ndarray, bounds: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected transition counts if ``pairs``."""
        lines = len(x)
        score = np.clip(x @ self.weights, -20, 20)
        local = np.column_stack((np.ones(lines), np.exp(score)))
        local /= local.sum(axis=1, keepdims=True)
        t = np.exp(np.clip(self.moves, -10, 10))
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        first, size = bounds[:-1][order], size[order]
        depth = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(1, depth + 1), "right") if depth else []
        a, b = np.empty((lines, 2)), np.ones((lines, 2))
        for i in range(depth):
            at = first[: active[i]] + i
            f = local[at] * (a[at - 1] @ t) if i else local[at]
            a[at] = f / f.sum(axis=1, keepdims=True)
        expected = np.zeros((2, 2))
        for i in range(depth - 2, -1, -1):
            at = first[: active[i + 1]] + i
            g = local[at + 1] * b[at + 1]
            if pairs:
                joint = a[at][:, :, None] * t[None] * g[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            h = g @ t.T
            b[at] = h / h.sum(axis=1, keepdims=True)
        p = a * b
        return p[:, 1] / p.sum(axis=1), expected

    @classmethod
    def fit(cls, x: np.ndarray, bounds: np.ndarray, good: np.ndarray, rounds: int = 100, rate: float = 0.1, shrink: float = 1e-3) -> Chain:
        """Maximum likelihood by Adam; ``good`` is the 0/1 label of each line."""
        model, n, y = cls(), max(1, len(bounds) - 1), good.astype(float)
        inside = np.ones(max(0, len(good) - 1), bool)
        inside[bounds[1:-1] - 1] = False  # the last line of a document and the first of the next
        seen = np.bincount(2 * good[:-1][inside] + good[1:][inside], minlength=4).reshape(2, 2).astype(float)
        flat = np.concatenate((model.weights, model.moves.ravel()))
        m, v = np.zeros_like(flat), np.zeros_like(flat)
        for r in range(1, rounds + 1):
            p, expected = model.marginals(x, bounds, pairs=True)
            grad = np.concatenate((x.T @ (y - p), (seen - expected).ravel())) / n - shrink * flat
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            flat = flat + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
            model.weights, model.moves = flat[:-4], flat[-4:].reshape(2, 2)
        return model


def held_out() -> Column:
    """The fold that no training row comes from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, off in slices(batch, "text", SLICE):
            x, size, bounds = line_features(raw, off)
            n = np.diff(bounds)
            lists = pa.ListArray.from_arrays(pa.array(bounds * LINE_FEATURES, pa.int32()), pa.array(x.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), lists, part.column(part.schema.get_field_index("good"))], ["lines", "features", "good"])


def line_sample(docs: DataFrame, labels: DataFrame, sample: int, lines: int, doc_lines: int) -> DataFrame:
    """(doc_id, good, text) of the labelled documents that training takes; see ``train``."""
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).cast("int").alias("good"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "good").agg(F.min("text").alias("text"))  # at most ``sample`` rows from here on
    # a line ends at a line break, so there is at most one more than those
    breaks = rows.select("doc_id", F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(1)).alias("lines")).where(F.col("lines") <= doc_lines)
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = breaks.withColumn("sum", F.sum("lines").over(so_far)).where(F.col("sum") <= lines).select("doc_id")
    return rows.join(F.broadcast(taken), "doc_id", "left_semi")


def spliced(rows: DataFrame) -> DataFrame:
    """(doc_id, text, good): each of the ``rows`` with the first half of a document of the other label put in; ``good`` has a label for each line.

    Documents of a label are numbered by a hash, and take turns.
    """
    lined = rows.select("doc_id", "good", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("own"))
    numbered = lined.withColumn("k", F.row_number().over(Window.partitionBy("good").orderBy(F.xxhash64("doc_id"), "doc_id")) - 1)
    counts = numbered.groupBy((1 - F.col("good")).alias("good")).agg(F.count(F.lit(1)).alias("others"))
    turn = numbered.join(F.broadcast(counts), "good").withColumn("turn", F.pmod("k", "others")).withColumn("other_good", 1 - F.col("good"))
    other = numbered.select(F.col("good").alias("other_good"), F.col("k").alias("turn"), F.expr("slice(own, 1, (size(own) + 1) DIV 2)").alias("block"))
    # a place in the middle half
    cut = F.expr("CAST(size(own) * (0.25 + pmod(xxhash64(doc_id, 1), 1000) / 2000D) AS INT)")
    mixed = turn.join(other, ["other_good", "turn"]).withColumn("cut", cut)
    text = F.expr("array_join(concat(slice(own, 1, cut), block, slice(own, cut + 1, size(own) - cut)), '\n')")
    good = F.expr("concat(array_repeat(good, cut), array_repeat(1 - good, size(block)), array_repeat(good, size(own) - cut))")
    return mixed.select("doc_id", text.alias("text"), good.alias("good"))


def train(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS, lines: int = TRAIN_LINES, doc_lines: int = DOC_LINES) -> Chain:
    """Fits the chain on at most ``sample`` labelled documents outside the held-out fold, which have at most ``lines`` lines in all.

    They are the first by a hash of their id among those with at most ``doc_lines`` lines each; of rows that repeat an
    id the one with the least text counts.  Mixed documents come on top, with at most one and a half times as many lines.
    """
    rows = written(line_sample(docs, labels, sample, lines, min(doc_lines, lines)))  # read twice
    whole = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array_repeat("good", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))).alias("good"))
    both = whole.unionByName(spliced(rows))
    got = both.mapInArrow(_feature_rows, "lines int, features array<float>, good array<int>").toArrow()
    if not got.num_rows:
        return Chain()
    x, good = (got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("features", "good"))
    bounds = np.concatenate(([0], np.cumsum(got.column("lines").to_numpy())))
    return Chain.fit(with_neighbours(x.astype(float).reshape(-1, LINE_FEATURES), bounds), bounds, good)


def scores_of(model: Chain, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    x, size, bounds = line_features(raw, off)
    p, _ = model.marginals(with_neighbours(x, bounds), bounds)
    weight = size + 1.0  # a line and its end
    return np.add.reduceat(p * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])


def score(docs: DataFrame, model: Chain) -> DataFrame:
    """``docs`` with a column ``score``, the length-weighted mean probability of its lines being good."""
    docs = docs.drop("score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.zeros(0)]
            for _, raw, off in slices(batch, "text", SLICE):
                values.append(scores_of(model, raw, off))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(values))], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, fields)


def quality(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    model = train(docs, labels, sample)
    fields = "doc_id long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            values = [scores_of(model, raw, off) for _, raw, off in slices(batch, "text", SLICE)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([np.zeros(0), *values]))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
