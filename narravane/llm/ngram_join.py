"""Near-duplicate groups by an exact Jaccard self-join of word n-gram sets.

Method: partition of the token universe and the pigeonhole principle.  A size
band fixes a number of segments m, and a hash deals the tokens of the universe
into them.  A set of size k differs from a linked set, given the sizes that the
band allows, in at most h(k) < m tokens.  If a record gives each segment an
allowance of -1 (skip), 0 (equal subset) or 1 (subset after at most one
deletion), and the allowances plus one sum up to more than h(k), some segment
of a linked set differs by no more than its allowance.

* Every set is indexed by the hash of its subset in each segment that is not
  empty (allowance 0).  A linked set agrees in m - h(k) segments, so in at least
  ``need`` = m - h(k) - (empty segments) indexed ones.  Records with fewer
  subsets that other sets have too are linked with nothing and go.
* Cost-based allocation: where a subset is shared by many sets that stay
  unlinked (``HOT_KEY`` groups or more), the records that hold it skip it.  Up to
  m - h(k) - 1 skips are free; for each further one a record raises one of its
  cheapest other segments to allowance 1.  Only records with ``need`` such
  subsets or more use the one-deletion neighbourhoods: a pair that loses its
  last shared subset by skips has two of them.
* A parity sketch of a set, in which a token flips one bit, bounds the tokens
  in which two sets differ from below; it drops most false candidates before
  the rest is verified on the whole sets.

Work on groups stays small.  Sets that are equal form one class.  Each class is
first compared with one pivot, the member of its subsets that shares the most
(if their sketches are near), and links are closed into components.  Sets around
one pivot are then compared through the tokens in which they differ from it: two
of them can be linked only if they share enough such tokens, so a prefix of the
rarest ones is joined (``_around_pivots``).  Sets with different pivots meet in
their subsets (``_cross``, ``_allocated``).  Pairs inside a component are never
expanded, and no link between components is lost.

Tokens are 64-bit hashes of word n-grams; sets are compared through them.

Cases: words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower
case.  A text with fewer words than ``n`` has one token, the whole sequence; a
null, empty or blank text has none and is linked with nothing.  Rows that share
a doc_id count as one node; a null doc_id keeps its row and gets a null
component unless an equal set has an id.  Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narravane.functions.scratch import written
from narravane.llm.textarrays import LOWER, mix, slices, span_hashes, words
from narravane.operators.components import components

#: Unlinked groups that may share a segment subset before the allocation skips it.
HOT_KEY = 64
#: A list of document ids (8 bytes each) is broadcast up to this length; a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Least ratio of the sizes in a band.
BAND_RATIO = 1.5
#: Segments beyond the largest difference of a band, as a share of it: room for empty and hot subsets.
SPARE = 0.15
#: A subset held by more than one in so many (sampled) index rows is known to be shared and isn't gathered in one task.
HEAVY = 1 << 16
#: One document in so many is sampled to find those subsets; this only spreads work.
SAMPLE = 64
#: Sets already emitted by a task whose copies it doesn't emit again (only saves work).
SEEN = 1 << 16

#: Sets are compared with their pivot if their sketches differ by no more than this share of both sizes, or twice the budget (only shifts work).
AROUND = 0.22

#: Columns of the sketch folded to 256 bits.
_COARSE = ("s0", "s1", "s2", "s3")

_U = np.uint64
_C1, _C2, _C3, _C4 = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25), _U(0xD1342543DE82EF95), _U(0x2545F4914F6CDD1D)


def token_sets(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, sorted by row and hash, and the n+1 bounds of the rows."""
    starts, ends, row = words(raw, off)
    rows = len(off) - 1
    hashes = span_hashes(LOWER[raw], starts, ends)
    count = np.bincount(row, minlength=rows)
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]

    def combine(at: np.ndarray, width: int) -> np.ndarray:
        acc = np.full(len(at), width, _U)
        for i in range(width):
            acc = mix(acc * _C3 + hashes[at + i])
        return acc

    full = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
    parts, owners = [combine(full, n)], [row[full]]
    for width in range(1, n):
        short = np.flatnonzero(count == width)
        if len(short):
            parts.append(combine(begin[short], width))
            owners.append(short)
    tokens, owner = np.concatenate(parts), np.concatenate(owners)
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        tokens, owner = tokens[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    for b, e in zip(bounds[:-1], bounds[1:], strict=True):
        tokens[b:e].sort()
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[new], np.searchsorted(owner[new], np.arange(rows + 1))


class Bands:
    """Size bands for a similarity of ``percent`` hundredths."""

    def __init__(self, percent: int) -> None:
        if not 50 <= percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        self.percent, self.lows = percent, [1]

    def of(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(max(self.lows[-1] + 1, int(np.ceil(self.lows[-1] * BAND_RATIO))))
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def budget(self, band: int) -> int:
        """Tokens in which two linked sets may differ if the larger one is in this band."""
        self.of(self.lows[min(band, len(self.lows) - 1)])
        while len(self.lows) < band + 2:
            self.of(self.lows[-1])
        return (100 - self.percent) * 2 * (self.lows[band + 1] - 1) // (100 + self.percent)

    def segments(self, band: int) -> int:
        """Segments into which the tokens are dealt for this band."""
        least = self.budget(band) + 1
        return least + 1 + int(np.ceil(SPARE * least))

    def memberships(self, size: int) -> list[tuple[int, int]]:
        """(band, budget) of the bands in which a set of this size can meet others that are not equal to it.

        These are its own, and higher ones within reach.  The budget holds for this size: a linked set is at most
        as large as the band and the similarity allow.
        """
        own = self.of(size)
        out, band = [], own
        while band == own or 100 * size >= self.percent * self.lows[band]:
            self.budget(band)
            largest = min(self.lows[band + 1] - 1, 100 * size // self.percent)
            allowed = (100 - self.percent) * (size + largest) // (100 + self.percent)
            if allowed:
                out.append((band, allowed))
            band += 1
            self.budget(band)
        return out


def _salt(band: int) -> np.uint64:
    return _U((band + 1) * int(_C2) & 0xFFFFFFFFFFFFFFFF)


class Index:
    """The segment subsets of the sets of some rows, one place (row, band) after the other."""

    def __init__(self, bands: Bands, tokens: np.ndarray, bounds: np.ndarray, rows: np.ndarray, reach: dict[int, list[tuple[int, int, int]]]) -> None:
        size = np.diff(bounds)
        own = []
        for r in rows.tolist():
            k = int(size[r])
            if k not in reach:
                reach[k] = [(b, bands.segments(b), h) for b, h in bands.memberships(k)] if k else []
            own += [(r, *place) for place in reach[k]]
        places = np.array(own, np.int64).reshape(-1, 4)
        self.row, self.band, self.m, self.budget = places.T
        self.first = np.concatenate(([0], np.cumsum(self.m)))
        count = size[self.row]
        self.place = np.repeat(np.arange(len(places)), count)
        at = np.arange(len(self.place)) - np.repeat(np.cumsum(count) - count, count) + bounds[self.row][self.place]
        salt = np.array([_salt(b) for b in self.band.tolist()], _U)
        seg = (mix(tokens[at] ^ salt[self.place]) >> _U(11)) % self.m.astype(_U)[self.place]
        self.term = mix(tokens[at] ^ _C1)
        self.slot = self.first[self.place] + seg.astype(np.int64)
        self.filled = np.bincount(self.slot, minlength=self.first[-1]).astype(np.int64)
        self.sums = np.zeros(self.first[-1], _U)
        np.add.at(self.sums, self.slot, self.term)
        #: place of each slot, and the term that names its band and segment
        self.of = np.repeat(np.arange(len(places)), self.m)
        self.seg = np.arange(self.first[-1]) - self.first[self.of]
        self.name = mix(self.seg.astype(_U) + salt[self.of])
        empty = np.bincount(self.of[self.filled == 0], minlength=len(places))
        self.need = self.m - self.budget - empty

    def keys(self) -> np.ndarray:
        """Index key of the subset in each slot."""
        return mix(self.sums ^ self.name)

    def less(self) -> np.ndarray:
        """Index keys of the one-deletion subsets, one for each token, in the order of ``slot``."""
        return mix((self.sums[self.slot] - self.term) ^ self.name[self.slot])


def _sketch(bits: np.ndarray) -> np.ndarray:
    """Parity bits of a set: a token flips one of 256 * 2**k bits, as many as the set has tokens or more.

    Two sets differ in at least as many tokens as their sketches differ in bits.
    """
    width = 1 << max(8, (len(bits) - 1).bit_length())
    parity = np.bincount((bits & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def _list_array(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values, kind))


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())


def _signatures(n: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document: set size, a set hash, a parity sketch, and the bands for which too many segments are empty to need a shared subset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, reach = Bands(percent), {}
        for batch in batches:
            for part, raw, off in slices(batch, "text"):
                tokens, bounds = token_sets(raw, off, n)
                size = np.diff(bounds)
                c1 = _class_hash(tokens, bounds)
                bits = mix(tokens ^ _C4)
                sketches = [_sketch(bits[b:e]) for b, e in zip(bounds[:-1], bounds[1:], strict=True)]
                index = Index(bands, tokens, bounds, np.arange(len(size)), reach)
                crowded = np.flatnonzero(index.need <= 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        _ids(part), pa.array(size, pa.int64()), pa.array(c1.view(np.int64)), _list_array(np.concatenate(sketches), list(map(len, sketches)), pa.int64()),
                        _list_array(index.band[crowded], np.bincount(index.row[crowded], minlength=len(size)).tolist(), pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "c1", "sketch", "crowded"],
                )

    return run


def _class_hash(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix(tokens ^ _C2))))
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(_U))


def _index_rows(n: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, c1, band, need) for each set and segment that is not empty, but for sets just seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen, reach = Bands(percent), set(), {}
        for batch in batches:
            for _, raw, off in slices(batch, "text"):
                tokens, bounds = token_sets(raw, off, n)
                c1 = _class_hash(tokens, bounds)
                new = []
                for r, mark in enumerate(c1.tolist()):
                    if mark not in seen:
                        new.append(r)
                        if len(seen) < SEEN:
                            seen.add(mark)
                index = Index(bands, tokens, bounds, np.array(new, np.int64), reach)
                held = index.filled > 0
                of = index.of[held]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index.keys()[held].view(np.int64)), pa.array(c1.view(np.int64)[index.row[of]]), pa.array(index.band[of], pa.int32()), pa.array(index.need[of], pa.int32())], ["key", "c1", "band", "need"]
                )

    return run


def _sets(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document: its class and its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, off in slices(batch, "text"):
                tokens, bounds = token_sets(raw, off, n)
                c1 = _class_hash(tokens, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(c1.view(np.int64)), _list_array(tokens.view(np.int64), np.diff(bounds).tolist(), pa.int64())], ["node", "tokens"])

    return run


def _neighbourhoods(n: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per class of a document, band and segment: the free skips, the key of the subset, whether it is empty, and the keys of its one-deletion subsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, reach = Bands(percent), {}
        for batch in batches:
            for _, raw, off in slices(batch, "text", 1 << 16):
                tokens, bounds = token_sets(raw, off, n)
                c1 = _class_hash(tokens, bounds).view(np.int64)
                index = Index(bands, tokens, bounds, np.arange(len(c1)), reach)
                order = np.argsort(index.slot, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c1[index.row[index.of]]), pa.array(index.band[index.of], pa.int32()), pa.array(index.seg, pa.int32()), pa.array((index.m - index.budget - 1)[index.of], pa.int32()),
                        pa.array(index.keys().view(np.int64)), pa.array(index.filled == 0), _list_array(index.less()[order].view(np.int64), index.filled.tolist(), pa.int64()),
                    ],
                    ["rep", "band", "seg", "free", "key", "empty", "less"],
                )

    return run


def _texts_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for the classes in ``nodes`` (node)."""
    ids = written(nodes.distinct().join(classes.select("node", F.col("id").alias("doc_id")), "node").select("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _compared(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) with both set sizes, the tokens in which the whole sets differ, and whether they are linked."""
    texts = _texts_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    sets = written(texts.mapInArrow(_sets(n), "node long, tokens array<long>").dropDuplicates(["node"]))
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    differ = F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))
    met = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), differ.alias("delta"))
    return written(met.withColumn("linked", F.size("delta") <= _budget("na", "nb", percent)))


def _links(compared: DataFrame) -> DataFrame:
    return compared.where("linked").select("a", "b").distinct()


def _budget(a: str, b: str, percent: int):
    """Tokens in which linked sets of these sizes differ at most."""
    return F.expr(f"({100 - percent} * ({a} + {b})) DIV {100 + percent}")


def _around_pivots(compared: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components among the sets compared with one pivot ``a``.

    The tokens in which x and y differ are those in which exactly one of them
    differs from the pivot.  So with dx and dy such tokens and a budget h, a
    link needs o = (dx + dy - h) / 2 tokens that both have in their difference.
    Where o is positive, a common token stands among the first dx - o + 1 of x
    and the first dy - o + 1 of y, in the order of rising frequency around the
    pivot.  Otherwise the link is certain, and one partner is linked with the
    pivot; a partner for each size and distance is enough for its component.
    """
    of = comps.select(F.col("node").alias("b"), "component")
    near = compared.select(F.col("a").alias("pivot"), "b", F.col("nb").alias("n"), F.size("delta").alias("d"), "delta", "linked").join(of, "b", "left")
    near = near.withColumn("comp", F.coalesce("component", "b")).drop("component")
    several = near.groupBy("pivot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi").select("pivot")
    near = written(near.join(several, "pivot", "left_semi"))

    tokens = near.select("pivot", "b", "n", "d", "comp", F.explode("delta").alias("token"))
    often = tokens.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(often, ["pivot", "token"]).selectExpr("*", "row_number() OVER (PARTITION BY pivot, b ORDER BY df, token) - 1 AS r")
    most = F.expr(f"({100 - percent} * (n + (100 * n) DIV {percent})) DIV {100 + percent}")  # budget with the largest partner
    index = written(ranked.where((F.col("df") > 1) & (F.col("r") <= most)).select("pivot", "token", "b", "n", "d", "comp", "r"))
    x, y = (index.select("pivot", "token", *[F.col(c).alias(c + side) for c in ("b", "n", "d", "comp", "r")]) for side in "xy")
    common = F.expr(f"(dx + dy - {_sql_budget('nx', 'ny', percent)} + 1) DIV 2")
    met = x.join(y, ["pivot", "token"]).where((F.col("bx") < F.col("by")) & (F.col("compx") != F.col("compy")) & (common >= 1) & (common <= F.col("dx") - F.col("rx")) & (common <= F.col("dy") - F.col("ry")) & _sizes("nx", "ny", percent))
    pairs = met.select(F.col("bx").alias("a"), F.col("by").alias("b")).distinct()

    inner = near.where("linked").groupBy("pivot", "n", "d").agg(F.min_by(F.struct("b", "comp"), "b").alias("x")).select("pivot", F.col("n").alias("nx"), F.col("d").alias("dx"), "x")
    outer = near.where("NOT linked").where(F.col("d") <= most).select("pivot", F.col("b").alias("y"), F.col("n").alias("ny"), F.col("d").alias("dy"), F.col("comp").alias("compy"))
    sure = outer.join(inner, "pivot").where((F.col("dx") + F.col("dy") <= _budget("nx", "ny", percent)) & (F.col("x.comp") != F.col("compy")))
    sure = sure.groupBy("y", "x.comp").agg(F.min("x.b").alias("x")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.unionByName(sure).distinct()


def _sketch_distance(a: str, b: str) -> Column:
    """Bits in which two sketches differ; the wider one is folded to the other's width, at most one step."""
    folded = lambda x, y: f"CASE WHEN size({x}) > size({y}) THEN transform(sequence(0, size({x}) DIV 2 - 1), i -> {x}[i] ^ {x}[i + size({x}) DIV 2]) ELSE {x} END"
    return F.expr(f"aggregate(zip_with({folded(a, b)}, {folded(b, a)}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")


def _sql_budget(a: str, b: str, percent: int) -> str:
    return f"(({100 - percent} * ({a} + {b})) DIV {100 + percent})"


def _cross(entries: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components and pivots from entries whose keys have a bounded number of pivots.

    The members of a key's largest pivot are paired with the others only, not among themselves.  A pair must share as
    many of these subsets in a band as both records need beside the ones left out (``least``).
    """
    per_pivot = entries.groupBy("key", "pivot").agg(F.count(F.lit(1)).alias("k"))
    main = per_pivot.groupBy("key").agg(F.max_by("pivot", F.struct("k", "pivot")).alias("main"))
    marked = entries.join(main, "key").withColumn("rest", F.col("pivot") != F.col("main"))
    side = lambda df, z: df.select("key", *[F.col(c).alias(c + z) for c in ("rep", "band", "n", "comp", "pivot", "least", "rest", *_COARSE)])
    met = side(marked.where("rest"), "x").join(side(marked, "y"), "key")
    met = met.where((F.col("pivotx") != F.col("pivoty")) & (~F.col("resty") | (F.col("repx") < F.col("repy"))) & _may_link(percent))
    pairs = met.select(F.least("repx", "repy").alias("x"), F.greatest("repx", "repy").alias("y"), F.col("bandx").alias("band"), F.greatest("leastx", "leasty").alias("least"))
    pairs = pairs.groupBy("x", "y", "band").agg(F.count(F.lit(1)).alias("k"), F.max("least").alias("least")).where("k >= least").select("x", "y").distinct()
    return _sketched(pairs, records, percent)


def _folded() -> list[Column]:
    """The columns of a sketch folded to 256 bits."""
    return [F.expr(f"aggregate(filter(sketch, (v, i) -> i % 4 = {i}), 0L, (s, v) -> s ^ v)").alias(c) for i, c in enumerate(_COARSE)]


def _may_link(percent: int) -> Column:
    """Whether x and y are of different components, and their sizes and folded sketches allow a link; for use inside a join."""
    differ = "+".join(f"bit_count({c}x ^ {c}y)" for c in _COARSE)
    return (F.col("compx") != F.col("compy")) & _sizes("nx", "ny", percent) & F.expr(f"{differ} <= {_sql_budget('nx', 'ny', percent)}")


def _sketched(pairs: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y), as (a, b), whose sizes and sketches allow a link."""
    named = lambda z: records.select(F.col("rep").alias(z), F.col("n").alias(f"n{z}"), F.col("sketch").alias(f"s{z}"))
    near = _sizes("nx", "ny", percent) & (_sketch_distance("sx", "sy") <= _budget("nx", "ny", percent))
    return pairs.join(named("x"), "x").join(named("y"), "y").where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _sizes(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _allocated(docs: DataFrame, classes: DataFrame, holders: DataFrame, hot: DataFrame, records: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs of holders (rep, band) that hot and empty subsets hide, through the allowances of one record of each pair.

    ``records`` has (rep, n, sketch, comp).
    """
    texts = _texts_of(docs, classes, holders.select(F.col("rep").alias("node")))
    parts = texts.mapInArrow(_neighbourhoods(n, percent), "rep long, band int, seg int, free int, key long, empty boolean, less array<long>")
    parts = written(parts.join(holders, ["rep", "band"], "left_semi").dropDuplicates(["rep", "band", "seg"]))
    cost = parts.select("rep", "band", "seg", "key", "free", "empty").join(hot, "key", "left")
    cost = cost.withColumn("cost", F.when(F.col("empty"), F.lit((1 << 62))).otherwise(F.coalesce("groups", F.lit(0))))
    # a record's own segments: as many rows as its budget, a bounded window
    of_record = "PARTITION BY rep, band"
    cost = cost.selectExpr("*", f"count(*) OVER ({of_record}) AS m", f"count_if(cost > 0) OVER ({of_record}) AS h", f"row_number() OVER ({of_record} ORDER BY cost, seg) AS at")
    cost = cost.selectExpr("*", "least(greatest(h - free, 0), (m - free) DIV 2) AS r")
    allowance = F.when(F.col("at") > F.col("m") - F.col("r") - F.col("free"), -1).when(F.col("at") <= F.col("r"), 1).otherwise(0)
    chosen = written(cost.select("rep", "band", "seg", "key", "cost", allowance.alias("allow")))
    up = written(parts.join(chosen.where("allow = 1").select("rep", "band", "seg"), ["rep", "band", "seg"]))
    whole, less = parts.select("key", F.col("rep").alias("y")), parts.select(F.explode("less").alias("key"), F.col("rep").alias("y"))
    # the allowances of one record of a pair are enough: the one with the smaller id searches
    by_deletion = up.select(F.explode("less").alias("key"), F.col("rep").alias("x")).join(whole, "key")
    by_insertion = up.select("key", F.col("rep").alias("x")).join(less, "key")
    # equal subsets of all segments that are not skipped; those that are not hot meet in _cross
    coarse = written(records.join(holders.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "comp", *_folded()))
    side = lambda df, z: df.select("key", "rep").join(coarse, "rep").select("key", *[F.col(c).alias(c + z) for c in ("rep", "n", "comp", *_COARSE)])
    kept = side(chosen.where("allow >= 0 AND cost > 0"), "x").join(side(parts, "y"), "key").where((F.col("repx") < F.col("repy")) & _may_link(percent)).select(F.col("repx").alias("x"), F.col("repy").alias("y"))
    met = by_deletion.unionByName(by_insertion).where("x < y").select("x", "y").unionByName(kept).distinct()
    of = lambda z: records.select(F.col("rep").alias(z), F.col("comp").alias(f"c{z}"))
    return _sketched(met.join(of("x"), "x").join(of("y"), "y").where("cx <> cy").select("x", "y"), records, percent)


def _shared_subsets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, c1, band, need) of the index rows whose key two classes or more have, but for records with fewer than they need."""
    kind = "key long, c1 long, band int, need int"
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(_index_rows(n, percent), kind).select("key", "c1").distinct()
    # no more than HEAVY keys can have so large a share
    often = written(sample.groupBy("key").agg(F.count(F.lit(1)).alias("k")))
    total = often.agg(F.sum("k")).first()[0] or 0
    heavy = F.broadcast(often.where(F.col("k") >= max(2, -(-total // HEAVY))).select("key", F.lit(True).alias("heavy")))
    rows = docs.mapInArrow(_index_rows(n, percent), kind).join(heavy, "key", "left")
    # rows of heavy keys are dealt by their class too, since they are known to be shared
    rows = rows.withColumn("deal", F.when(F.col("heavy"), F.col("c1")))
    shared = rows.selectExpr("*", "min(c1) OVER (PARTITION BY key, deal) AS lo", "max(c1) OVER (PARTITION BY key, deal) AS hi").where("lo <> hi OR heavy")
    shared = written(shared.select("key", "c1", "band", "need").distinct())
    enough = shared.groupBy("c1", "band").agg(F.count(F.lit(1)).alias("k"), F.max("need").alias("need")).where("k >= need").select("c1", "band")
    return shared.join(enough, ["c1", "band"], "left_semi")


def near_duplicate_groups(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sig = written(docs.mapInArrow(_signatures(n, percent), "doc_id long, n_shingles long, c1 long, sketch array<long>, crowded array<long>"))
    filled = sig.where("n_shingles > 0")
    classes = filled.where("doc_id IS NOT NULL").groupBy(F.col("c1").alias("node")).agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("crowded").alias("crowded"))
    classes = written(classes)
    records = classes.select(F.col("node").alias("rep"), "n", "sketch")

    entries = written(_shared_subsets(docs, n, percent).withColumnRenamed("c1", "rep").join(records.select("rep", "n", *_folded()), "rep"))

    # the pivot of a record is the member of its subsets with the largest weight: the members of all of its subsets
    crowd = entries.join(entries.groupBy("key").agg(F.count(F.lit(1)).alias("k")), "key")
    weight = crowd.groupBy("rep").agg(F.sum("k").alias("weight"))
    weighed = written(entries.join(weight, "rep").select("key", F.struct("weight", "rep").alias("at"), "rep"))
    hubs = weighed.groupBy("key").agg(F.max("at").alias("hub"))
    pivots = written(weighed.join(hubs, "key").groupBy("rep").agg(F.max("hub").alias("hub")).select("rep", F.col("hub.rep").alias("pivot")))
    x, y = (records.toDF(*(c + side for c in ("rep", "n", "s"))) for side in "xy")
    tried = pivots.where("rep <> pivot").join(x, pivots.rep == x.repx).join(y, F.col("pivot") == y.repy)
    # farther sets are compared in their subsets, if at all
    reach = F.greatest(2 * _budget("nx", "ny", percent), F.expr(f"CAST({AROUND} * (nx + ny) AS LONG)"))
    near = written(tried.where(_sizes("nx", "ny", percent) & (_sketch_distance("sx", "sy") <= reach)).select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    compared = _compared(docs, classes, near, n, percent)
    links = written(_links(compared).unionByName(_same_id(filled)))
    comps = written(components(links))

    more = _around_pivots(compared, comps, percent)
    known = entries.join(comps, entries.rep == comps.node, "left").drop("node").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    known = known.join(near.toDF("pivot", "rep"), "rep", "left").withColumn("pivot", F.coalesce("pivot", "rep"))
    spread = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("pivot").alias("p"), F.max("pivot").alias("q"))
    open_keys = written(known.join(spread.where("lo <> hi AND p <> q").select("key"), "key", "left_semi"))
    hot = written(open_keys.groupBy("key").agg(F.count_distinct("pivot").alias("groups")).where(F.col("groups") >= HOT_KEY))
    held = written(open_keys.join(hot, "key", "left_semi").groupBy("rep", "band").agg(F.count(F.lit(1)).alias("h"), F.min("need").alias("needed")))
    cool = open_keys.join(hot, "key", "left_anti").join(held.drop("needed"), ["rep", "band"], "left").withColumn("least", F.col("need") - F.coalesce("h", F.lit(0)))
    more = more.unionByName(_cross(cool, records, percent))
    crowded = classes.select(F.col("node").alias("rep"), F.explode(F.col("crowded").cast("array<int>")).alias("band"))
    holders = written(held.where("h >= needed").select("rep", "band").unionByName(crowded).distinct())
    if not holders.isEmpty():
        with_comp = records.join(comps, records.rep == comps.node, "left").select("rep", "n", "sketch", F.coalesce("component", "rep").alias("comp"))
        more = more.unionByName(_allocated(docs, classes, holders, hot, with_comp, n, percent))
    more = written(more.distinct())
    if not more.isEmpty():
        comps = written(components(links.unionByName(_links(_compared(docs, classes, more, n, percent)))))

    least = classes.join(comps, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("id").alias("component_id"))
    of_class = classes.join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("component")).join(least, "component").select(F.col("node").alias("c1"), "component_id")
    salts = 16  # a class may hold a third of all rows
    spread = of_class.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    rows = filled.drop("sketch", "crowded").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    grouped = rows.join(spread, ["c1", "salt"], "left").select("doc_id", "n_shingles", "component_id")
    alone = sig.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone)


def _same_id(filled: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat a doc_id with other texts."""
    classes = filled.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).where("a <> b")
    return classes.join(filled.select("doc_id", F.col("c1").alias("c")), "doc_id").where("a <> c").select("a", F.col("c").alias("b")).distinct()
