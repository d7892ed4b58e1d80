"""Neighbours among unit vectors, by blocks: nearest ones, and what lies within a radius.

Equal vectors of a scope are one class.  Classes are dealt to the nearest of a
bounded sample of centres; such cells, near ones side by side, are cut into
blocks of bounded size, and two blocks are compared inside a task, to which
their vectors come in order.  A block is large, since each of its vectors is
sent once for each block it meets; inside a task, vectors go by chunks.  The
angle between two vectors is a metric, so cells, and chunks, that are too far
apart for a question aren't compared at all; nothing that is left out can be
part of the answer.  A comparison gives the few nearest vectors, or links that
span the components inside it, or the pairs themselves where few are asked for;
never all pairs of a dense block.

``vectors`` has (scope, vec_id, v): unit vectors of one length, as array<double>.
Distances are cosine distances, rounded to six digits before they are compared.
Vectors of different scopes have nothing to do with each other.  Rows with a
null are left out; repeated ids of equal vectors count as more vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.functions.scratch import written

#: Vectors and bytes of a block at most; vectors of a scope that are one block; centres at most, which the driver and each task hold; vectors for which there is one centre.
BLOCK, BLOCK_BYTES, LEAST_BLOCK, CENTRES, PER_CENTRE = 32768, 1 << 24, 512, 4096, 512
#: Vectors of a chunk of a block, and chunks that one chunk is compared with at once; found rows that are held before the best of them are kept.
CHUNK, RUN, HELD = 256, 32, 1 << 20
#: What rounding can add to an angle, and to a distance.
SLACK, CLOSE = 2e-3, 1e-6


def _rounded(dots: np.ndarray) -> np.ndarray:
    """Rounded cosine distances."""
    return np.floor((1.0 - dots) * 1e6 + 0.5) / 1e6


def _theta(distance):
    """The angle of a cosine distance, as a column."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _order(v: np.ndarray) -> list[int]:
    """Places of vectors, near ones side by side: each time the nearest one left."""
    out, left = [0], np.ones(len(v), bool)
    left[0] = False
    while left.any():
        out.append(int(np.where(left, v @ v[out[-1]], -np.inf).argmax()))
        left[out[-1]] = False
    return out


class Neighbours:
    """Vectors dealt to cells and blocks, for questions about their neighbours; ``alike``: equal vectors are one class."""

    def __init__(self, vectors: DataFrame, alike: bool = True) -> None:
        rows = vectors.where("scope IS NOT NULL AND vec_id IS NOT NULL AND v IS NOT NULL")
        named = rows.groupBy("scope", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")) if alike else rows.withColumn("rep", F.col("vec_id")).withColumn("n", F.lit(1))
        self.reps = written(named.select("scope", F.col("rep").cast("long").alias("rep"), F.col("n").cast("long").alias("n"), "v"))
        self.kind = self.reps.schema["scope"].dataType.simpleString()
        rate = max(PER_CENTRE, self.reps.count() // CENTRES)
        sample = self.reps.where(F.pmod(F.xxhash64("rep"), F.lit(rate)) == 0).select("scope", "v").orderBy("rep").limit(CENTRES).collect()
        of: dict = {}
        for r in sample:
            of.setdefault(r.scope, []).append(r.v)
        turned = [(scope, v[i]) for scope, v in of.items() for i in _order(np.array(v))]
        self.centres = [(scope, i, v) for i, (scope, v) in enumerate(turned)]
        self.placed = written(self._placed())

    def _placed(self) -> DataFrame:
        """The classes with their cell, the angle to its centre, and their block."""
        held: dict = {}
        for scope, number, v in self.centres:
            held.setdefault(scope, ([], []))
            held[scope][0].append(number)
            held[scope][1].append(v)
        held = {s: (np.array(a, np.int32), np.array(b)) for s, (a, b) in held.items()}

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scopes = batch["scope"].to_pylist()
                cell, angle = np.full(len(scopes), -1, np.int32), np.full(len(scopes), np.pi)
                of: dict = {}
                for i, scope in enumerate(scopes):
                    if scope in held:
                        of.setdefault(scope, []).append(i)
                if of:
                    matrix = _matrix(batch["v"])
                for scope, places in of.items():
                    for at in (places[i : i + CHUNK] for i in range(0, len(places), CHUNK)):
                        dots = matrix[at] @ held[scope][1].T
                        best = dots.argmax(axis=1)
                        cell[at], angle[at] = held[scope][0][best], np.arccos(np.clip(dots[np.arange(len(at)), best], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

        celled = written(self.reps.mapInArrow(deal, f"scope {self.kind}, rep long, n long, v array<double>, cell int, angle double"))
        # a row for each cell, of which there is a bounded number in each scope; blocks enough that pairs of them keep all cores busy
        sizes = celled.groupBy("scope", "cell").agg(F.count(F.lit(1)).alias("members"), F.max("angle").alias("reach"), F.max(F.size("v")).alias("dim"))
        cores = self.reps.sparkSession.sparkContext.defaultParallelism
        most = f"greatest(1, least({BLOCK}, {BLOCK_BYTES} DIV (8 * greatest(1, max(dim) OVER (PARTITION BY scope)))))"
        size = f"least({most}, greatest({LEAST_BLOCK}, sum(members) OVER (PARTITION BY scope) DIV {ceil(sqrt(8 * cores))}))"
        sizes = sizes.selectExpr("scope", "cell", "members", "reach", "sum(members) OVER (PARTITION BY scope ORDER BY cell) - members AS before", f"{size} AS size")
        return celled.join(sizes, ["scope", "cell"]).withColumn("block", F.expr("CAST((before + pmod(xxhash64(rep, 7), members)) DIV size AS INT)")).drop("members", "angle", "before", "size")

    def _met(self, limit: DataFrame, own: bool = False) -> DataFrame:
        """(scope, a, b, eps): blocks whose cells may hold vectors within the distance of ``limit`` (scope, eps); ``own``: each block with itself only."""
        if own:
            return self.placed.select("scope", F.col("block").alias("a"), F.col("block").alias("b")).distinct().join(limit, "scope")
        blocks = self.placed.groupBy("scope", "cell", "block").agg(F.max("reach").alias("reach"))
        left, right = (blocks.select("scope", F.col("cell").alias("cell" + z), F.col("block").alias(n)) for z, n in (("x", "a"), ("y", "b")))
        # cells, of which there is a bounded number for each scope
        cells = blocks.groupBy("scope", "cell").agg(F.max("reach").alias("reach"))
        centres = self.reps.sparkSession.createDataFrame(self.centres, f"scope {self.kind}, cell int, centre array<double>")
        cells = cells.join(centres, ["scope", "cell"], "left")
        x, y = (cells.select("scope", *[F.col(c).alias(c + z) for c in ("cell", "reach", "centre")]) for z in "xy")
        dot = F.expr("aggregate(zip_with(centrex, centrey, (p, q) -> p * q), 0D, (s, v) -> s + v)")
        apart = F.when(F.col("cellx") == F.col("celly"), 0.0).otherwise(F.coalesce(_theta(1 - dot), F.lit(0.0)))
        near = x.join(y, "scope").where("cellx <= celly").join(limit, "scope").where(apart - F.col("reachx") - F.col("reachy") <= _theta(F.col("eps")) + SLACK)
        pairs = near.select("scope", "cellx", "celly", "eps").join(left, ["scope", "cellx"]).join(right, ["scope", "celly"])
        return pairs.select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "eps").distinct()

    def _compared(self, members: DataFrame, pairs: DataFrame, give: Callable, schema: str) -> DataFrame:
        """Columns, behind the scope, that ``give`` makes of each pair of blocks: of both, whether they are one block, and the distance asked for.

        The vectors of a pair stand together in the order of pairs, sides and cells, so a task holds two blocks at a time.
        """
        pairs = written(pairs.distinct())
        side = lambda name, number: pairs.withColumn("side", F.lit(number)).join(members.withColumnRenamed("block", name), ["scope", name])
        columns = ["scope", "a", "b", "eps", "side", "cell", "rep", "n", "v", "bound"]
        both = side("a", 0).select(columns).unionByName(side("b", 1).where("a <> b").select(columns))
        kinds = {"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}
        shape = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(","))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, rows = [], 0
            for scope, found in answers(batches):
                if len(found[0]):
                    out.append(pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(scope, shape[0].type), len(found[0])), *(pa.array(c, f.type) for c, f in zip(found, list(shape)[1:], strict=True))], schema=shape))
                    rows += len(found[0])
                if rows > 1 << 16:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches(1 << 16)
                    out, rows = [], 0
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches(1 << 16)

        def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            now, rows = None, []
            for batch in batches:
                if not len(batch):
                    continue
                a, b, eps, side, rep, n = (batch[c].to_numpy(zero_copy_only=False) for c in ("a", "b", "eps", "side", "rep", "n"))
                bound, v = batch["bound"].to_numpy(zero_copy_only=False), _matrix(batch["v"])
                bound = np.where(np.isnan(bound), np.inf, bound)
                scope = batch["scope"]
                other = pc.not_equal(scope.slice(1), scope.slice(0, len(scope) - 1)).to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | other) + 1
                for i, j in pairwise([0, *cuts.tolist(), len(a)]):
                    pair = (scope[i].as_py(), int(a[i]), int(b[i]), float(eps[i]))
                    if pair != now:
                        yield from answer(now, rows)
                        now, rows = pair, []
                    rows.append((side[i:j], rep[i:j], n[i:j], v[i:j], bound[i:j]))
            yield from answer(now, rows)

        def answer(pair: tuple, rows: list[tuple]) -> Iterator[tuple]:
            if not rows:
                return
            side, *parts = (np.concatenate(c) for c in zip(*rows, strict=True))
            rows.clear()
            x, y = (tuple(c[side == s] for c in parts) for s in (0, 1))
            same = not len(y[0])
            yield from ((pair[0], found) for found in give(x, x if same else y, same, pair[3]))

        return both.repartition("scope", "a", "b").sortWithinPartitions("scope", "a", "b", "side", "cell").mapInArrow(run, schema)

    def nearest(self, k: int) -> DataFrame:
        """(scope, rep, n, distance): how far the k-th nearest other vector of the scope is; null where there are fewer.

        The k nearest of the own block bound the distance; then the blocks that can hold nearer ones are asked.
        """
        unlimited = self.reps.select("scope").distinct().withColumn("eps", F.lit(2.0))
        members = self.placed.withColumn("bound", F.lit(None).cast("double"))
        schema = f"scope {self.kind}, rep long, distance double, n long"
        first = written(self._compared(members, self._met(unlimited, own=True), _few(k), schema))
        bounded = written(self.placed.join(_kth(self.reps, first, k).select("scope", "rep", F.col("distance").alias("bound")), ["scope", "rep"]))
        reach = bounded.groupBy("scope").agg(F.max(F.coalesce("bound", F.lit(2.0))).alias("eps"))
        return _kth(self.reps, first.unionByName(self._compared(bounded, self._met(reach).where("a <> b"), _few(k), schema)), k)

    def links(self, limit: DataFrame, near: Callable | None = None) -> DataFrame:
        """(scope, a, b): links that connect what the pairs within the distance of ``limit`` (scope, eps) connect.

        ``near`` tells, of cosines and that distance, which pairs those are, if not by the rounded distance.
        """
        members = self.placed.withColumn("bound", F.lit(None).cast("double"))
        return self._compared(members, self._met(limit), _spanning(near or (lambda dots, eps: _rounded(dots) <= eps)), f"scope {self.kind}, a long, b long")

    def within(self, limit: DataFrame) -> DataFrame:
        """(scope, a, b, distance), a < b: all pairs of classes within the distance of ``limit`` (scope, eps)."""
        return self._pairs(limit, lambda x, y, dots, eps: (d := _rounded(dots), d <= eps), "distance")

    def cosines(self, limit: DataFrame) -> DataFrame:
        """(scope, a, b, cosine), a < b: all pairs of classes whose distance, not rounded, is at most that of ``limit``, with their rounded cosine."""
        return self._pairs(limit, _summed, "cosine")

    def _pairs(self, limit: DataFrame, value: Callable, name: str) -> DataFrame:
        members = self.placed.withColumn("bound", F.lit(None).cast("double"))
        return self._compared(members, self._met(limit), _listed(value), f"scope {self.kind}, a long, b long, {name} double")


def _summed(x: np.ndarray, y: np.ndarray, dots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Rounded cosines and which of them count, from products summed one after the other, as SQL does it."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * y[:, i]
    return np.floor(total * 1e6 + 0.5) / 1e6, 1.0 - total <= eps


def _span(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean direction of each chunk, and the widest angle to it."""
    means, reach = [], []
    for i in range(0, len(v), CHUNK):
        mean = v[i : i + CHUNK].mean(axis=0)
        mean = mean / max(np.linalg.norm(mean), 1e-12)
        means.append(mean)
        reach.append(np.arccos(np.clip((v[i : i + CHUNK] @ mean).min(), -1, 1)))
    return np.array(means), np.array(reach)


def _angle(distance):
    return np.arccos(np.clip(1.0 - distance, -1.0, 1.0))


def _runs(chunks: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Rows of neighbouring chunks, a bounded number at once."""
    cuts = np.flatnonzero(np.diff(chunks) != 1) + 1
    for part in np.split(chunks, cuts):
        for i in range(0, len(part), RUN):
            run = part[i : i + RUN]
            yield int(run[0]) * CHUNK, min((int(run[-1]) + 1) * CHUNK, size)


def _met_rows(x: np.ndarray, y: np.ndarray, same: bool, eps: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j) with their cosines, for each chunk of ``x`` and each run of chunks of ``y``, that may be within ``eps``; in one block only i < j."""
    (means, reach), (others, spans) = _span(x), _span(y)
    for p in range(len(means)):
        apart = np.arccos(np.clip(others @ means[p], -1, 1)) - spans - reach[p]
        chunks = np.flatnonzero(apart <= _angle(eps) + SLACK)
        first, last = p * CHUNK, min((p + 1) * CHUNK, len(x))
        for low, high in _runs(chunks[chunks >= p] if same else chunks, len(y)):
            dots = x[first:last] @ y[low:high].T
            i, j = np.nonzero(dots >= 1.0 - eps - CLOSE)
            if same:
                i, j = (z[first + i < low + j] for z in (i, j))
            yield first + i, low + j, dots[i, j]


class _Best:
    """The k nearest found so far of each of some vectors, and the cosine from which others count."""

    def __init__(self, k: int, bound: np.ndarray) -> None:
        self.k, self.bound = k, bound
        self.least = np.where(np.isinf(bound), -np.inf, 1.0 - bound - CLOSE)
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, at: np.ndarray, distance: np.ndarray, n: np.ndarray, most: int) -> None:
        keep = distance <= self.bound[at]
        self.rows.append((at[keep], distance[keep], n[keep]))
        self.held += int(keep.sum())
        if self.held > most:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        at, distance, n = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        order = np.lexsort((distance, at))
        at, distance, n = at[order], distance[order], n[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        last = place == self.k - 1
        self.least[at[last]] = np.maximum(self.least[at[last]], 1.0 - distance[last] - CLOSE)
        kept = place < self.k
        self.rows, self.held = [(at[kept], distance[kept], n[kept])], int(kept.sum())
        return self.rows[0]


def _few(k: int) -> Callable:
    """Up to k nearest vectors of the other block for each one, none beyond its bound."""

    def give(x, y, same, eps):
        (xr, xn, xv, xb), (yr, yn, yv, yb) = x, y
        (means, reach), (others, spans) = _span(xv), _span(yv)
        theirs = _Best(k, yb)
        for p in range(len(means)):
            first, last = p * CHUNK, min((p + 1) * CHUNK, len(xr))
            mine = _Best(k, xb[first:last])

            def ask(low: int, high: int, first=first, last=last, mine=mine) -> None:
                dots = xv[first:last] @ yv[low:high].T
                if same and low < last and first < high:
                    own = np.arange(max(low, first), min(high, last))
                    dots[own - first, own - low] = -np.inf
                i, j = np.nonzero((dots >= mine.least[:, None]) & (dots > -np.inf))
                mine.add(i, _rounded(dots[i, j]), yn[low + j], 4 * k * CHUNK)
                if not same:
                    i, j = np.nonzero(dots >= theirs.least[None, low:high])
                    theirs.add(low + j, _rounded(dots[i, j]), xn[first + i], max(HELD, 2 * k * len(yr)))

            if same:  # the own chunk bounds the others
                ask(first, last)
                mine.best()
            wide = lambda least: np.pi if np.isneginf(least).any() else _angle(1.0 - least.min())
            reaches = np.array([max(wide(mine.least), 0.0 if same else wide(theirs.least[i : i + CHUNK])) for i in range(0, len(yr), CHUNK)])
            chunks = np.flatnonzero(np.arccos(np.clip(others @ means[p], -1, 1)) - spans - reach[p] <= reaches + SLACK)
            for low, high in _runs(chunks[chunks != p] if same else chunks, len(yr)):
                ask(low, high)
            at, distance, n = mine.best()
            yield xr[first + at], distance, n
        at, distance, n = theirs.best()
        yield yr[at], distance, n

    return give


def _kth(reps: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The k-th distance of each class from its nearest classes; its own copies are at distance 0."""
    near = found.groupBy("scope", "rep").agg(F.array_sort(F.collect_list(F.struct("distance", F.col("n").alias("m")))).alias("near"))
    walk = f"aggregate(near, struct(n - 1 AS seen, CAST(IF(n > {k}, 0D, NULL) AS DOUBLE) AS at), (s, x) -> IF(s.seen >= {k}, s, struct(s.seen + x.m AS seen, IF(s.seen + x.m >= {k}, x.distance, CAST(NULL AS DOUBLE)) AS at))).at"
    return reps.select("scope", "rep", "n").join(near, ["scope", "rep"], "left").withColumn("near", F.expr("coalesce(near, CAST(array() AS array<struct<distance:double,m:bigint>>))")).select("scope", "rep", "n", F.expr(walk).alias("distance"))


def _spanning(near: Callable) -> Callable:
    """A star for each component of the links between two blocks."""

    def give(x, y, same, eps):
        shift = 0 if same else len(x[0])
        label = np.arange(shift + len(y[0]))
        for i, j, dots in _met_rows(x[2], y[2], same, eps):
            keep = near(dots, eps)
            _unite(label, i[keep], shift + j[keep])
        reps = x[0] if same else np.concatenate((x[0], y[0]))
        member = np.flatnonzero(label != np.arange(len(label)))
        yield reps[label[member]], reps[member]

    return give


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of linked places; ``label`` has the least place of each component."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, above := label[label]):
            label[:] = above


def _listed(value: Callable) -> Callable:
    """The pairs that count, with a value of each."""

    def give(x, y, same, eps):
        for i, j, dots in _met_rows(x[2], y[2], same, eps):
            for at in range(0, len(i), HELD >> 4):
                a, b, d = (z[at : at + (HELD >> 4)] for z in (i, j, dots))
                of, keep = value(x[2][a], y[2][b], d, eps)
                a, b = x[0][a[keep]], y[0][b[keep]]
                told = a != b
                yield np.minimum(a, b)[told], np.maximum(a, b)[told], of[keep][told]

    return give
