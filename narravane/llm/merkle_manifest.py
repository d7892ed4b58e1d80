"""A Merkle manifest of a dataset: digests, proofs and a check of rows against the root, in SQL functions alone.

Rows are leaves of one tree for each language, and the roots of these trees are
the leaves of one last tree.  Leaves get their places from one range
partitioning; ordered blocks of ``BLOCK`` places become arrays, which
higher-order functions collapse level by level; the roots of blocks are the
leaves of the next round, until each tree has one block.  So a round divides
the rows by ``BLOCK``, no array is longer than that, and texts never leave the
scan: only digests are shuffled.

Cases: a null text, source, language, length or id counts as ``-``; null ids
come first and are not tampered; an empty text is ``0:``.  Rows of one id and
language are ordered by their leaves, so equal rows have equal leaves but places
(and proofs) of their own.  An empty table gives no rows.  Columns beside the
five that are hashed are ignored.  A tree with one leaf has that leaf as root
and no siblings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narravane.functions.scratch import written
from narravane.llm.ordering import in_ranges

#: Nodes that become one node; a block holds ``ARITY ** HEIGHT`` leaves.
ARITY, HEIGHT = 2, 10
BLOCK = ARITY**HEIGHT
#: Copies of the table of trees when it meets the roots of blocks, so that a large tree has many meeting points.
SALTS = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    """Byte count, colon and value; ``-`` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(n_chars: Column) -> Column:
    """The digest of a row, with ``n_chars`` as its length."""
    return F.sha2(F.concat(*[_field(n_chars if name == "n_chars" else F.col(name)) for name in FIELDS]), 256)


def _levels(nodes: str, many: str) -> str:
    """SQL for the levels above an array of digests, itself first.

    A block that is a whole tree ends with one node; one of several has ``HEIGHT`` levels above it, whose last runs may
    hold a single node.
    """
    run = f"sha2(array_join(slice(element_at(levels, -1), i * {ARITY} + 1, {ARITY}), ''), 256)"
    above = f"transform(sequence(0, (size(element_at(levels, -1)) - 1) DIV {ARITY}), i -> {run})"
    return f"aggregate(sequence(1, {HEIGHT}), array({nodes}), (levels, step) -> IF({many} OR size(element_at(levels, -1)) > 1, concat(levels, array({above})), levels))"


def _path(levels: str, at: str) -> str:
    """SQL for the siblings of leaf ``at``: for each level the digests left and right of it in its run."""
    place = f"(CAST({at} AS INT) DIV CAST(power({ARITY}, step) AS INT))"
    first = f"({place} DIV {ARITY} * {ARITY})"
    nodes = f"element_at({levels}, step + 1)"
    # one level has no siblings: sequence() can't be empty, so it is filtered
    steps = f"filter(sequence(0, greatest(size({levels}) - 2, 0)), step -> step < size({levels}) - 1)"
    return f"transform({steps}, step -> struct(array_join(slice({nodes}, {first} + 1, {place} - {first}), '') AS before, array_join(slice({nodes}, {place} + 2, {first} + {ARITY} - {place} - 1), '') AS after))"


def _folded(path: str, leaf: str) -> str:
    """SQL for the root that ``leaf`` and its siblings give."""
    return f"aggregate({path}, {leaf}, (node, step) -> sha2(concat(step.before, node, step.after), 256))"


_PATH = "array<struct<before:string,after:string>>"


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, their place in ``group`` by ``order`` from 0, and ``n``, the rows of the group.

    One range partitioning by group and order, written with the number of the range; a row's place is its place in the
    range and the rows of its group in the ranges before.
    """
    ranged = in_ranges(rows, [group, *order])
    counts = written(ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_k"), F.min("_place").alias("_first")))
    # a row for each range of a group, not for each row
    offsets = counts.selectExpr(f"{group} AS _group", "_range", f"coalesce(sum(_k) OVER (PARTITION BY {group} ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - _first AS _shift", f"sum(_k) OVER (PARTITION BY {group}) AS n")
    joined = ranged.join(offsets.withColumnRenamed("_range", "_of"), (F.col(group) == F.col("_group")) & (F.col("_range") == F.col("_of")))
    return joined.withColumn("at", (F.col("_place") + F.col("_shift")).cast("long")).drop("_place", "_range", "_group", "_of", "_shift")


def _blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """(tree, block, many, rows, items): the ordered leaves of each block; ``nodes`` has (tree, at, n, node) and more."""
    item = F.struct("at", "node", *carried)
    keys = ["tree", F.expr(f"at DIV {BLOCK}").alias("block")]
    return nodes.groupBy(*keys).agg(F.max("n").alias("rows"), F.array_sort(F.collect_list(item)).alias("items")).withColumn("many", F.col("rows") > BLOCK)


def _tops(blocks: DataFrame) -> DataFrame:
    """The root of each block, as the nodes of the next round."""
    levels = _levels("transform(items, x -> x.node)", "many")
    return blocks.selectExpr("tree", "block AS at", f"CAST((rows - 1) DIV {BLOCK} + 1 AS LONG) AS n", f"element_at(element_at({levels}, -1), 1) AS node", "many")


def _above(blocks: DataFrame) -> DataFrame:
    """(tree, block, root, above): the root of the tree of each block, and the siblings on the way there."""
    tops = written(_tops(blocks))
    whole = tops.where("NOT many").selectExpr("tree", "at AS block", "node AS root", f"CAST(array() AS {_PATH}) AS above")
    parts = tops.where("many").drop("many")
    if parts.isEmpty():
        return whole
    return whole.unionByName(_paths(parts).selectExpr("tree", "at AS block", "root", "path AS above"))


def _paths(nodes: DataFrame) -> DataFrame:
    """(tree, at, node, root, path) for nodes with known places."""
    blocks = written(_blocks(nodes))
    joined = blocks.join(_above(blocks), ["tree", "block"])
    levels = _levels("transform(items, x -> x.node)", "many")
    # the levels stand in an array of their own, so they are made once for a block
    rows = f"transform(array({levels}), levels -> transform(items, (x, i) -> struct(x.at AS at, x.node AS node, concat({_path('levels', 'i')}, above) AS path)))[0]"
    return joined.select("tree", "root", F.explode(F.expr(rows)).alias("x")).select("tree", "x.at", "x.node", "root", "x.path")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``; see the contract of the query."""
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    length = F.col("n_chars").cast("long")
    leaves = docs.select(
        # languages in the order of the last tree: null first, then by bytes
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(length).alias("node"),
        F.when(tampered & length.isNotNull(), leaf_of(length + 1)).alias("forged"),
    )
    blocks = written(_blocks(numbered(leaves, "tree", ["doc_id", "node"]), "doc_id", "forged"))
    above = written(_above(blocks))
    trees = above.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("node"))
    trees = written(numbered(trees, "tree", ["lang"]))
    roots = _paths(trees).select("at", F.col("root").alias("top"), F.col("path").alias("last")).join(trees.select("at", "lang"), "at").drop("at")
    salted = roots.select(F.col("lang").alias("tree"), "top", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    ways = above.withColumn("_salt", F.pmod("block", F.lit(SALTS)).cast("int")).join(salted, ["tree", "_salt"])
    ways = ways.select("tree", "block", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("above", "last").alias("above"))

    path = f"concat({_path('levels', 'i')}, above)"
    row = f"struct(x.doc_id AS doc_id, x.node AS leaf, sha2(array_join(transform(path, s -> concat(s.before, s.after)), ''), 256) AS proof_sha256, {_folded('path', 'coalesce(x.forged, x.node)')} AS folded_root)"
    rows = f"transform(array({_levels('transform(items, x -> x.node)', 'many')}), levels -> transform(items, (x, i) -> transform(array({path}), path -> {row})[0]))[0]"
    out = blocks.join(ways, ["tree", "block"]).select("subroot", "root", F.explode(F.expr(rows)).alias("x"))
    return out.select("x.doc_id", "x.leaf", "subroot", "root", "x.proof_sha256", "x.folded_root", (F.col("x.folded_root") == F.col("root")).alias("verified"))
