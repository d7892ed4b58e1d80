"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows fall into logical partitions by a hash of their content.  For partition
sizes n_p and exact shard sizes s_j the driver draws the matrix of counts
"rows of partition p that go to shard j" from the multivariate hypergeometric
law.  Each partition is permuted by a keyed hash and cut into runs by its row
of the matrix, the runs are exchanged, and each shard is permuted by a second
key.  The result is a uniform shuffle in which shard sizes are not random.

Ranks are taken inside buckets of bounded expected size plus an offset, so no
task ever sorts a whole shard.  Everything is a function of the rows and the
seed: a task that is run again makes the same rows.

Repeated rows are numbered, and their numbers are hashed with them, so they are
dealt like any others; they are interchangeable.  The rows (without texts) are
written once before, with a number that tells repeated ones apart.

Cases: a null text counts as empty (size 8, checksum 0), a null id is an id of
its own; very long texts are only measured; an empty table gives an empty
result; columns of the input with the names of the output columns are replaced.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narravane.functions.scratch import written

#: Expected rows of a bucket in which ranks are taken by a sort.
BUCKET_ROWS = 20_000
#: Draws that are made one by one.
FEW_DRAWS = 32


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart that sum up to ``rows``."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def communication_matrix(partition_rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Draw how many rows of each partition go to each shard; rows and columns sum up exactly."""
    rng, left, matrix = np.random.default_rng(seed), np.array(sizes, np.int64), []
    for n in partition_rows:
        row, rest, total = np.zeros(len(left), np.int64), int(n), int(left.sum())
        for j, free in enumerate(left):  # conditional draws; each is a plain hypergeometric one
            total -= int(free)
            row[j] = _hypergeometric(rng, int(free), total, rest)
            rest -= int(row[j])
        left -= row
        matrix.append(row.tolist())
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items of an urn are good, exactly in law for urns of any size.

    Each item is taken with the same chance, so that about ``draws`` are; both numbers are binomial.  Given how many
    that are, they are a uniform subset, so the difference to ``draws`` is drawn from them or from the rest.  It is
    about the square root of ``draws``; a few items are drawn one by one.
    """
    if not 0 <= draws <= good + bad:
        raise ValueError("draws must be from 0 to the number of items")
    if 2 * draws > good + bad:
        return good - _hypergeometric(rng, good, bad, good + bad - draws)
    if draws <= FEW_DRAWS:
        taken = 0
        for i in range(draws):
            taken += int(rng.integers(good + bad - i)) < good - taken
        return taken
    share = draws / (good + bad)
    a, b = int(rng.binomial(good, share)), int(rng.binomial(bad, share))
    if a + b >= draws:
        return a - _hypergeometric(rng, a, b, a + b - draws)
    return a + _hypergeometric(rng, good - a, bad - b, draws - a - b)


def _ranked(df: DataFrame, group: str, key: Column, buckets: int | Column, name: str) -> DataFrame:
    """Adds the 0-based rank of each row in its group by ``key``, a uniform 64-bit hash."""
    df = df.withColumn("_key", key).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_key", 20), buckets if isinstance(buckets, Column) else F.lit(buckets)))
    sizes = df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_bucket").orderBy("_key", *[c for c in df.columns if c not in (group, "_bucket", "_key")])
    ranked = df.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, [group, "_bucket"])
    return ranked.withColumn(name, (F.col("_rank") + F.col("_offset")).cast("long")).drop("_key", "_bucket", "_rank", "_offset")


def _numbered(df: DataFrame, identity: list[str]) -> DataFrame:
    """Adds ``_copy``, which numbers the rows of equal ``identity`` from 0; a large group is numbered by parts."""
    columns = df.columns
    df = written(df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_same", F.xxhash64(*identity)))
    repeated = written(df.groupBy("_same").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1"))
    alone = df.join(repeated, "_same", "left_anti").select(*columns, F.lit(0).cast("long").alias("_copy"))
    several = _ranked(df.join(repeated, "_same"), "_same", F.xxhash64("_row"), F.expr(f"_copies DIV {BUCKET_ROWS} + 1"), "_copy")
    return alone.unionByName(several.select(*columns, "_copy"))


def shuffle_into_shards(df: DataFrame, identity: list[str], shards: int, seed: int = 0, partitions: int = 64) -> DataFrame:
    """Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to the rows of ``df``.

    ``identity``: the columns whose values tell rows apart; ``partitions``: the rows of the matrix.
    """
    if shards < 1 or partitions < 1:
        raise ValueError("shards and partitions must be positive")
    df = _numbered(df.drop("shard", "slot"), identity)
    hashed = lambda salt: F.xxhash64(F.lit(f"{seed}/{salt}"), *identity, "_copy")
    dealt = df.withColumn("_part", F.pmod(hashed("deal"), F.lit(partitions)).cast("int"))
    counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    per_part = [counts.get(p, 0) for p in range(partitions)]
    rows = sum(per_part)
    matrix = communication_matrix(per_part, shard_sizes(rows, shards), seed)
    ends = np.cumsum(np.array(matrix, np.int64).reshape(partitions, shards), axis=1).tolist()
    table = F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")  # folded into one literal
    local = _ranked(dealt, "_part", hashed("local"), rows // (partitions * BUCKET_ROWS) + 1, "_at")
    cut = F.size(F.filter(table[F.col("_part")], lambda end: end <= F.col("_at")))
    sent = local.withColumn("shard", cut.cast("int")).drop("_part", "_at")
    return _ranked(sent, "shard", hashed("final"), rows // (shards * BUCKET_ROWS) + 1, "slot").drop("_copy")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """Deals ``docs`` (doc_id, text) into shards whose counts are at most one apart (law ``rows``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    dealt = shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"], shards, seed)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
