"""Vectors of texts, kept by content: a text is encoded once, whatever posts have it.

A store is a folder with vectors in buckets of their content key, and commits.  A
bucket is written as a whole under a new name, and a commit says which name each
bucket has from then on; so a run that fails or is repeated leaves the vectors
as they were, and a reader sees whole commits only.  Only buckets that a run
touches are read and written.

Cases: null texts have no vector; an empty text, or one without words, has a
vector of zeros.  One writer at a time: two that start from one commit would both
be kept, the later one with the buckets it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narravane.functions.scratch import written

#: Buckets of a store, and numbers of a vector.
BUCKETS, WIDTH = 64, 384
_ROWS = "bucket int, key string, vector array<float>"
_COMMITS = "number long, bucket int, folder string"


def key_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _bucket(key: Column) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int")


def hashed_terms(texts: DataFrame) -> DataFrame:
    """(key, vector) of distinct texts (key, text): words and pairs of words hashed to a fixed width, sublinear and of unit length."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9']{2,}"), F.lit(0))
    pairs = F.expr("IF(size(words) < 2, CAST(array() AS array<string>), transform(sequence(0, size(words) - 2), i -> concat_ws(' ', words[i], words[i + 1])))")
    terms = texts.withColumn("words", words).select("key", F.explode(F.concat("words", pairs)).alias("term"))
    slots = terms.groupBy("key", F.pmod(F.xxhash64("term"), F.lit(WIDTH)).cast("int").alias("slot"), F.when(F.xxhash64(F.lit("sign"), "term") < 0, -1).otherwise(1).alias("sign")).agg((1 + F.log(F.count(F.lit(1)))).alias("w"))
    values = slots.groupBy("key", "slot").agg(F.sum(F.col("sign") * F.col("w")).alias("w"))
    by_slot = values.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("at"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    vector = F.expr(f"transform(sequence(0, {WIDTH - 1}), i -> CAST(IF(coalesce(size, 0D) > 0D, coalesce(at[i], 0D) / size, 0D) AS FLOAT))")
    return texts.select("key").join(by_slot, "key", "left").select("key", vector.alias("vector"))


def _commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_COMMITS).parquet(f"{path}/commits")
    except AnalysisException:  # a store without a commit
        return spark.createDataFrame([], _COMMITS)


def stored(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """(bucket, key, vector) of a store, or of some of its buckets."""
    last = _commits(spark, path).groupBy("bucket").agg(F.max_by("folder", "number").alias("folder"))
    folders = sorted(r.folder for r in (last if buckets is None else last.where(F.col("bucket").isin(buckets))).collect())  # a row for each bucket
    return spark.read.schema(_ROWS).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], _ROWS)


def resolve(posts: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame] = hashed_terms) -> tuple[DataFrame, int]:
    """(post_id, vector) of posts (post_id, text), and how many texts had to be encoded for it; these are stored.

    ``encode`` gives (key, vector) for (key, text).
    """
    spark = posts.sparkSession
    keyed = posts.where("text IS NOT NULL").select("post_id", "text", key_of(F.col("text")).alias("key"))
    texts = written(keyed.groupBy("key").agg(F.min("text").alias("text")).withColumn("bucket", _bucket(F.col("key"))))
    touched = [r.bucket for r in texts.select("bucket").distinct().collect()]  # at most BUCKETS
    known = stored(spark, path, touched)
    absent = written(texts.join(known.select("key"), "key", "left_anti"))
    fresh = absent.count()
    if fresh:
        new = written(encode(absent.select("key", "text")).join(absent.select("key", "bucket"), "key").select("bucket", "key", "vector"))
        changed = [r.bucket for r in new.select("bucket").distinct().collect()]
        run = uuid.uuid4().hex
        kept = known.where(F.col("bucket").isin(changed)).unionByName(new).withColumn("of", F.col("bucket"))
        kept.repartition(len(changed), "of").write.partitionBy("of").parquet(f"{path}/{run}")
        number = (_commits(spark, path).agg(F.max("number")).first()[0] or 0) + 1
        commit = spark.createDataFrame([(number, b, f"{run}/of={b}") for b in changed], _COMMITS)
        commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
        known = stored(spark, path, touched)
    return keyed.select("post_id", "key").join(known.select("key", "vector"), "key").select("post_id", "vector"), fresh


def runs(docs: DataFrame, path: str) -> DataFrame:
    """(run, texts, encoded, stored) of three runs over a new store: every second document, all, and all again."""
    spark, out = docs.sparkSession, []
    posts = docs.selectExpr("doc_id AS post_id", "text")
    for run, some in enumerate((posts.where("post_id % 2 = 0"), posts, posts), 1):
        vectors, encoded = resolve(some, path)
        out.append((run, vectors.count(), encoded, stored(spark, path).count()))
    return spark.createDataFrame(out, "run long, texts long, encoded long, stored long")


#: DuckDB text for ``runs`` over ``documents``.
RUNS_SQL = """
WITH s AS (SELECT count(*) FILTER (WHERE doc_id % 2 = 0) AS half, count(*) AS whole, count(DISTINCT text) FILTER (WHERE doc_id % 2 = 0) AS first, count(DISTINCT text) AS every FROM documents WHERE text IS NOT NULL)
SELECT CAST(1 AS BIGINT) AS run, half AS texts, first AS encoded, first AS stored FROM s UNION ALL SELECT 2, whole, every - first, every FROM s UNION ALL SELECT 3, whole, 0, every FROM s"""


def as_bytes(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``vector`` as little-endian 32-bit numbers in one binary value."""

    def run(batches):
        for batch in batches:
            packed = [None if v is None else np.asarray(v, "<f4").tobytes() for v in batch["vector"].to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("vector"), "vector", pa.array(packed, pa.binary()))

    return vectors.mapInArrow(run, ", ".join(f"{f.name} {'binary' if f.name == 'vector' else f.dataType.simpleString()}" for f in vectors.schema))


def from_bytes(vectors: DataFrame) -> DataFrame:
    """The reverse of ``as_bytes``."""

    def run(batches):
        for batch in batches:
            lists = [None if v is None else np.frombuffer(v, "<f4").tolist() for v in batch["vector"].to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("vector"), "vector", pa.array(lists, pa.list_(pa.float32())))

    return vectors.mapInArrow(run, ", ".join(f"{f.name} {'array<float>' if f.name == 'vector' else f.dataType.simpleString()}" for f in vectors.schema))
