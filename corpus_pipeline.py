"""Corpus cleaning in stages; each stage works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the
last return the columns of ``docs``; the last returns what it made of the rest.

Rows keep their doc_id.  Null texts pass the stages that judge texts by their
content if their score allows it; an empty table passes all of them.  Redaction
leaves null and empty texts alone and takes texts of any length whole; encoding
gives them no ids.  Rows that repeat others are treated as those are, but for
near duplicates, where one of them stays.

A stage bounds the Arrow batches of the session, since workers and executors
hold whole batches; its rows don't depend on them.  Stages are lazy, so the
setting stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narravane.functions.scratch import written
from narravane.llm.decontamination import contaminated
from narravane.llm.line_quality import THRESHOLD, score, train
from narravane.llm.merge_dropout import with_ids
from narravane.llm.ngram_join import near_duplicate_groups
from narravane.llm.secrets import without_secrets

#: Bytes after which a batch for a Python worker ends; by default Spark makes one of a whole partition of up to 64 MB.
BATCH_BYTES = 1 << 18
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of Arrow batches to ``BATCH_BYTES``; the row that reaches it ends a batch."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line chain scores below its threshold."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    other = "score" in docs.columns  # an input column of that name stays
    judged = score(docs.withColumnRenamed("score", "_score") if other else docs, train(docs, labels)).where(F.col("score") >= THRESHOLD).drop("score")
    return judged.withColumnRenamed("_score", "score").select(docs.columns) if other else judged


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group (five-word shingles, similarity 0.8 or more).

    Rows that repeat an id are one document, of which the least row by text and columns stays.  Rows without an id are
    told apart by their texts, and come after all ids.
    """
    small_batches(spark)
    nameless = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2).bitwiseOR(F.lit(1 << 62))
    keyed = docs.withColumn("_pipeline_key", F.coalesce(F.col("doc_id").cast("long"), nameless))
    groups = near_duplicate_groups(keyed.select(F.col("_pipeline_key").alias("doc_id"), "text"), n=5, percent=80)
    others = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_pipeline_key")).distinct())
    kept = keyed.join(others, "_pipeline_key", "left_anti")
    repeated = written(kept.groupBy("_pipeline_key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("_pipeline_key"))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    row = F.struct("text", *[c for c in docs.columns if c != "text"])
    first = kept.join(repeated, "_pipeline_key", "left_semi").groupBy("_pipeline_key").agg(F.min(row).alias("row")).select("row.*")
    return kept.join(repeated, "_pipeline_key", "left_anti").select(docs.columns).unionByName(first).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark item occurs, up to its edit budget; the text alone decides."""
    small_batches(spark)
    keyed = docs.withColumn("_pipeline_key", F.xxhash64("text"))
    found = contaminated(keyed.select(F.col("_pipeline_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), errors=10)
    leaking = written(found.select(F.col("doc_id").alias("_pipeline_key")).distinct())
    return keyed.join(leaking, "_pipeline_key", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a mark; n_chars follows the text."""
    small_batches(spark)
    return without_secrets(docs)


def encode_with_dropout(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, ids): the documents as token ids, segmented with merge-dropout."""
    small_batches(spark)
    return with_ids(docs, rate=0.1, seed=1).select("doc_id", "lang", "source", "n_chars", "ids")


STAGES = [
    ("quality", keep_good_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("encoding", encode_with_dropout),
]
#: SQL can express neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
