"""The registered queries of the corpus operators; each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from narravane.functions.scratch import folder
from narravane.llm.conversation_repair import repaired
from narravane.llm.decontamination import contaminated
from narravane.llm.licenses import license_report
from narravane.llm.line_quality import quality
from narravane.llm.merge_dropout import round_trip
from narravane.llm.merkle_manifest import manifest
from narravane.llm.ngram_join import near_duplicate_groups
from narravane.llm.personal_data import personal_report
from narravane.llm.phrase_fingerprint import with_next
from narravane.llm.reference import CONVERSATION_SQL, MERKLE_SQL
from narravane.llm.secrets import secret_report
from narravane.llm.sharding import shard_documents
from narravane.llm.token_ledger import rollup
from narravane.llm.url_filter import judged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), rate=0.1, seed=1)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_table(spark, sf_dir, "pages"))


def op3_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def op4_token_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(_table(spark, sf_dir, "documents"), folder(spark))


def op5_quality_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_personal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_report(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=24)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), errors=10)


def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_merge_dropout": op1_merge_dropout,
    "op2_url_filter": op2_url_filter,
    "op3_secret_guess_cost": op3_secret_guess_cost,
    "op4_token_ledger": op4_token_ledger,
    "op5_quality_chain": op5_quality_chain,
    "op6_personal_segments": op6_personal_segments,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_phrase_fingerprint": op8_phrase_fingerprint,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_license_rules": op11_license_rules,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}
#: Sets of words, all pairs that share one, and the closure of the links.
NGRAM_JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g
  FROM words),
sizes AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(g) AS s FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, component_id FROM sizes JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = doc_id
"""
ORACLE_SQL: dict[str, str] = {"op7_ngram_jaccard": NGRAM_JACCARD_SQL, "op12_merkle_manifest": MERKLE_SQL, "op13_conversation_repair": CONVERSATION_SQL}
