"""The domain's relations, derived from landed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narravane.functions.dialect import SPARK, operator
from narravane.functions.places import lagged


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A landed Parquet table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows in as many partitions as the cluster has cores, if a scan of few files gives fewer."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


@operator("events")
def event_posts(d):
    """Posts from an event log: a type is a narrative, a user an author; scores in millionths."""
    return f"""
    SELECT event_id AS post_id, event_type AS narrative, concat('u', CAST(user_id AS STRING)) AS author_id,
           CASE user_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'reddit' ELSE 'mastodon' END AS platform,
           {d.micros("ts")} AS at_us, CAST(CAST(ts AS DATE) AS STRING) AS day,
           CAST(floor(least(1e0, value / 100e0) * 1e6 + 5e-1) AS BIGINT) AS score_u
    FROM events"""


@operator("documents")
def document_posts(d):
    """Posts from documents: a source is a narrative, every 97th document one author, 17 seconds apart."""
    return """
    SELECT doc_id AS post_id, source AS narrative, concat('u', CAST(doc_id % 97 AS STRING)) AS author_id, lang AS platform,
           1704067200000000 + doc_id * 17000000 AS at_us, coalesce(text, '') AS text
    FROM documents"""


@operator("events")
def event_edges(d):
    """Interactions: the author of a post answers the author before in the narrative."""
    return f"""
    WITH pairs AS (
      SELECT event_id AS edge_id, event_type AS narrative, concat('u', CAST(user_id AS STRING)) AS source,
             concat('u', CAST(lag(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS STRING)) AS target,
             CASE event_id % 4 WHEN 0 THEN 'retweet' WHEN 1 THEN 'reply' WHEN 2 THEN 'quote' ELSE 'share' END AS kind, {d.micros("ts")} AS at_us
      FROM events)
    SELECT * FROM pairs WHERE target IS NOT NULL AND target <> 'u'"""


@operator("events")
def sparse_edges(d):
    """Interactions inside forty circles of users, a graph of several parts."""
    return f"""
    WITH pairs AS (
      SELECT event_id AS edge_id, event_type AS narrative, concat('u', CAST(user_id AS STRING)) AS source,
             concat('u', CAST(lag(user_id) OVER (PARTITION BY event_type, user_id % 40 ORDER BY ts, event_id) AS STRING)) AS target, 'reply' AS kind, {d.micros("ts")} AS at_us
      FROM events)
    SELECT * FROM pairs WHERE target IS NOT NULL AND target <> 'u'"""


@operator("customer")
def known_bots(d):
    """Accounts of a bot list: the customers in debt."""
    return "SELECT DISTINCT 'x' AS platform, concat('u', CAST(c_custkey AS STRING)) AS author_id, c_mktsegment AS label FROM customer WHERE c_acctbal < 0"


def _interactions(events: DataFrame, group: list[Column], kind: Column) -> DataFrame:
    """(edge_id, narrative, source, target, kind, at_us): each author answers the one before in the group, found by ranges of time."""
    names = [f"group_{i}" for i in range(len(group))]
    rows = events.select("event_id", "event_type", "user_id", "ts", *[g.alias(n) for g, n in zip(group, names, strict=True)])
    answered = lagged(rows, names, ["ts", "event_id"], F.col("user_id"), "before").where("before IS NOT NULL")
    user = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    return answered.select(F.col("event_id").alias("edge_id"), F.col("event_type").alias("narrative"), user("user_id").alias("source"), user("before").alias("target"), kind.alias("kind"), F.expr(SPARK.micros("ts")).alias("at_us")).where("source IS NOT NULL")


def edges(events: DataFrame) -> DataFrame:
    """What ``event_edges`` gives, without a window over a narrative."""
    of = F.pmod(F.col("event_id"), F.lit(4))
    return _interactions(events, [F.col("event_type")], F.when(of == 0, "retweet").when(of == 1, "reply").when(of == 2, "quote").otherwise("share"))


def circles(events: DataFrame) -> DataFrame:
    """What ``sparse_edges`` gives, without a window over a narrative."""
    return _interactions(events, [F.col("event_type"), F.col("user_id") % 40], F.lit("reply"))
