"""Readers of landed files: bot lists, logs, job files, and nested API payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIGHTING = "narrative_name string, platform string, event string, post_id string, at string"
RUN = "keywords array<string>, fetched long, inserted long, net_new long, skipped boolean, at string"
JOB = (
    "narrative_name string, platform string, keywords array<string>, limit int, fallback_platforms array<string>, "
    "x_exclude_terms array<string>, rotation_strategy string, author_watch_enabled boolean"
)
_USER = "core: struct<user_results: struct<result: struct<rest_id: string, legacy: struct<screen_name: string>>>>"
_LEGACY = (
    "legacy: struct<full_text: string, created_at: string, in_reply_to_status_id_str: string, in_reply_to_user_id_str: string, "
    f"quoted_status_id_str: string, retweeted_status_result: struct<result: struct<rest_id: string, {_USER}>>>"
)
_POST = f"rest_id: string, {_USER}, {_LEGACY}, note_tweet: struct<note_tweet_results: struct<result: struct<text: string>>>"
_CONTENT = f"itemContent: struct<tweet_results: struct<result: struct<{_POST}, tweet: struct<{_POST}>>>>"
TIMELINE = f"struct<instructions: array<struct<entries: array<struct<entryId: string, content: struct<cursorType: string, value: string, {_CONTENT}, items: array<struct<item: struct<{_CONTENT}>>>>>>>>>"


def bot_list(spark: SparkSession, path: str) -> DataFrame:
    """(author_id, label) of a TSV file; blank lines, comments and rows without both fields are left out."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="author_id string, label string", mode="PERMISSIVE")
    return rows.select(F.trim("author_id").alias("author_id"), F.trim("label").alias("label")).where("author_id <> '' AND label IS NOT NULL")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL log; lines that don't parse are dropped."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """The jobs of a configuration file, a row each."""
    rows = spark.read.json(path, schema=f"jobs array<struct<{_struct(JOB)}>>", multiLine=True)
    return rows.select(F.inline("jobs"))


def _struct(fields: str) -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", "))


def timeline(payloads: DataFrame, column: str = "body", path: str = "$.data.search_by_raw_query.search_timeline.timeline") -> DataFrame:
    """Flat posts of nested timeline payloads; entries without a post, such as tombstones, are left out.

    Long-form text goes before the short form; a post may be wrapped once more.
    """
    parsed = payloads.select(F.from_json(F.get_json_object(column, path), TIMELINE).alias("t"))
    entries = parsed.select(F.explode("t.instructions").alias("i")).select(F.explode("i.entries").alias("e"))
    direct = entries.select(F.col("e.content.itemContent.tweet_results.result").alias("r"))
    nested = entries.select(F.explode("e.content.items").alias("x")).select(F.col("x.item.itemContent.tweet_results.result").alias("r"))
    rows = direct.unionByName(nested).where("r IS NOT NULL")
    pick = lambda name: F.coalesce(F.col(f"r.{name}"), F.col(f"r.tweet.{name}"))
    flat = rows.select(
        pick("rest_id").alias("external_id"),
        pick("core.user_results.result.rest_id").alias("author_id"),
        pick("core.user_results.result.legacy.screen_name").alias("author_handle"),
        F.coalesce(pick("note_tweet.note_tweet_results.result.text"), pick("legacy.full_text")).alias("text"),
        F.try_to_timestamp(F.substring(pick("legacy.created_at"), 5, 26), F.lit("MMM dd HH:mm:ss Z yyyy")).alias("posted_at"),
        pick("legacy.in_reply_to_status_id_str").alias("reply_to"),
        pick("legacy.in_reply_to_user_id_str").alias("reply_author"),
        pick("legacy.quoted_status_id_str").alias("quoted"),
        pick("legacy.retweeted_status_result.result.rest_id").alias("retweeted"),
        pick("legacy.retweeted_status_result.result.core.user_results.result.rest_id").alias("retweeted_author"),
    )
    return flat.where("external_id IS NOT NULL AND text IS NOT NULL")


def bottom_cursor(payloads: DataFrame, column: str = "body", path: str = "$.data.search_by_raw_query.search_timeline.timeline") -> DataFrame:
    """The value of each payload's bottom cursor."""
    entries = payloads.select(F.from_json(F.get_json_object(column, path), TIMELINE).alias("t")).select(F.explode("t.instructions").alias("i")).select(F.explode("i.entries").alias("e"))
    return entries.where("e.content.cursorType = 'Bottom'").select(F.col("e.content.value").alias("cursor"))


def interactions(posts: DataFrame) -> DataFrame:
    """Edges of flat posts: a retweet, else a quote; and a reply."""
    edge = lambda kind, post, author: F.struct(F.lit(kind).alias("kind"), post.alias("target_post"), author.alias("target_author"))
    none = F.lit(None).cast("string")
    share = F.when(F.col("retweeted").isNotNull(), edge("retweet", F.col("retweeted"), F.col("retweeted_author"))).when(F.col("quoted").isNotNull(), edge("quote", F.col("quoted"), none))
    reply = F.when(F.col("reply_to").isNotNull(), edge("reply", F.col("reply_to"), F.col("reply_author")))
    return posts.select("external_id", F.col("author_id").alias("source_author"), F.explode(F.array_compact(F.array(share, reply))).alias("x")).select("external_id", "source_author", "x.*")


def statuses_with_boosts(statuses: DataFrame) -> DataFrame:
    """Each status and, for a boost, the boosted original too: (external_id, author_id, html, boost_of)."""
    own = F.struct(F.col("id").alias("external_id"), F.col("account.id").alias("author_id"), F.col("content").alias("html"), F.col("reblog.id").alias("boost_of"))
    original = F.when(F.col("reblog").isNotNull(), F.struct(F.col("reblog.id").alias("external_id"), F.col("reblog.account.id").alias("author_id"), F.col("reblog.content").alias("html"), F.lit(None).cast("string").alias("boost_of")))
    return statuses.select(F.explode(F.array_compact(F.array(original, own))).alias("s")).select("s.*")


def first_seen(posts: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """One row for each external_id, the first in ``order``; at most ``limit`` of them in all."""
    first = posts.withColumn("_k", F.row_number().over(Window.partitionBy("external_id").orderBy(*order))).where("_k = 1").drop("_k")
    return first.orderBy(*order).limit(limit) if limit is not None else first


def missing_targets(posts: DataFrame, limit: int = 5) -> DataFrame:
    """Ids that posts answer but that are not among them, the first few."""
    wanted = posts.where("reply_to IS NOT NULL").select(F.col("reply_to").alias("external_id")).distinct()
    return wanted.join(posts.select("external_id"), "external_id", "left_anti").orderBy("external_id").limit(limit)


def stable_author_id(text: Column) -> Column:
    return F.concat(F.lit("te_"), F.substring(F.sha2(text, 256), 1, 12))


def quota(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def synthetic_posts(spark: SparkSession, count: int, authors: int = 7, templates: tuple[str, ...] = ("wake up", "calm day", "share this", "nothing new")) -> DataFrame:
    """Generated posts, deterministic in their number."""
    texts = F.array(*map(F.lit, templates))
    return spark.range(count).select(
        F.concat(F.lit("mock_"), "id").alias("external_id"),
        F.concat(F.lit("author_"), F.pmod("id", F.lit(authors))).alias("author_id"),
        F.element_at(texts, (F.pmod("id", F.lit(len(templates))) + 1).cast("int")).alias("text"),
    )
