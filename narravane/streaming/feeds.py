"""Structured Streaming twins of the batch operators over a feed of posts.

A feed is a folder of Parquet files with (post_id long, narrative string,
author_id string, posted_at timestamp, score double).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FEED = "post_id long, narrative string, author_id string, posted_at timestamp, score double"
#: Watch levels of a score (fixed values).
LEVELS = ((0.65, 3), (0.55, 2), (0.38, 1))
#: Seconds of a burst (fixed value).
BURST_S = 90
#: Requests allowed in a day (fixed value).
DAILY_CAP = 45


def feed(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unique_posts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Posts without those seen again within the watermark."""
    return stream.withWatermark("posted_at", late).dropDuplicatesWithinWatermark(["narrative", "post_id"])


def daily_windows(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Posts and mean score by narrative and tumbling day."""
    windows = stream.withWatermark("posted_at", late).groupBy("narrative", F.window("posted_at", "1 day"))
    return windows.agg(F.count(F.lit(1)).alias("posts"), F.avg("score").alias("mean_score")).select("narrative", F.to_date("window.start").alias("day"), "posts", "mean_score")


def sliding_bursts(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """About how many authors of a narrative post within 90 seconds, by windows that slide ten seconds.

    A burst that spans more than 80 seconds may lie in no window as a whole, and authors are counted by a sketch;
    ``exact_bursts`` misses nothing.
    """
    windows = stream.withWatermark("posted_at", late).groupBy("narrative", F.window("posted_at", "90 seconds", "10 seconds"))
    return windows.agg(F.approx_count_distinct("author_id").alias("authors")).select("narrative", F.col("window.start").alias("start"), "authors")


def exact_bursts(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(narrative, start, authors): the most authors of a narrative within 90 seconds, bounds included, for each 90 seconds of its feed.

    Windows of 180 seconds start every 90, so the 90 seconds up to a post in the later half of a window lie in it whole,
    and each post is in the later half of one window.  The state holds the posts of open windows, each of them twice.
    """
    windows = stream.withWatermark("posted_at", late).groupBy("narrative", F.window("posted_at", f"{2 * BURST_S} seconds", f"{BURST_S} seconds"))
    held = windows.agg(F.collect_list(F.struct(F.unix_micros("posted_at").alias("at"), "author_id")).alias("posts"), F.min(F.unix_micros("window.start")).alias("start_us"))
    return held.select("narrative", F.col("window.start").alias("start"), "start_us", "posts").mapInPandas(_most_authors, "narrative string, start timestamp, authors long")


def _most_authors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        most = []
        for start, posts in zip(frame["start_us"], frame["posts"], strict=True):
            rows = sorted((p["at"], p["author_id"]) for p in posts)
            best, inside, first, later = 0, Counter(), 0, int(start) + BURST_S * 1_000_000
            for at, author in rows:
                inside[author] += 1
                while rows[first][0] < at - BURST_S * 1_000_000:
                    inside[rows[first][1]] -= 1
                    if not inside[rows[first][1]]:
                        del inside[rows[first][1]]
                    first += 1
                if at >= later:
                    best = max(best, len(inside))
            most.append(best)
        out = frame[["narrative", "start"]].assign(authors=most)
        yield out[out["authors"] > 0]


def author_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Posts of an author in sessions that end with a gap."""
    sessions = stream.withWatermark("posted_at", late).groupBy("author_id", F.session_window("posted_at", gap).alias("s"))
    return sessions.agg(F.count(F.lit(1)).alias("posts")).select("author_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "posts")


def level_of(score: float) -> int:
    return next((level for least, level in LEVELS if score >= least), 0)


def _crossings(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (before,) = state.get if state.exists else (0,)
    now = max([before, *(level_of(float(f["score"].max())) for f in frames)])
    state.update((now,))
    if now > before:
        yield pd.DataFrame({"narrative": [key[0]], "before": [before], "level": [now]})


def level_crossings(stream: DataFrame) -> DataFrame:
    """Upward moves of a narrative's watch level; the level so far is state."""
    return stream.groupBy("narrative").applyInPandasWithState(_crossings, "narrative string, before int, level int", "level int", "append", GroupStateTimeout.NoTimeout)


def _budget(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (used,) = state.get if state.exists else (0,)
    for frame in frames:
        ids = frame.sort_values(["posted_at", "post_id"])["post_id"].tolist()
        yield pd.DataFrame({"day": [key[0]] * len(ids), "post_id": ids, "allowed": [used + i < DAILY_CAP for i in range(len(ids))]})
        used += len(ids)
    state.update((used,))


def daily_budget(stream: DataFrame) -> DataFrame:
    """Whether a request is within its day's cap; what the day has used is state."""
    by_day = stream.withColumn("day", F.date_format("posted_at", "yyyy-MM-dd")).groupBy("day")
    return by_day.applyInPandasWithState(_budget, "day string, post_id long, allowed boolean", "used int", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Micro-batches merged into a table by (narrative, post_id): versions as folders, the newest one wins.

    A batch that is run again writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy("narrative", "post_id").agg(F.max_by(F.struct("author_id", "posted_at", "score"), "posted_at").alias("v")).select("narrative", "post_id", "v.*")
        if number:
            old = spark.read.schema(latest.schema).parquet(f"{target}/version={number - 1}")
            latest = latest.unionByName(old.join(latest, ["narrative", "post_id"], "left_anti"))
        latest.write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, mode: str, sink: str, checkpoint: str) -> DataFrame:
    """Runs a query over all that has landed and reads what it wrote."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)
