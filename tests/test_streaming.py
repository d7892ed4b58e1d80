import datetime as dt
import itertools
import random

import pytest
from narravane.operators import bursts
from narravane.streaming import feeds
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("feed"))
    base = dt.datetime(2024, 3, 1)
    rows = [(i, "ab"[i % 2], f"u{i % 7}", base + dt.timedelta(minutes=37 * i), (i * 37 % 100) / 130) for i in range(300)]
    for k, part in enumerate(itertools.batched(rows, 100)):
        again = rows[k * 100 - 5 : k * 100] if k else []
        spark.createDataFrame([*part, *again], feeds.FEED).coalesce(1).write.mode("append").parquet(folder)
    return folder, rows


def test_seen_again_posts_are_dropped(spark, landed, tmp_path):
    folder, rows = landed
    got = feeds.drained(feeds.unique_posts(feeds.feed(spark, folder, 3)), "append", str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r.post_id for r in got.collect()) == [r[0] for r in rows]


def test_daily_windows_equal_the_batch(spark, landed, tmp_path):
    folder, _ = landed
    got = feeds.drained(feeds.daily_windows(feeds.feed(spark, folder, 9), "0 seconds"), "append", str(tmp_path / "o"), str(tmp_path / "c")).collect()
    batch = spark.read.schema(feeds.FEED).parquet(folder).groupBy("narrative", F.to_date("posted_at").alias("day")).count().collect()
    want = {(r["narrative"], r["day"]): r["count"] for r in batch}
    assert got and all(want[(r.narrative, r.day)] == r.posts for r in got)
    assert len(got) >= len(want) - 2  # the open day waits for its watermark


def test_levels_only_rise_and_budgets_hold(spark, landed, tmp_path):
    folder, rows = landed
    moves = feeds.drained(feeds.level_crossings(feeds.feed(spark, folder)), "append", str(tmp_path / "o"), str(tmp_path / "c")).collect()
    for n in "ab":
        top = max(feeds.level_of(r[4]) for r in rows if r[1] == n)
        own = sorted((m.before, m.level) for m in moves if m.narrative == n)
        assert own[0][0] == 0 and own[-1][1] == top and all(a < b for a, b in own)
    used = feeds.drained(feeds.daily_budget(feeds.feed(spark, folder)), "append", str(tmp_path / "p"), str(tmp_path / "d"))
    per_day = used.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if("allowed").alias("ok")).collect()
    assert sum(r.n for r in per_day) == 310 and all(r.ok == min(r.n, feeds.DAILY_CAP) for r in per_day)


def test_upserts_keep_one_row_a_key(spark, landed, tmp_path):
    folder, rows = landed
    feeds.upsert_batches(feeds.feed(spark, folder), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "t").iterdir())
    assert sorted(r.post_id for r in spark.read.parquet(f"{tmp_path}/t/version={last}").collect()) == [r[0] for r in rows]


def test_exact_bursts_equal_the_batch(spark, tmp_path):
    """Bursts across window bounds, of exactly 90 seconds and a little more, and late within the watermark."""
    base, rows = dt.datetime(2024, 3, 1), []
    rng = random.Random(1)
    for i in range(400):
        rows.append((i, "ab"[i % 2], f"u{rng.randrange(9)}", base + dt.timedelta(seconds=rng.randrange(4000), microseconds=rng.choice([0, 1, 999_999])), 0.1))
    rows += [(1000 + i, "c", f"v{i}", base + dt.timedelta(seconds=85 + 22.5 * i), 0.1) for i in range(5)]
    rows += [(2000 + i, "d", f"v{i}", base + dt.timedelta(seconds=85 + 22.5 * i, microseconds=i == 4), 0.1) for i in range(5)]
    end = [(9999, "z", "u", base + dt.timedelta(days=1), 0.1)]
    for k, part in enumerate([rows[::2], rows[1::2], end, [(10_000, "z", "u", base + dt.timedelta(days=2), 0.1)]]):
        spark.createDataFrame(part, feeds.FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / "f" / f"part={k}"))
    stream = spark.readStream.schema(feeds.FEED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "f"))
    got = feeds.drained(feeds.exact_bursts(stream, "2 hours"), "append", str(tmp_path / "o"), str(tmp_path / "c"))
    most = {r.narrative: r.most for r in got.groupBy("narrative").agg(F.max("authors").alias("most")).collect()}
    posts = spark.createDataFrame(rows, feeds.FEED).withColumn("at_us", F.unix_micros("posted_at"))
    want = {r.narrative: r.most_authors for r in bursts.bursts(posts).collect()}
    assert {n: most[n] for n in "abcd"} == want and (want["c"], want["d"]) == (5, 4)
