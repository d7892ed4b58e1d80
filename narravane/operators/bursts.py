"""Copied texts and synchronised posting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.functions.dialect import operator, rounded, with_inputs
from narravane.functions.places import lagged

#: A burst is five authors or more within 90 seconds; texts are compared by 280 characters.
WINDOW_US, BURST_AUTHORS, NORMAL_CHARS = 90_000_000, 5, 280


def burst_authors(d, source: str, group: str) -> str:
    """Text for (group, burst_authors): the most authors of a group within 90 seconds, bounds included.

    Rows stand in buckets of that length, and once more in the bucket after; so no window is longer than two buckets.
    """
    frame = f"ORDER BY at_us RANGE BETWEEN {WINDOW_US} PRECEDING AND CURRENT ROW"
    if d.name == "duckdb":
        return f"SELECT {group}, max(near) AS burst_authors FROM (SELECT {group}, count(DISTINCT author_id) OVER (PARTITION BY {group} {frame}) AS near FROM {source}) w GROUP BY {group}"
    twice = f"SELECT {group}, author_id, at_us, at_us DIV {WINDOW_US} + o AS bucket, o = 0 AS own FROM {source} LATERAL VIEW explode(array(0, 1)) x AS o"
    return f"SELECT {group}, max(near) AS burst_authors FROM (SELECT {group}, own, CAST(size(collect_set(author_id) OVER (PARTITION BY {group}, bucket {frame})) AS BIGINT) AS near FROM ({twice}) b) w WHERE own GROUP BY {group}"


@operator("posts")
def normalized(d):
    """Posts with their normal text: lower case, white space collapsed, the first characters."""
    return f"SELECT post_id, narrative, author_id, at_us, text, substring(trim({d.replace('lower(text)', '[ \\t\\n\\r\\f]+', ' ')}), 1, {NORMAL_CHARS}) AS normal FROM posts"


@operator("gapped")
def copy_report(d):
    """Texts that several posts share: posts, authors, span and shortest gap in seconds, bursts, and the first text.

    ``gapped`` has the time of the copy before in ``before_us``.
    """
    return f"""
    WITH a AS (
      SELECT normal, min(post_id) AS first_post, count(*) AS posts, count(DISTINCT author_id) AS authors, {d.join_set("author_id")} AS author_ids, max(at_us) - min(at_us) AS span, min(at_us - before_us) AS gap, substring(min_by(text, post_id), 1, 240) AS sample
      FROM gapped GROUP BY normal HAVING count(*) >= 2),
    r AS (SELECT g.normal, g.author_id, g.at_us FROM gapped g JOIN a ON g.normal = a.normal), n AS ({burst_authors(d, "r", "normal")})
    SELECT a.first_post, a.posts, a.authors, a.author_ids, {rounded("CAST(a.span AS DOUBLE) / 1e6", 1)} AS span_s, {rounded("CAST(a.gap AS DOUBLE) / 1e6", 1)} AS gap_s, n.burst_authors, n.burst_authors >= {BURST_AUTHORS} AS burst, a.sample
    FROM a JOIN n ON a.normal = n.normal"""


def exact_copies(normal_posts: DataFrame) -> DataFrame:
    """``copy_report`` of posts with their normal text; a text that a third of all posts share is in many ranges."""
    return copy_report(lagged(normal_posts.where("normal <> ''"), ["normal"], ["at_us", "post_id"], F.col("at_us"), "before_us"))


#: DuckDB text for ``exact_copies`` over ``normal_posts``.
COPIES_SQL = with_inputs(copy_report.reference(), {"gapped": "SELECT *, lag(at_us) OVER (PARTITION BY normal ORDER BY at_us, post_id) AS before_us FROM normal_posts WHERE normal <> ''"})


@operator("posts")
def copy_keys(d):
    """Keys that stand in a table more than once."""
    return "SELECT narrative, author_id, at_us, count(*) AS copies FROM posts GROUP BY narrative, author_id, at_us HAVING count(*) > 1"


@operator("posts")
def bursts(d):
    """Most authors of a narrative within 90 seconds, bounds included."""
    return f"""
    SELECT narrative, burst_authors AS most_authors, burst_authors >= {BURST_AUTHORS} AS burst FROM ({burst_authors(d, "posts", "narrative")}) n"""


@operator("gapped")
def gap_report(d):
    """Span and shortest gap between the posts of a narrative, in seconds; ``gapped`` has the time of the post before."""
    return f"""
    SELECT narrative, count(*) AS posts, {rounded("CAST(max(at_us) - min(at_us) AS DOUBLE) / 1e6", 3)} AS span_s, {rounded("CAST(min(at_us - before_us) AS DOUBLE) / 1e6", 3)} AS gap_s FROM gapped GROUP BY narrative"""


def gaps(posts: DataFrame) -> DataFrame:
    """``gap_report`` of posts; a large narrative is in many ranges of time."""
    return gap_report(lagged(posts.select("narrative", "at_us", "post_id"), ["narrative"], ["at_us", "post_id"], F.col("at_us"), "before_us"))


#: DuckDB text for ``gaps`` over ``posts``.
GAPS_SQL = with_inputs(gap_report.reference(), {"gapped": "SELECT *, lag(at_us) OVER (PARTITION BY narrative ORDER BY at_us, post_id) AS before_us FROM posts"})
