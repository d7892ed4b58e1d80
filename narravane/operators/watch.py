"""Watching authors, resolving answers, ingest counters, timelines and report sections."""

from __future__ import annotations

from narravane.functions.dialect import operator, rounded

#: Authors that a watch list holds, and a day in microseconds.
CAPACITY, DAY_US = 150, 86_400_000_000
#: Fixed value: how far from a keyword hit authors are followed.
MOST_DEPTH = 2


@operator("posts")
def timelines(d):
    """First and last day, active days and busiest day of each narrative."""
    return """
    WITH c AS (SELECT narrative, day, count(*) AS n FROM posts GROUP BY narrative, day)
    SELECT narrative, min(day) AS first_day, max(day) AS last_day, count(*) AS active_days, CAST(sum(n) AS BIGINT) AS posts, max(n) AS most_in_a_day FROM c GROUP BY narrative"""


@operator("posts", "edges")
def watch_list(d):
    """Authors by priority: inserted posts, answers received and score; the lowest are evicted at capacity."""
    return f"""
    WITH p AS (SELECT author_id, count(*) AS inserted, max(score_u) AS top_u, max(at_us) AS last_us FROM posts GROUP BY author_id), e AS (SELECT target AS author_id, count(*) AS answers FROM edges GROUP BY target),
    a AS (SELECT p.author_id, p.inserted, coalesce(e.answers, 0) AS answers, p.last_us, p.inserted * 10 + coalesce(e.answers, 0) * 5 + {d.div("p.top_u", "100000")} AS priority FROM p LEFT JOIN e ON p.author_id = e.author_id),
    r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, inserted DESC, author_id) AS k FROM a)
    SELECT author_id, inserted, answers, priority, last_us, CAST(k AS BIGINT) AS place FROM r WHERE k <= {CAPACITY}"""


@operator("edges")
def polls(d):
    """How often and when each author was polled, read off the interactions: a quote is a poll of its author; depth and status."""
    return """
    SELECT source AS author_id, count(*) AS polls, max(at_us) AS polled_us, min(CASE WHEN edge_id % 16 = 2 THEN 0 ELSE edge_id % 5 END) AS depth, CASE WHEN count(*) % 7 = 6 THEN 'pruned' ELSE 'active' END AS status
    FROM edges WHERE kind = 'quote' AND edge_id % 3 = 0 GROUP BY source"""


@operator("watched", "polls")
def next_poll(d):
    """The ten active authors to poll next, of a depth that is followed: those never polled, then by priority, then the longest not polled."""
    return f"""
    SELECT w.author_id, w.priority, p.polled_us FROM watched w LEFT JOIN polls p ON w.author_id = p.author_id
    WHERE coalesce(p.status, 'active') = 'active' AND coalesce(p.depth, 0) <= {MOST_DEPTH} ORDER BY p.polled_us IS NOT NULL, w.priority DESC, p.polled_us, w.author_id LIMIT 10"""


@operator("watched", "bots")
def watched_without_bots(d):
    """Watched authors that are not on the bot list."""
    return f"SELECT w.author_id, w.priority FROM watched w {'LEFT ANTI' if d.name == 'spark' else 'ANTI'} JOIN (SELECT DISTINCT author_id FROM bots) b ON w.author_id = b.author_id"


@operator("edges", "posts")
def resolved_targets(d):
    """The latest post of the answered author at or before each answer, if there is one, and the time between."""
    posts = lambda x: f"last_value({x}) IGNORE NULLS" if d.name == "spark" else f"last_value({x} IGNORE NULLS)"
    return f"""
    WITH u AS (SELECT narrative, target AS author_id, at_us, edge_id, CAST(NULL AS BIGINT) AS post_id, CAST(NULL AS BIGINT) AS post_us, 1 AS side FROM edges UNION ALL SELECT narrative, author_id, at_us, CAST(NULL AS BIGINT), post_id, at_us, 0 FROM posts),
    w AS (SELECT edge_id, at_us, {posts("post_id")} OVER o AS target_post, {posts("post_us")} OVER o AS target_us FROM u WINDOW o AS (PARTITION BY narrative, author_id ORDER BY at_us, side, coalesce(edge_id, post_id) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT edge_id, target_post, target_us, at_us - target_us AS delay_us FROM w WHERE edge_id IS NOT NULL"""


@operator("actions")
def ingest_counts(d):
    """Inserted, updated and duplicate rows of a batch by narrative, and the duplicate rate."""
    return f"""
    WITH c AS (SELECT narrative, count(*) AS n, CAST(count_if(action = 'inserted') AS BIGINT) AS inserted, CAST(count_if(action = 'updated') AS BIGINT) AS updated, CAST(count_if(action = 'duplicate') AS BIGINT) AS duplicates FROM actions GROUP BY narrative)
    SELECT narrative, n, inserted, updated, duplicates, {rounded("CAST(duplicates AS DOUBLE) / n")} AS duplicate_rate FROM c"""


@operator("snapshots")
def section_sizes(d):
    """Lines that a brief gives each narrative: all up to three; else three, and one more for each doubling, up to twelve."""
    return "SELECT narrative, CAST(CASE WHEN posts <= 3 THEN posts ELSE least(12, 3 + floor(log2(posts))) END AS BIGINT) AS section_lines FROM snapshots"


@operator("scores", "labels")
def ranking_checks(d):
    """Whether toxic documents score above the others at each quality."""
    return f"""
    WITH m AS (SELECT l.quality, {rounded("avg(CASE WHEN l.toxic = 1 THEN CAST(floor(s.outrage_index * 1e4 + 5e-1) AS BIGINT) END) / 1e4")} AS toxic_mean, {rounded("avg(CASE WHEN l.toxic = 0 THEN CAST(floor(s.outrage_index * 1e4 + 5e-1) AS BIGINT) END) / 1e4")} AS other_mean FROM scores s JOIN labels l ON s.post_id = l.doc_id GROUP BY l.quality)
    SELECT quality, toxic_mean, other_mean, toxic_mean > other_mean AS ranked FROM m"""


@operator("posts", "scores")
def investigation(d):
    """Posts of the last thirty hours of each narrative with a high tier, newest first."""
    return """
    WITH m AS (SELECT narrative, max(at_us) AS last_us FROM posts GROUP BY narrative)
    SELECT p.narrative, p.post_id, s.tier, s.outrage_index, CAST(row_number() OVER (PARTITION BY p.narrative ORDER BY p.at_us DESC, p.post_id DESC) AS BIGINT) AS place
    FROM posts p JOIN m ON p.narrative = m.narrative JOIN scores s ON p.post_id = s.post_id WHERE p.at_us >= m.last_us - 108000000000 AND s.tier <> 'neutral'"""


@operator("posts")
def session_counts(d):
    """Sessions of an author that end with thirty idle minutes, by narrative."""
    return """
    WITH g AS (SELECT narrative, author_id, at_us, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY narrative, author_id ORDER BY at_us, post_id) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM posts)
    SELECT narrative, author_id, CAST(sum(opens) AS BIGINT) AS sessions, count(*) AS posts FROM g GROUP BY narrative, author_id"""


@operator("posts")
def platform_cube(d):
    """Posts by narrative and platform with all subtotals, and exact distinct authors."""
    return "SELECT narrative, platform, count(*) AS posts, count(DISTINCT author_id) AS authors FROM posts GROUP BY CUBE(narrative, platform)"
