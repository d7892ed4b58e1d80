"""Actors that take part in several narratives."""

from __future__ import annotations

from narravane.functions.dialect import operator, rounded

#: Sizes of the reports.
TOP_ACTORS, TOP_PAIRS, TOP_HITS = 50, 30, 25


@operator("posts")
def actor_rollup(d):
    """Posts, largest score, first and last time of each author in each narrative."""
    return "SELECT narrative, platform, author_id, count(*) AS posts, max(score_u) AS largest_u, min(at_us) AS first_us, max(at_us) AS last_us FROM posts GROUP BY narrative, platform, author_id"


@operator("rollup")
def actors(d):
    """Actors in two narratives or more with two posts or more, by a score of spread, volume and span."""
    span = "(CAST(max(last_us) - min(first_us) AS DOUBLE) / 864e8)"
    return f"""
    WITH a AS (
      SELECT concat(lower(platform), ':', author_id) AS actor, count(*) AS narratives, CAST(sum(posts) AS BIGINT) AS posts, max(largest_u) AS largest_u,
             {rounded(span, 2)} AS span_days, {d.join_set("narrative")} AS names
      FROM rollup GROUP BY concat(lower(platform), ':', author_id) HAVING count(*) >= 2 AND sum(posts) >= 2),
    s AS (SELECT *, {rounded("narratives * log2(posts + 1) * least(15e-1, 1e0 + span_days / 3e1)")} AS score FROM a)
    SELECT * FROM s ORDER BY score DESC, narratives DESC, posts DESC, actor LIMIT {TOP_ACTORS}"""


@operator("rollup", "top")
def actor_pairs(d):
    """Pairs of narratives by the top actors they share."""
    return f"""
    WITH m AS (SELECT DISTINCT t.actor, r.narrative FROM rollup r JOIN top t ON concat(lower(r.platform), ':', r.author_id) = t.actor)
    SELECT a.narrative AS narrative_a, b.narrative AS narrative_b, count(*) AS shared FROM m a JOIN m b ON a.actor = b.actor AND a.narrative < b.narrative
    GROUP BY a.narrative, b.narrative ORDER BY shared DESC, narrative_a, narrative_b LIMIT {TOP_PAIRS}"""


@operator("rollup", "top")
def actor_hits(d):
    """For each narrative the top actors in it that are in others too."""
    return f"""
    WITH h AS (
      SELECT r.narrative, t.actor, t.score, t.narratives - 1 AS others, row_number() OVER (PARTITION BY r.narrative ORDER BY t.score DESC, t.actor) AS k
      FROM rollup r JOIN top t ON concat(lower(r.platform), ':', r.author_id) = t.actor)
    SELECT narrative, actor, score, others FROM h WHERE k <= {TOP_HITS}"""


@operator("posts", "bots")
def bot_overlap(d):
    """Authors of a narrative on the listed platform that are known bots."""
    return f"""
    WITH a AS (SELECT DISTINCT narrative, platform, author_id FROM posts),
    c AS (SELECT a.narrative, count(*) AS authors, CAST(count_if(a.platform = 'x') AS BIGINT) AS checked, count(b.author_id) AS matches FROM a LEFT JOIN bots b ON a.platform = b.platform AND a.author_id = b.author_id GROUP BY a.narrative)
    SELECT narrative, authors, checked, matches, {rounded("CASE WHEN checked = 0 THEN 0e0 ELSE CAST(matches AS DOUBLE) / checked END")} AS ratio FROM c"""


@operator("posts", "bots")
def bot_labels(d):
    """Posts with the label of their author, if listed."""
    return "SELECT p.post_id, p.author_id, b.label FROM posts p LEFT JOIN bots b ON p.platform = b.platform AND p.author_id = b.author_id"


@operator("posts", "bots")
def posts_without_bots(d):
    """Posts of authors that are not listed."""
    return "SELECT p.post_id FROM posts p LEFT ANTI JOIN bots b ON p.platform = b.platform AND p.author_id = b.author_id" if d.name == "spark" else "SELECT p.post_id FROM posts p ANTI JOIN bots b ON p.platform = b.platform AND p.author_id = b.author_id"
