"""Coordination of themes: overlaps with copied text, tiers, alerts, lineage and drift of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from narravane.functions.dialect import operator, rounded
from narravane.functions.places import numbered
from narravane.operators.drift import OVERLAP, matches


@operator("themes", "clusters")
def overlays(d):
    """Copied-text clusters that share posts with a theme, with the number of shared posts."""
    return """
    SELECT t.theme, c.kind, c.cluster, count(*) AS shared FROM themes t JOIN clusters c ON t.post_id = c.post_id GROUP BY t.theme, c.kind, c.cluster"""


@operator("shares", "sizes", "clusters")
def coordination_tiers(d):
    """Tier of a theme, the first rule that holds: burst or wide exact copies, near copies, a shared frame, context."""
    return """
    WITH o AS (
      SELECT s.theme, max(CASE WHEN s.kind = 'exact' AND c.burst AND c.authors >= 3 THEN 1 ELSE 0 END) AS exact_burst, max(CASE WHEN s.kind = 'exact' AND c.authors >= 3 THEN 1 ELSE 0 END) AS exact_wide,
             max(CASE WHEN s.kind = 'fuzzy' AND c.burst THEN 1 ELSE 0 END) AS fuzzy_burst, max(CASE WHEN s.kind = 'fuzzy' THEN 1 ELSE 0 END) AS fuzzy
      FROM shares s JOIN clusters c ON s.kind = c.kind AND s.cluster = c.cluster GROUP BY s.theme),
    r AS (
      SELECT n.theme, n.posts, n.authors, CASE WHEN o.exact_burst = 1 THEN 1 WHEN o.exact_wide = 1 THEN 2 WHEN o.fuzzy_burst = 1 THEN 3 WHEN o.fuzzy = 1 THEN 4 WHEN n.authors >= 3 AND n.emerging THEN 5 WHEN n.authors >= 2 AND n.posts >= 3 THEN 6 WHEN n.posts <= 2 THEN 7 ELSE 8 END AS rule
      FROM sizes n LEFT JOIN o ON n.theme = o.theme)
    SELECT theme, posts, authors, CASE WHEN rule <= 2 THEN 'high' WHEN rule <= 6 THEN 'medium' WHEN rule = 7 THEN 'context' ELSE 'low' END AS tier,
           CASE rule WHEN 1 THEN 'Template amplification' WHEN 2 THEN 'Exact duplicate campaign' WHEN 3 THEN 'Near-copy burst' WHEN 4 THEN 'Near-copy campaign' WHEN 5 THEN 'Shared frame (emerging)' WHEN 6 THEN 'Shared frame' WHEN 7 THEN 'Context only' ELSE 'Distributed narrative' END AS label FROM r"""


@operator("totals", "stats", "graphs", "copies", "fuzzy")
def provenance(d):
    """What a snapshot is made of: ratios, truncation at 250 posts, coverage and signal counts, by narrative."""
    return f"""
    WITH k AS (SELECT (SELECT count(*) FROM copies) AS copied, (SELECT count(*) FROM fuzzy) AS fuzzy)
    SELECT t.narrative, t.n AS posts, least(t.n, 250) AS in_snapshot, t.n > 250 AS truncated, {rounded("CAST(least(t.n, 250) AS DOUBLE) / nullif(g.authors, 0)", 2)} AS posts_per_author, s.mean_score, s.compressed,
           g.edges, {rounded("CASE WHEN g.authors = 0 THEN 0e0 ELSE 1e2 * g.connected / g.authors END", 1)} AS coverage_pct, g.edges >= 10 AND g.authors > 0 AND CAST(g.connected AS DOUBLE) / g.authors >= 5e-2 AS sufficient, k.copied + k.fuzzy AS signals
    FROM totals t JOIN stats s ON t.narrative = s.narrative JOIN graphs g ON t.narrative = g.narrative CROSS JOIN k"""


@operator("weekly")
def lineage(d):
    """For clusters of one week the clusters of the next that share members: Jaccard similarity of 0.35 or more."""
    return f"""
    WITH n AS (SELECT week, cluster, count(*) AS k FROM weekly GROUP BY week, cluster),
    s AS (SELECT a.week AS week, a.cluster AS before, b.cluster AS after, count(*) AS shared FROM weekly a JOIN weekly b ON a.member = b.member AND b.week = a.week + 1 GROUP BY a.week, a.cluster, b.cluster),
    j AS (SELECT s.week, s.before, s.after, CAST(s.shared AS DOUBLE) / (x.k + y.k - s.shared) AS jaccard FROM s JOIN n x ON s.week = x.week AND s.before = x.cluster JOIN n y ON s.week + 1 = y.week AND s.after = y.cluster)
    SELECT week, before, after, {rounded("jaccard")} AS jaccard FROM j WHERE jaccard >= 35e-2"""


@operator("lines", "weeks", "days", "moves")
def alert_rows(d):
    """Alerts with their severity: trends, weeks, divergent days and watch-level moves."""
    return """
    WITH a AS (
      SELECT narrative, 'trend' AS kind, concat('trend ', trend) AS message, 1 AS severity FROM lines WHERE trend IN ('escalating', 'declining')
      UNION ALL SELECT narrative, 'week', concat('week over week ', alert), 2 FROM weeks WHERE alert <> 'none'
      UNION ALL SELECT narrative, 'divergence', concat('busy and mild on ', day), 3 FROM days
      UNION ALL SELECT narrative, 'level', concat('level ', CAST(level AS STRING), ' on ', day), CASE WHEN level = 3 THEN 0 ELSE 2 END FROM moves)
    SELECT narrative, kind, message, severity FROM a"""


def alerts(rows: DataFrame) -> DataFrame:
    """One list of alerts by severity, numbered."""
    return numbered(rows, ["severity", "narrative", "kind", "message"])


#: DuckDB text for ``alerts`` over ``rows``.
ALERTS_SQL = 'SELECT narrative, kind, message, severity, CAST(row_number() OVER (ORDER BY severity, narrative, kind, message) AS BIGINT) AS place FROM "rows"'


@operator("posts", "lines", "stats", "graphs", "bots")
def snapshot(d):
    """One row a narrative: volume, score, trend, graph and bots."""
    return """
    WITH p AS (SELECT narrative, count(*) AS posts, count(DISTINCT author_id) AS authors, min(day) AS first_day, max(day) AS last_day FROM posts GROUP BY narrative)
    SELECT p.narrative, p.posts, p.authors, p.first_day, p.last_day, s.mean_score, l.trend, l.slope, g.edges, g.connected, g.isolated, b.matches AS known_bots
    FROM p LEFT JOIN stats s ON p.narrative = s.narrative LEFT JOIN lines l ON p.narrative = l.narrative LEFT JOIN graphs g ON p.narrative = g.narrative LEFT JOIN bots b ON p.narrative = b.narrative"""


@operator("snapshots")
def brief(d):
    """A line of Markdown for each narrative."""
    return """
    SELECT narrative, concat('- **', narrative, '**: ', CAST(posts AS STRING), ' posts by ', CAST(authors AS STRING), ' authors, ', first_day, ' to ', last_day, '; trend ', coalesce(trend, 'unknown'), '; ', CAST(coalesce(edges, 0) AS STRING), ' interactions, ', CAST(coalesce(known_bots, 0) AS STRING), ' known bots') AS line FROM snapshots"""


@operator("snapshots")
def failed_gates(d):
    """Checks that a snapshot must pass, with the number of narratives that fail each."""
    return """
    SELECT 'has posts' AS gate, CAST(count_if(posts = 0) AS BIGINT) AS failed FROM snapshots UNION ALL SELECT 'authors within posts', CAST(count_if(authors > posts) AS BIGINT) FROM snapshots
    UNION ALL SELECT 'has trend', CAST(count_if(trend IS NULL) AS BIGINT) FROM snapshots UNION ALL SELECT 'graph adds up', CAST(count_if(connected + isolated <> authors) AS BIGINT) FROM snapshots"""


def drift(overlap: DataFrame) -> DataFrame:
    """One-to-one matches of old and new clusters that overlap by 0.35 or more; see ``drift.matches``."""
    return matches(overlap.where(f"jaccard >= {OVERLAP}"))
