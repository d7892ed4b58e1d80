"""The author graph: weights, degrees, density, hubs, components and priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.functions.dialect import operator, rounded
from narravane.operators.components import components

#: Priority of interaction kinds, thresholds of the signals.
KINDS = ("retweet", "quote", "reply", "share", "crosspost")
DENSE, DENSE_NODES, HUB, CLUSTER_DENSITY, CLUSTER_NODES = "15e-2", 5, "5e-1", "4e-1", 3


def _priority() -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + f" ELSE {len(KINDS)} END"


@operator("edges")
def edge_weights(d):
    """Parallel edges as one: weight, kinds, and the kind of the highest priority."""
    return f"SELECT source, target, count(*) AS weight, {d.join_set('kind')} AS kinds, min_by(kind, {_priority()}) AS main_kind FROM edges GROUP BY source, target"


@operator("weights")
def heavy_edges(d):
    """Edges of at least three interactions."""
    return "SELECT * FROM weights WHERE weight >= 3"


@operator("edges")
def degrees(d):
    """Out- and in-degree over distinct edges, self edges included."""
    return """
    WITH e AS (SELECT DISTINCT source, target FROM edges),
    o AS (SELECT source AS author_id, count(*) AS k FROM e GROUP BY source), i AS (SELECT target AS author_id, count(*) AS k FROM e GROUP BY target)
    SELECT coalesce(o.author_id, i.author_id) AS author_id, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) AS in_degree FROM o FULL JOIN i ON o.author_id = i.author_id"""


@operator("degrees")
def top_amplifiers(d):
    """The ten authors of the largest out-degree."""
    return "SELECT author_id, out_degree, in_degree FROM degrees ORDER BY out_degree DESC, author_id LIMIT 10"


@operator("edges", "posts")
def graph_stats(d):
    """Interactions, authors, connected and isolated ones, by narrative."""
    return """
    WITH ends AS (SELECT narrative, source AS author_id FROM edges UNION SELECT narrative, target FROM edges),
    authors AS (SELECT DISTINCT narrative, author_id FROM posts),
    c AS (SELECT a.narrative, count(*) AS authors, count(e.author_id) AS connected FROM authors a LEFT JOIN ends e ON a.narrative = e.narrative AND a.author_id = e.author_id GROUP BY a.narrative),
    k AS (SELECT narrative, count(*) AS edges FROM edges GROUP BY narrative)
    SELECT c.narrative, coalesce(k.edges, 0) AS edges, c.authors, c.connected, c.authors - c.connected AS isolated FROM c LEFT JOIN k ON c.narrative = k.narrative"""


@operator("edges")
def edge_kinds(d):
    """Interactions by narrative and kind."""
    return "SELECT narrative, kind, count(*) AS n FROM edges GROUP BY narrative, kind"


@operator("edges")
def density_and_hub(d):
    """Nodes, distinct edges, density, and the share of the largest out-degree."""
    return f"""
    WITH e AS (SELECT DISTINCT source, target FROM edges), n AS (SELECT source AS a FROM e UNION SELECT target FROM e), o AS (SELECT source, count(*) AS k FROM e GROUP BY source),
    t AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT max(k) FROM o) AS top)
    SELECT nodes, edges, {rounded("CASE WHEN nodes > 1 THEN CAST(edges AS DOUBLE) / (nodes * (nodes - 1)) ELSE 0e0 END", 6)} AS density, {rounded("CASE WHEN edges > 0 THEN CAST(top AS DOUBLE) / edges ELSE 0e0 END")} AS hub_ratio FROM t"""


@operator("edges", "groups")
def dense_clusters(d):
    """Components of three nodes or more whose inner density is above 0.4."""
    return f"""
    WITH e AS (SELECT DISTINCT source, target FROM edges), k AS (SELECT component, count(*) AS nodes FROM groups GROUP BY component),
    m AS (SELECT g.component, count(*) AS inner_edges FROM e JOIN groups g ON e.source = g.node GROUP BY g.component)
    SELECT k.component, k.nodes, m.inner_edges, {rounded("CAST(m.inner_edges AS DOUBLE) / (k.nodes * (k.nodes - 1))")} AS density
    FROM k JOIN m ON k.component = m.component WHERE k.nodes >= {CLUSTER_NODES} AND CAST(m.inner_edges AS DOUBLE) / (k.nodes * (k.nodes - 1)) > {CLUSTER_DENSITY}"""


@operator("shape", "dense")
def suspicion(d):
    """Graph suspicion: density, hub and dense clusters add up, to one at most."""
    return f"""
    WITH c AS (SELECT count(*) AS clusters FROM dense)
    SELECT s.nodes, s.edges, c.clusters, {rounded(f"least(1e0, (CASE WHEN s.density > {DENSE} AND s.nodes >= {DENSE_NODES} THEN 25e-2 ELSE 0e0 END) + (CASE WHEN s.hub_ratio > {HUB} THEN 35e-2 ELSE 0e0 END) + least(4e-1, 15e-2 * c.clusters))")} AS suspicion FROM shape s CROSS JOIN c"""


@operator("edges")
def topology(d):
    """Sparse, star or distributed, for each narrative, by the share of the author with the most interactions."""
    return f"""
    WITH o AS (SELECT narrative, source, count(*) AS k FROM edges GROUP BY narrative, source),
    t AS (SELECT narrative, CAST(sum(k) AS BIGINT) AS edges, max(k) AS top, count(*) AS sources, max_by(source, struct_of) AS hub FROM (SELECT *, row_number() OVER (PARTITION BY narrative ORDER BY k, source DESC) AS struct_of FROM o) x GROUP BY narrative)
    SELECT narrative, edges, sources, hub, {rounded("CAST(top AS DOUBLE) / edges")} AS hub_share,
           CASE WHEN CAST(top AS DOUBLE) / edges > 5e-1 AND top >= 2 THEN 'star' WHEN edges < 3 OR sources <= 1 THEN 'sparse' ELSE 'distributed' END AS shape FROM t"""


@operator("posts", "degrees")
def priority_authors(d):
    """Authors by reach and score; critical ones are above both medians, or in the upper quartile if all scores are low.

    Scores are millionths, so the quartile comes from counts of at most a million values.
    """
    return """
    WITH a AS (SELECT author_id, count(*) AS posts, max(score_u) AS y FROM posts GROUP BY author_id),
    j AS (SELECT coalesce(a.author_id, g.author_id) AS author_id, coalesce(a.posts, 0) AS posts, coalesce(a.y, 0) AS y, coalesce(g.out_degree, 0) AS x FROM a FULL JOIN degrees g ON a.author_id = g.author_id),
    c AS (SELECT y, count(*) AS k FROM j GROUP BY y), w AS (SELECT y, sum(k) OVER (ORDER BY y) AS upto, sum(k) OVER () AS n FROM c),
    q AS (SELECT min(y) AS p75 FROM w WHERE upto > least(n - 1, floor(n * 75e-2))), h AS (SELECT median(x) AS mid_x, median(y) AS mid_y, max(y) AS top FROM j), m AS (SELECT h.*, q.p75 FROM h CROSS JOIN q)
    SELECT j.author_id, j.posts, j.x AS reach, j.y AS largest_u,
           CASE WHEN m.top <= 150000 THEN j.y >= m.p75 AND j.x >= m.mid_x ELSE j.x >= m.mid_x AND j.y >= m.mid_y AND (j.x > 0 OR j.y >= 250000) END AS critical
    FROM j CROSS JOIN m"""


def author_components(edges: DataFrame) -> DataFrame:
    """(node, component) over the undirected graph; a component is named by its smallest author."""
    return components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))


#: DuckDB text for ``author_components``.
COMPONENTS_SQL = """
WITH RECURSIVE l AS (SELECT DISTINCT source AS a, target AS b FROM edges WHERE source <> target UNION SELECT DISTINCT target, source FROM edges WHERE source <> target),
r(node, other) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a)
SELECT node, min(other) AS component FROM r GROUP BY node"""
