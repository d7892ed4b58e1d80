"""All registered queries of the library, and the DuckDB text that checks each.

A query is a node: an operator applied to nodes or landed tables.  Its Spark
form composes DataFrames, its reference form nests common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from narravane.functions.dialect import Operator, rounded, with_inputs
from narravane.functions.scratch import folder as scratch_folder
from narravane.functions.scratch import written
from narravane.operators import actors, analyst, bursts, clustering, coordination, drift, graph, keyword_audit, keywords, labels, relational, scoring, similarity, snapshots, text, theme_labels, themes, trend, upkeep, vector_store, watch
from narravane.sources import tables


@dataclass(frozen=True)
class Node:
    """An operator over inputs; ``sql`` is the reference text of an operator that is no SQL text in Spark."""

    apply: Callable[..., DataFrame] | Operator
    inputs: dict[str, Node | str] = field(default_factory=dict)
    sql: str | None = None
    keep: bool = False  # written once, since several parts of a plan read it

    def frame(self, spark: SparkSession, folder: str, made: dict | None = None) -> DataFrame:
        made = {} if made is None else made
        if id(self) not in made:
            frames = {k: made.setdefault(v, tables.table(spark, folder, v)) if isinstance(v, str) else v.frame(spark, folder, made) for k, v in self.inputs.items()}
            out = self.apply(**frames) if isinstance(self.apply, Operator) else self.apply(*frames.values())
            made[id(self)] = written(out) if self.keep else out
        return made[id(self)]

    def reference(self) -> str:
        text = self.apply.reference() if isinstance(self.apply, Operator) else self.sql
        if text is None:
            raise ValueError("no SQL")
        parts = {k: v if isinstance(v, str) else v.reference() for k, v in self.inputs.items()}
        inputs = {k: f"SELECT * FROM {v}" if isinstance(self.inputs[k], str) else v for k, v in parts.items() if v != k}
        if "RECURSIVE" in text[:20].upper() or any("RECURSIVE" in v.upper() for v in inputs.values()):
            text = text.strip()
            text = text.replace("WITH RECURSIVE", "WITH", 1)
            return with_inputs(text, inputs).replace("WITH ", "WITH RECURSIVE ", 1)
        return with_inputs(text, inputs)


def _node(operator: Operator, *inputs: Node | str, keep: bool = False) -> Node:
    return Node(operator, dict(zip(operator.inputs, inputs, strict=True)), keep=keep)


_posts = _node(tables.event_posts, "events")
_docs = _node(tables.document_posts, "documents")
# for work that is long for each text
_texts = Node(tables.spread, {"posts": _docs}, "SELECT * FROM posts")
_edges = Node(tables.edges, {"events": "events"}, tables.event_edges.reference(), keep=True)
_sparse = Node(tables.circles, {"events": "events"}, tables.sparse_edges.reference(), keep=True)
_bots = _node(tables.known_bots, "customer")

_buckets = _node(trend.daily_buckets, _posts)
_series = _node(trend.rolling_mean, _buckets, keep=True)
_lines = _node(trend.theil_sen, _series)
_rollup = _node(actors.actor_rollup, _posts)
_top = _node(actors.actors, _rollup)
_normal = _node(bursts.normalized, _texts)
_weights = _node(graph.edge_weights, _edges)
_degrees = _node(graph.degrees, _edges)
_parts = Node(graph.author_components, {"edges": _sparse}, graph.COMPONENTS_SQL)
_dense = _node(graph.dense_clusters, _sparse, _parts)
_shape = _node(graph.density_and_hub, _sparse)
_sets = _node(similarity.token_sets, _normal, keep=True)
_pairs = Node(similarity.similar_pairs, {"sets": _sets}, similarity.PAIRS_SQL, keep=True)
_own_links = Node(similarity.links_within_authors, {"sets": _sets, "pairs": _pairs}, similarity.post_pairs_sql(True), keep=True)
_cross_links = Node(similarity.links_across_authors, {"sets": _sets, "pairs": _pairs}, similarity.post_pairs_sql(False), keep=True)
_own = Node(lambda sets, links: similarity.groups_of(sets, links, True), {"sets": _sets, "links": _own_links}, similarity.GROUPS_SQL, keep=True)
_cross = Node(lambda sets, links: similarity.groups_of(sets, links, False), {"sets": _sets, "links": _cross_links}, similarity.GROUPS_SQL, keep=True)
_templates = _node(similarity.token_sets, _node(bursts.normalized, _node(Operator(lambda d: "SELECT item_id AS post_id, 'b' AS narrative, 'b' AS author_id, item_id AS at_us, text FROM benchmark", "benchmark"), "benchmark")))
_copies = Node(bursts.exact_copies, {"normal_posts": _normal}, bursts.COPIES_SQL)
_fuzzy = _node(similarity.group_report, _cross, _docs, _cross_links)
_text_score = _node(similarity.text_coordination, _copies, _fuzzy, _node(actors.actor_hits, _rollup, _top))
_hits = _node(scoring.lexicon_hits, _texts)
# stored, as the domain does: a filter on the tier would otherwise be pushed through the whole formula
_scores = _node(scoring.outrage_scores, _hits, keep=True)
_markets = _node(scoring.market_scores, _texts)
_reasons = _node(scoring.prefilter, _docs, _markets)
_keywords = _node(Operator(lambda d: "SELECT 'the' AS keyword UNION ALL SELECT ' Tion ' UNION ALL SELECT 'que' UNION ALL SELECT ''", "region"), "region")
_topics = _node(text.topic_tokens, _texts)
# read several times by what weighs phrases; few phrases are frequent enough
_phrases = _node(text.phrase_counts, _topics, keep=True)
# read three times
_kept_topics = _node(text.topic_tokens, _texts, keep=True)
_tfidf = _node(text.tfidf, _kept_topics)
_units = _node(themes.unit_vectors, "embeddings")
_near = Node(themes.near_vectors, {"units": _units}, themes.neighbours.reference(), keep=True)
# the reference goes by all pairs
_clusters = Node(lambda embeddings: themes.density_clusters(themes.unit_vectors(embeddings)), {"embeddings": "embeddings"}, Node(themes.density_clusters, {"pairs": _near}, themes.CLUSTERS_SQL).reference())
_runs = _node(upkeep.runs, "events")
_stats = _node(upkeep.keyword_stats, _runs)
_target = _node(Operator(lambda d: "SELECT narrative, post_id AS external_id, day AS text, at_us FROM posts", "posts"), _posts)
_batch = _node(Operator(lambda d: "SELECT narrative, CASE WHEN score_u >= 300000 THEN post_id ELSE -1 - post_id END AS external_id, CASE WHEN score_u >= 500000 THEN concat(day, '!') ELSE day END AS text, at_us + 60000000 AS at_us FROM posts", "posts"), _posts)
_keep = _node(Operator(lambda d: "SELECT DISTINCT narrative FROM posts WHERE narrative < 'p'", "posts"), _posts)
_ours = _node(Operator(lambda d: "SELECT concat(day, ' ', author_id) AS line, min(post_id) AS pos FROM posts WHERE platform <> 'mastodon' GROUP BY day, author_id", "posts"), _posts)
_theirs = _node(Operator(lambda d: "SELECT concat(day, ' ', author_id) AS line, min(post_id) AS pos FROM posts WHERE platform <> 'x' GROUP BY day, author_id", "posts"), _posts)
_scored = _node(Operator(lambda d: "SELECT post_id FROM posts WHERE score_u >= 100000", "posts"), _posts)

_trends = _node(trend.trend_class, _lines)
_moves = _node(upkeep.tier_crossings, _posts)
# busy mild days: every fifth day has all posts of a low score, the others half of them
_mild = _node(Operator(lambda d: "SELECT * FROM posts WHERE score_u < 170000 AND (CAST(substring(day, 9, 2) AS INT) % 5 = 0 OR post_id % 2 = 0)", "posts"), _posts)
_days = _node(trend.divergence_days, _node(trend.daily_buckets, _mild))
_weeks = _node(trend.week_over_week, _buckets)
_themes = _node(Operator(lambda d: "SELECT narrative AS theme, post_id FROM posts", "posts"), _docs)
_groups = _node(
    Operator(
        lambda d: "SELECT 'exact' AS kind, min(post_id) OVER (PARTITION BY normal) AS cluster, post_id FROM (SELECT *, count(*) OVER (PARTITION BY normal) AS k FROM normal_posts WHERE normal <> '') n WHERE k > 1 "
        "UNION ALL SELECT 'author', group_id, post_id FROM own UNION ALL SELECT 'fuzzy', group_id, post_id FROM across",
        "normal_posts", "own", "across",
    ),
    _normal, _own, _cross,
)
_narrative_units = _node(Operator(lambda d: "SELECT u.vec_id, p.narrative AS label, u.v FROM units u JOIN posts p ON u.vec_id = p.post_id", "units", "posts"), _units, _docs)
_narrative_cohesion = _node(Operator(lambda d: "SELECT label AS theme, cohesion FROM cohesions", "cohesions"), _node(themes.cohesion, _narrative_units))
_strengths = _node(analyst.lexicon_strength, _hits)
_facts_of_themes = _node(labels.theme_facts, _themes, _narrative_cohesion, _strengths, _markets, _topics, keep=True)
_pmi = _node(text.phrase_pmi, _phrases)
_label_scores = _node(labels.label_scores, _pmi, _node(labels.phrase_quality, _phrases))
_first_labels = _node(labels.first_labels, _label_scores)
_market_labels = _node(labels.market_labels, _first_labels)
_theme_quality = _node(labels.theme_quality, _facts_of_themes, _market_labels)
_sizes = _node(
    Operator(lambda d: "SELECT p.narrative AS theme, count(*) AS posts, count(DISTINCT p.author_id) AS authors, max(coalesce(q.emerging, false)) AS emerging FROM posts p LEFT JOIN qualities q ON p.narrative = q.theme GROUP BY p.narrative", "posts", "qualities"),
    _docs, _theme_quality,
)
_facts = _node(Operator(lambda d: "SELECT 'exact' AS kind, first_post AS cluster, authors, burst FROM copies UNION ALL SELECT 'fuzzy', group_id, authors, burst FROM reports", "copies", "reports"), _copies, _fuzzy)
_overlays = _node(coordination.overlays, _themes, _groups)
_weekly = _node(Operator(lambda d: f"SELECT DISTINCT {d.div('at_us', '604800000000')} AS week, narrative AS cluster, author_id AS member FROM posts", "posts"), _posts)
_lineage = _node(coordination.lineage, _weekly)
_snapshot = _node(coordination.snapshot, _posts, _trends, _node(trend.score_stats, _posts), _node(graph.graph_stats, _edges, _posts), _node(actors.bot_overlap, _posts, _bots))

NODES: dict[str, Node] = {
    "daily_buckets": _buckets, "tier_share": _node(trend.tier_share, _buckets), "rolling_mean": _series, "theil_sen": _lines, "daily_trend": _node(trend.trend_class, _lines),
    "divergence_days": _days, "peak_days": _node(trend.peak_days, _buckets), "week_over_week": _node(trend.week_over_week, _buckets),
    "iso_weeks": _node(trend.iso_weeks, _posts), "score_histogram": _node(trend.score_histogram, _posts), "nearest_rank": _node(trend.nearest_rank, _posts), "score_stats": _node(trend.score_stats, _posts),
    "actor_rollup": _rollup, "actor_top": _top, "actor_pairs": _node(actors.actor_pairs, _rollup, _top), "actor_hits": _node(actors.actor_hits, _rollup, _top),
    "bot_overlap": _node(actors.bot_overlap, _posts, _bots), "bot_labels": _node(actors.bot_labels, _posts, _bots), "posts_without_bots": _node(actors.posts_without_bots, _posts, _bots),
    "normal_text": _node(Operator(lambda d: "SELECT post_id, normal FROM n", "n"), _normal), "exact_copies": _copies, "copy_keys": _node(bursts.copy_keys, _node(Operator(lambda d: "SELECT * FROM posts UNION ALL SELECT * FROM posts WHERE post_id % 10 = 3", "posts"), _posts)), "bursts": _node(bursts.bursts, _posts), "gaps": Node(bursts.gaps, {"posts": _posts}, bursts.GAPS_SQL),
    "edge_weights": _weights, "heavy_edges": _node(graph.heavy_edges, _weights), "degrees": _degrees, "top_amplifiers": _node(graph.top_amplifiers, _degrees), "graph_stats": _node(graph.graph_stats, _edges, _posts),
    "edge_kinds": _node(graph.edge_kinds, _edges), "density_and_hub": _node(graph.density_and_hub, _edges), "author_components": _parts, "dense_clusters": _dense, "graph_suspicion": _node(graph.suspicion, _shape, _dense),
    "topology": _node(graph.topology, _edges), "priority_authors": _node(graph.priority_authors, _posts, _degrees),
    "similar_pairs": _pairs, "author_groups": _own, "cross_author_groups": _cross, "author_group_report": _node(similarity.group_report, _own, _docs, _own_links), "cross_group_report": _fuzzy,
    "author_spam": _node(similarity.author_spam, _own, _docs), "copypasta": _node(similarity.copypasta, _sets, _templates), "text_coordination": _text_score,
    "lexicon_hits": _hits, "outrage_scores": _scores, "market_scores": _markets, "prefilter": _reasons, "ingest_gate": Node(keyword_audit.ingest_gate, {"reasons": _reasons, "posts": _docs, "keywords": _keywords}, scoring.ingest_gate.reference()),
    "tier_counts": _node(scoring.tier_counts, _scores, _docs), "label_calibration": _node(scoring.label_calibration, _scores, "labels"),
    "cleaned_text": _node(text.cleaned, _docs), "hashtags": _node(text.hashtags, _docs), "stripped_html": _node(text.stripped_html, "pages"), "token_counts": _node(text.token_counts, _topics), "phrase_counts": _phrases,
    "top_terms": _node(text.top_terms, _topics), "phrase_pmi": _pmi, "term_lift": _node(text.term_lift, _topics), "tfidf": _tfidf, "tfidf_bigrams": _node(text.tfidf_bigrams, _kept_topics), "tfidf_norms": _node(text.tfidf_norms, _tfidf),
    "turn_pairs": _node(text.turn_pairs, "conversations"), "json_fields": _node(text.json_fields, "events"),
    "cosine_neighbours": _near, "density_clusters": _clusters, "cohesion": _node(themes.cohesion, _units), "davies_bouldin": _node(themes.davies_bouldin, _units), "purity": _node(themes.purity, _clusters, _units), "author_entropy": _node(themes.author_entropy, _posts),
    "keyword_stats": _stats, "protected_keywords": _node(upkeep.protected_keywords, _stats), "explore_order": _node(upkeep.explore_order, _stats), "recent_yield": _node(upkeep.recent_yield, _runs), "round_robin": _node(upkeep.round_robin, _stats),
    "sightings_by_day": _node(upkeep.sightings_by_day, _posts), "upsert_actions": _node(upkeep.upsert_actions, _target, _batch), "upserted": _node(upkeep.upserted, _target, _batch), "orphans": _node(upkeep.orphans, "orders", "customer"),
    "pruned": _node(upkeep.pruned, _posts, _keep), "last_of_day": _node(upkeep.last_of_day, _posts), "tier_crossings": _node(upkeep.tier_crossings, _posts), "daily_budget": _node(upkeep.daily_budget, _posts), "bounded_history": _node(upkeep.bounded_history, _posts),
    "newest_then_filtered": _node(upkeep.newest_then_filtered, _posts), "newest_cohort": _node(upkeep.newest_cohort, _posts), "merged_logs": Node(upkeep.merge_logs, {"ours": _ours, "theirs": _theirs}, upkeep.merged_logs.reference()), "stale_narratives": _node(upkeep.stale_narratives, _posts, _scored),
    "star_join": _node(relational.star_join, "lineitem", "orders", "customer", "nation", "region"), "rollup_sales": _node(relational.rollup_sales, "lineitem"), "cube_sales": _node(relational.cube_sales, "lineitem"), "grouping_sets_sales": _node(relational.grouping_sets_sales, "lineitem"),
    "customers_with_orders": _node(relational.customers_with_orders, "customer", "orders"), "customers_without_orders": _node(relational.customers_without_orders, "customer", "orders"), "nation_sets": _node(relational.nation_sets, "customer", "supplier"),
    "top_orders": _node(relational.top_orders, "orders"), "running_totals": _node(relational.running_totals, "orders"), "status_pivot": _node(relational.status_pivot, "orders"), "as_of_event": _node(relational.as_of_event, "orders", "events"),
}

NODES |= {
    "overlays": _overlays, "coordination_tiers": _node(coordination.coordination_tiers, _overlays, _sizes, _facts), "combined_score": _node(similarity.combined_score, _text_score, _node(graph.suspicion, _shape, _dense), _node(graph.graph_stats, _edges, _posts)),
    "provenance": _node(coordination.provenance, _node(Operator(lambda d: "SELECT narrative, count(*) AS n FROM posts GROUP BY narrative", "posts"), _posts), _node(trend.score_stats, _node(analyst.filtered(least_u=100_000), _posts)), _node(graph.graph_stats, _edges, _posts), _copies, _fuzzy), "lineage": _lineage, "alerts": Node(coordination.alerts, {"rows": _node(coordination.alert_rows, _trends, _weeks, _days, _moves)}, coordination.ALERTS_SQL),
    "snapshot": _snapshot, "brief": _node(coordination.brief, _snapshot), "failed_gates": _node(coordination.failed_gates, _snapshot),
}

# a keyword for each pair of users; most of its runs bring next to nothing
_many_runs = _node(Operator(lambda d: f"SELECT run_id, concat(keyword_1, '/', CAST(run_id % 41 AS STRING)) AS keyword_1, concat(keyword_2, '/', CAST(run_id % 37 AS STRING)) AS keyword_2, CASE WHEN run_id % 41 < 30 THEN fetched % 2 ELSE fetched END AS fetched, CASE WHEN run_id % 41 < 30 THEN 0 ELSE inserted END AS inserted, skipped, at_us FROM runs", "runs"), _runs)
_last_runs = _node(Operator(lambda d: "SELECT r.* FROM runs r CROSS JOIN (SELECT max(at_us) AS last_us FROM runs) m WHERE r.at_us >= m.last_us - 1209600000000", "runs"), _many_runs)
_queries = _node(Operator(lambda d: "SELECT DISTINCT p_name AS query FROM part", "part"), "part")
_existing = _node(Operator(lambda d: "SELECT DISTINCT p_type AS keyword FROM part", "part"), "part")
NODES |= {
    "keyword_fingerprints": _node(keywords.fingerprints, _queries), "similar_keywords": Node(keyword_audit.similar_to_existing, {"queries": _queries, "existing": _existing}, keywords.similar_to_existing.reference()), "covered_keywords": Node(keyword_audit.covered, {"queries": _queries, "existing": _existing}, keywords.covered.reference()), "stale_keywords": _node(keywords.stale, _node(upkeep.keyword_stats, _last_runs), _node(upkeep.keyword_stats, _many_runs)),
}

_watched = _node(watch.watch_list, _posts, _edges)
NODES |= {
    "timelines": _node(watch.timelines, _posts), "watch_list": _watched, "next_poll": _node(watch.next_poll, _watched, _node(watch.polls, _edges)), "watched_without_bots": _node(watch.watched_without_bots, _watched, _bots), "resolved_targets": _node(watch.resolved_targets, _edges, _posts),
    "ingest_counts": _node(watch.ingest_counts, _node(upkeep.upsert_actions, _target, _batch)), "section_sizes": _node(watch.section_sizes, _snapshot), "ranking_checks": _node(watch.ranking_checks, _scores, "labels"), "investigation": _node(watch.investigation, _docs, _scores),
    "session_counts": _node(watch.session_counts, _posts), "platform_cube": _node(watch.platform_cube, _posts),
}

_pasta = NODES["copypasta"]
_tiers = NODES["coordination_tiers"]
_topterms = NODES["top_terms"]
_topical = _node(scoring.topic_filter, _reasons, NODES["ingest_gate"], _docs)
# documents with a headline of a frame, since invented prose has none
_framed = _node(Operator(lambda d: "SELECT post_id, narrative, author_id, at_us, concat(text, CASE WHEN post_id % 10 = 1 THEN ' Stop the Steal: a red wave, a RED WAVE' WHEN post_id % 14 = 2 THEN ' the deep state' WHEN post_id % 15 = 4 THEN ' fake news' ELSE '' END) AS text FROM posts", "posts"), _texts)
_known = _node(labels.known_phrases, _framed)
_related = _node(labels.relatedness, _topterms, _known)
_centroids = _node(labels.centroid_edges, _narrative_units)
# scores that rise day by day after the middle of the month
_rising = _node(Operator(lambda d: f"SELECT post_id, narrative, author_id, platform, at_us, day, CAST(CASE WHEN CAST(substring(day, 9, 2) AS INT) < 16 THEN {d.div('score_u', '3')} ELSE least(1000000, {d.div('score_u', '3')} + 30000 * (CAST(substring(day, 9, 2) AS INT) - 15)) END AS BIGINT) AS score_u FROM posts", "posts"), _posts)


def _state_of(posts: Node) -> Node:
    buckets = _node(trend.daily_buckets, posts)
    return _node(analyst.sentiment_state, _node(trend.trend_class, _node(trend.theil_sen, _node(trend.rolling_mean, buckets, keep=True))), _node(trend.week_over_week, buckets), _node(trend.divergence_days, buckets))


_state = _state_of(_rising)
_state_before = _state_of(_node(analyst.filtered(before_us=1_705_500_000_000_000), _rising))
_member_ids = _node(Operator(lambda d: "SELECT CAST(post_id % 7 AS BIGINT) AS theme, post_id FROM posts", "posts"), _docs)
# manual merges in turn, with a chain, a target that isn't there any more, and one that never was
_merged_ids = _node(Operator(lambda d: "SELECT r_regionkey AS step, CAST(CASE r_regionkey WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 4 ELSE 1 END AS BIGINT) AS theme, CAST(CASE r_regionkey WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 99 ELSE 0 END AS BIGINT) AS into_theme FROM region", "region"), "region")
_split_ids = _node(Operator(lambda d: "SELECT CAST(post_id % 7 AS BIGINT) AS theme, post_id, CAST(CASE post_id % 7 WHEN 6 THEN 0 ELSE post_id % 2 END AS BIGINT) AS part FROM posts WHERE post_id % 7 IN (3, 4, 5, 6) AND post_id % 3 > 0", "posts"), _docs)
_targets = Node(labels.merge_targets, {"members": _member_ids, "merged": _merged_ids}, labels.MERGE_TARGETS_SQL)
NODES |= {
    "known_phrases": _known, "phrase_quality": _node(labels.phrase_quality, _phrases), "label_scores": _label_scores, "first_labels": _first_labels, "market_labels": _market_labels, "relatedness": _related,
    "theme_facts": _facts_of_themes, "theme_quality": _theme_quality, "theme_order": _node(labels.theme_order, _theme_quality), "theme_cards": _node(labels.theme_cards, _theme_quality), "centroid_edges": _centroids, "theme_merges": _node(labels.merges, _centroids, _related),
    "theme_overrides": _node(labels.overridden, _member_ids, _targets, _split_ids), "must_linked": _node(labels.must_linked, _themes, _cross),
    "filtered_posts": _node(analyst.filtered("click", 500_000), _posts), "sensitive_posts": _node(analyst.sensitive, _docs), "shortened_texts": _node(analyst.shortened, _docs), "lexicon_strength": _node(analyst.lexicon_strength, _hits),
    "post_projection": _node(analyst.projection, _docs, _scores, _own, _cross, _pasta), "best_posts": _node(analyst.best_posts, _docs, _scores), "client_filter": _node(analyst.client_filter, _docs, _scores), "author_vertices": _node(analyst.author_vertices, _posts, _bots),
    "graph_posts": _node(analyst.graph_posts, _docs, _scores), "posts_by_author": _node(analyst.posts_by_author, _posts), "parent_theme": _node(analyst.parent_theme, _overlays), "copy_tiers": _node(analyst.copy_tiers, _facts), "copy_order": _node(analyst.copy_order, _copies),
    "group_order": _node(analyst.group_order, _fuzzy), "frame_order": _node(analyst.frame_order, _tiers), "signals": _node(analyst.signals, _copies, _fuzzy), "topic_filter": _topical, "filter_buckets": _node(analyst.filter_buckets, _topical), "ingest_plan": _node(analyst.ingest_plan, _posts),
    "sentiment_state": _state, "sentiment_alerts": _node(analyst.sentiment_alerts, _state, _state_before), "benchmark_run": _node(analyst.benchmark_run, _scores, "labels"), "label_summary": _node(analyst.label_summary, _docs, "labels"), "report_rows": _node(analyst.report_rows, _posts),
    "discovered_authors": _node(analyst.discovered, _posts, _edges),
}

# themes that are found, not given
_lifted = _node(themes.lifted_vectors, _units, keep=True)
_knn = Node(clustering.knn, {"vectors": _lifted}, clustering.KNN_SQL)
_radii = _node(clustering.radius(), _node(Operator(lambda d: "SELECT scope, distance, 1 AS n FROM distances", "distances"), _knn))
# the radius is an input of the reference alone
_found = Node(lambda vectors, radii: clustering.density_clusters(vectors), {"vectors": _lifted, "radii": _radii}, clustering.DENSITY_SQL, keep=True)
_inside = Node(lambda vectors, members: clustering.inner_vectors(vectors, members, clustering.REFINE), {"vectors": _lifted, "members": _found}, "SELECT m.cluster AS scope, m.vec_id, v.v FROM members m JOIN vectors v ON v.vec_id = m.vec_id WHERE m.cluster >= 0 AND m.cluster IN (SELECT cluster FROM members GROUP BY cluster HAVING count(*) >= 8)", keep=True)
_inside_radii = _node(clustering.radius(), _node(Operator(lambda d: "SELECT scope, distance, 1 AS n FROM distances", "distances"), Node(clustering.knn, {"vectors": _inside}, clustering.KNN_SQL)))
_inside_found = Node(lambda vectors, radii: clustering.density_clusters(vectors), {"vectors": _inside, "radii": _inside_radii}, clustering.DENSITY_SQL, keep=True)
_quarters = _node(Operator(lambda d: "SELECT scope, vec_id, min(vec_id) OVER (PARTITION BY label, vec_id % 4) AS cluster FROM vectors", "vectors"), _lifted, keep=True)
_centres_sql = "SELECT cluster, size, list_transform(list(m ORDER BY i), lambda x: x / norm) AS v FROM (SELECT cluster, i, avg(x) AS m, count(*) AS size, sqrt(sum(avg(x) * avg(x)) OVER (PARTITION BY cluster)) AS norm FROM (SELECT m.cluster, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS i FROM members m JOIN vectors v ON v.vec_id = m.vec_id WHERE m.cluster >= 0) f GROUP BY cluster, i) g GROUP BY cluster, size, norm"
_quarter_centres = Node(clustering.centroids, {"vectors": _lifted, "members": _quarters}, _centres_sql, keep=True)
_merge_pairs = Node(clustering.merge_pairs, {"centres": _quarter_centres}, "SELECT a.cluster AS l, b.cluster AS r, floor(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) * 1e6 + 5e-1) / 1e6 AS cosine FROM centres a JOIN centres b ON a.cluster < b.cluster WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) >= 93e-2", keep=True)
_cap = _node(Operator(lambda d: "SELECT CAST(least(48, greatest(12, floor(count(*) * 32e-2))) AS BIGINT) AS cap FROM members", "members"), _quarters)
_greedy = Node(lambda pairs, sizes, cap: clustering.greedy_merges(pairs, sizes, cap.first().cap), {"pairs": _merge_pairs, "sizes": _quarter_centres, "cap": _cap}, clustering.GREEDY_SQL)
NODES |= {
    "knn_distances": _knn, "adaptive_radius": _radii, "theme_clusters": _found, "refined_themes": _node(clustering.split_clusters, _found, _inside_found), "merge_pairs": _merge_pairs, "merged_themes": _greedy,
    "merge_tree": Node(clustering.merge_tree, {"centres": _quarter_centres}, clustering.TREE_SQL),
}

# weekly clusters of authors, matched with those of the week before
_week_overlap = _node(Operator(lambda d: f"SELECT CAST(week AS {'STRING' if d.name == 'spark' else 'VARCHAR'}) AS narrative, CAST(ascii(before) * 1000 + ascii(substring(before, 2, 1)) AS BIGINT) AS before, CAST(ascii(after) * 1000 + ascii(substring(after, 2, 1)) AS BIGINT) AS after, jaccard FROM lineage", "lineage"), _lineage, keep=True)
# two snapshots of the posts that have vectors: labels as old themes, new ones with parts split off, united, lost and found
_vector_posts = _node(Operator(lambda d: "SELECT v.label, p.post_id, p.author_id, p.at_us, concat(p.text, ' theme', CAST(v.label AS STRING)) AS text FROM vectors v JOIN posts p ON p.post_id = v.vec_id", "vectors", "posts"), _lifted, _docs)
_old_posts = _node(Operator(lambda d: "SELECT 'all' AS narrative, CAST(label AS BIGINT) AS theme, post_id, author_id, at_us, text FROM posts WHERE label < 9", "posts"), _vector_posts)
_new_posts = _node(
    Operator(lambda d: "SELECT 'all' AS narrative, CAST(CASE WHEN label = 0 THEN 100 + post_id % 2 WHEN label IN (1, 2) THEN 112 ELSE 100 + 10 * label END AS BIGINT) AS theme, post_id, author_id, at_us, CASE WHEN label = 4 THEN concat(' renamed wording stands here instead ', 'often often often') ELSE text END AS text FROM posts WHERE label <> 8", "posts"),
    _vector_posts,
)


def _theme_labels(posts: Node) -> Node:
    """(narrative, theme, labels, distinctive): the first five terms of each theme, and the share of its top ten that no other has."""
    named = _node(Operator(lambda d: f"SELECT post_id, CAST(theme AS {'STRING' if d.name == 'spark' else 'VARCHAR'}) AS narrative, text FROM posts", "posts"), posts)
    return _node(
        Operator(
            lambda d: f"WITH o AS (SELECT term, count(*) AS themes FROM terms GROUP BY term) SELECT 'all' AS narrative, CAST(t.narrative AS BIGINT) AS theme, {'transform(array_sort(collect_list(CASE WHEN t.k <= 5 THEN struct(t.k, t.term) END)), x -> x.term)' if d.name == 'spark' else 'list(t.term ORDER BY t.k) FILTER (WHERE t.k <= 5)'} AS labels, {rounded('sum(CASE WHEN o.themes = 1 THEN 1e0 ELSE 0e0 END) / 10')} AS distinctive FROM terms t JOIN o ON o.term = t.term GROUP BY t.narrative",
            "terms",
        ),
        _node(text.top_terms, _node(text.topic_tokens, named), keep=True), keep=True,
    )


_overlap = _node(drift.overlaps, _old_posts, _new_posts, keep=True)
_matched = Node(drift.matches, {"overlap": _overlap}, drift.MATCHES_SQL, keep=True)
NODES |= {
    "drift": Node(drift.matches, {"overlap": _week_overlap}, drift.MATCHES_SQL), "theme_overlaps": _overlap, "theme_matches": _matched, "drift_report": _node(drift.drift_report, _theme_labels(_old_posts), _theme_labels(_new_posts), _overlap, _matched),
}

# what follows for the themes that were found: their posts, facts, quality and labels
_found_members = _node(Operator(lambda d: f"SELECT CAST(cluster AS {'STRING' if d.name == 'spark' else 'VARCHAR'}) AS theme, vec_id AS post_id FROM members WHERE cluster >= 0", "members"), _found, keep=True)
_found_posts = _node(Operator(lambda d: "SELECT m.theme AS narrative, p.post_id, p.author_id, p.at_us, p.text FROM members m JOIN posts p ON p.post_id = m.post_id", "members", "posts"), _found_members, _vector_posts)
_found_topics = _node(text.topic_tokens, _found_posts, keep=True)
_found_units = _node(Operator(lambda d: "SELECT v.vec_id, m.theme AS label, v.v FROM vectors v JOIN members m ON m.post_id = v.vec_id", "vectors", "members"), _lifted, _found_members)
_found_hits = _node(scoring.lexicon_hits, _found_posts)
_found_markets = _node(scoring.market_scores, _found_posts)
_found_scores = _node(theme_labels.contrast_scores, _found_topics, _node(labels.known_phrases, _found_posts), keep=True)
_found_weights = _node(labels.label_scores, _found_scores, _node(labels.phrase_quality, _found_scores))
_found_facts = _node(labels.theme_facts, _found_members, _node(Operator(lambda d: "SELECT label AS theme, cohesion FROM cohesions", "cohesions"), _node(themes.cohesion, _found_units)), _node(analyst.lexicon_strength, _found_hits), _found_markets, _found_topics)
_found_quality = _node(labels.theme_quality, _found_facts, _node(labels.market_labels, _node(labels.first_labels, _found_weights)))
NODES |= {
    "contrast_scores": _found_scores, "found_theme_facts": _found_facts, "found_theme_quality": _found_quality, "found_theme_order": _node(labels.theme_order, _found_quality), "found_theme_cards": _node(labels.theme_cards, _found_quality),
    "found_relatedness": _node(labels.relatedness, _node(text.top_terms, _found_topics), _node(labels.known_phrases, _found_posts)), "found_author_entropy": _node(themes.author_entropy, _found_posts),
}


def _exclusive(spark: SparkSession, folder: str) -> DataFrame:
    made: dict = {}
    weights, scores = (n.frame(spark, folder, made) for n in (_found_scores, _found_weights))
    quality = labels.phrase_quality(weights)
    rows = weights.select("narrative", "phrase", "weight").join(scores.select("narrative", "phrase", "score"), ["narrative", "phrase"]).join(quality, "phrase")
    return theme_labels.exclusive_labels(rows)


def _found_themes(spark: SparkSession, folder: str) -> DataFrame:
    """Themes of the posts that have vectors, on the whole way: merging asks for related texts, copied posts stay together."""
    made: dict = {}
    vectors, posts, groups = (n.frame(spark, folder, made) for n in (_lifted, _vector_posts, _cross))

    def related(members: DataFrame) -> DataFrame:
        named = members.where("cluster >= 0").selectExpr("vec_id AS post_id", "CAST(cluster AS STRING) AS narrative").join(posts, "post_id")
        pairs = labels.relatedness(text.top_terms(text.topic_tokens(named)), labels.known_phrases(named))
        return pairs.selectExpr("CAST(a AS LONG) AS a", "CAST(b AS LONG) AS b", "related", "score")

    found, method = clustering.themes(vectors, groups.select("group_id", "post_id"), related)
    return found.selectExpr("vec_id", "theme", f"'{method}' AS method")


NODES |= {"vector_store": Node(lambda docs: vector_store.runs(docs, scratch_folder(docs.sparkSession)), {"documents": "documents"}, vector_store.RUNS_SQL)}

# terms for an audit: words of parts with an anchor, a spoiler or nothing behind them
_terms = _node(
    Operator(lambda d: "SELECT concat(split_part(p_name, ' ', 1), CASE p_partkey % 5 WHEN 0 THEN ' ballot' WHEN 1 THEN ' senate race' WHEN 2 THEN ' post' WHEN 3 THEN '' ELSE ' red wave' END) AS term, CAST(p_size AS DOUBLE) + (p_partkey % 97) / 1e2 AS score, CASE WHEN p_partkey % 29 = 1 THEN 'theme' ELSE 'corpus' END AS source FROM part", "part"),
    "part",
)
_term_queries = _node(Operator(lambda d: "SELECT DISTINCT term AS query FROM terms", "terms"), _terms)
_configured = _node(Operator(lambda d: "SELECT DISTINCT split_part(p_name, ' ', 1) AS keyword FROM part WHERE p_name < 'f'", "part"), "part")
_term_checks = _node(keyword_audit.valid_queries, _term_queries)
_term_covers = Node(keyword_audit.covered, {"queries": _term_queries, "existing": _configured}, keywords.covered.reference())
NODES |= {"valid_queries": _term_checks, "keyword_suggestions": _node(keyword_audit.suggestions, _terms, _term_covers, _term_checks)}

def _read_back(rows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Snapshot documents, saved and loaded again."""
    path = scratch_folder(rows.sparkSession)
    snapshots.save(snapshots.documents(rows, alerts), path)
    return snapshots.flat(snapshots.load(rows.sparkSession, path))


_flats = Node(_read_back, {"snap": _snapshot, "alerts": NODES["alerts"]}, f"SELECT CAST({snapshots.VERSION} AS BIGINT) AS version, s.narrative, {', '.join(snapshots.FIELDS)}, (SELECT count(*) FROM alerts a WHERE a.narrative = s.narrative) AS alerts FROM snap s")
NODES |= {"snapshot_documents": _flats, "document_gates": _node(snapshots.document_gates, _flats)}

#: Queries that SQL can't express: models whose results have no exact reference.
MODELS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "kmeans": lambda spark, folder: themes.kmeans(tables.table(spark, folder, "embeddings")),
    "silhouette": lambda spark, folder: themes.silhouette(tables.table(spark, folder, "embeddings")),
    "exclusive_labels": _exclusive,
    "found_themes": _found_themes,
    "centroid_map": lambda spark, folder: themes.centroid_map(tables.table(spark, folder, "embeddings")),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda spark, folder, node=node: node.frame(spark, folder)) for name, node in NODES.items()} | MODELS
ORACLE_SQL: dict[str, str] = {name: node.reference() for name, node in NODES.items()}
