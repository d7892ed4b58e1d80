"""What an analyst sees: filtered and ordered posts, author vertices, report orders, tiers of copies, and strings."""

from __future__ import annotations

from narravane.functions.dialect import Operator, operator, rounded
from narravane.operators.scoring import FAMILIES

# Fixed value: words that hide a post behind a warning.
SENSITIVE = r"(?i)\b(?:nazi|fascist|facist|pig|kill|inbreed|pathetic)\b"
# Number of a filter's bucket by its reason.
BUCKETS = {"market": -2, "promo": -3, "short": -4, "non_english": -5, "off_topic": -6}
#: Keywords, posts and posts of a search in one run.
MOST_KEYWORDS, MOST_POSTS, MOST_PER_SEARCH = 8, 80, 20


def filtered(narrative: str | None = None, least_u: int | None = None, before_us: int | None = None) -> Operator:
    """Posts that fulfil all conditions that are given."""
    conditions = [f"narrative = '{narrative}'"] if narrative else []
    conditions += [f"score_u >= {least_u}"] if least_u is not None else []
    conditions += [f"at_us < {before_us}"] if before_us is not None else []
    return Operator(lambda d: f"SELECT * FROM posts{' WHERE ' + ' AND '.join(conditions) if conditions else ''}", "posts", doc="Posts that fulfil all given conditions.")


@operator("posts")
def sensitive(d):
    """Posts with a sensitive word."""
    return f"SELECT post_id, {d.like(d.replace('text', '[^\\x00-\\x7F]', ' '), SENSITIVE)} AS hidden FROM posts"


@operator("posts")
def shortened(d):
    """Texts cut for cards, graphs, samples and keys; a cut card ends with an ellipsis."""
    cut = lambda n: f"CASE WHEN length(text) > {n} THEN concat(substring(text, 1, {n}), '…') ELSE text END"
    return f"SELECT post_id, {d.sha256(cut(240))} AS card, {d.sha256('substring(text, 1, 500)')} AS graph, {d.sha256('substring(text, 1, 160)')} AS sample, {d.sha256('substring(text, 1, 280)')} AS copy_key FROM posts"


@operator("hits")
def lexicon_strength(d):
    """Share of the lexicon families that a post matches; an insult without affection counts as one more."""
    n = len(FAMILIES)
    found = " + ".join(f"CASE WHEN {name} > 0 THEN 1 ELSE 0 END" for name in FAMILIES)
    return f"SELECT post_id, {rounded(f'least(1e0, ({found} + CASE WHEN insult AND NOT affection THEN 1 ELSE 0 END) / {n}e0)')} AS strength FROM hits"


@operator("posts", "scores", "near", "across", "pasta")
def projection(d):
    """A post with its scores, copy groups and address, in one row."""
    return f"""
    SELECT p.post_id, p.narrative, p.platform, p.author_id, s.outrage_index, s.tier, s.polarity, n.group_id AS near_group, c.group_id AS cross_group, t.score AS copypasta,
           CASE WHEN p.platform = 'x' THEN concat('https://x.com/i/status/', CAST(p.post_id AS {"STRING" if d.name == "spark" else "VARCHAR"})) END AS address
    FROM posts p LEFT JOIN scores s ON p.post_id = s.post_id LEFT JOIN near n ON p.post_id = n.post_id LEFT JOIN across c ON p.post_id = c.post_id LEFT JOIN pasta t ON p.post_id = t.post_id"""


@operator("posts", "scores")
def best_posts(d):
    """The fifty posts of the highest index; a post without one counts as -1."""
    return "SELECT p.post_id, coalesce(s.outrage_index, -1e0) AS shown FROM posts p LEFT JOIN scores s ON p.post_id = s.post_id ORDER BY shown DESC, p.post_id LIMIT 50"


@operator("posts", "scores")
def client_filter(d):
    """Posts of an index of 0.2 or more; a post without one counts as -1."""
    return "SELECT p.post_id FROM posts p LEFT JOIN scores s ON p.post_id = s.post_id WHERE coalesce(s.outrage_index, -1e0) >= 2e-1"


@operator("posts", "bots")
def author_vertices(d):
    """Authors of a narrative for a graph: posts, largest score, first and last post, and the label of a known bot."""
    return """
    WITH a AS (SELECT narrative, author_id, min(platform) AS platform, count(*) AS posts, max(score_u) / 1e6 AS max_score, min(at_us) AS first_us, max_by(post_id, at_us * 1e0 + post_id / 1e9) AS last_post FROM posts GROUP BY narrative, author_id),
    b AS (SELECT author_id, min(label) AS label FROM bots GROUP BY author_id)
    SELECT a.narrative, a.author_id, a.posts, a.max_score, a.first_us, b.label IS NOT NULL AS known_bot, b.label AS bot_label FROM a LEFT JOIN b ON a.author_id = b.author_id AND a.platform = 'x'"""


@operator("posts", "scores")
def graph_posts(d):
    """Posts for a graph, with an index of 0 where there is none."""
    return f"SELECT p.post_id, p.narrative, p.author_id, {d.sha256('substring(p.text, 1, 500)')} AS text_digest, coalesce(s.outrage_index, 0e0) AS outrage_index FROM posts p LEFT JOIN scores s ON p.post_id = s.post_id"


@operator("posts")
def posts_by_author(d):
    """Posts, narratives and days of each author, busiest first."""
    return "SELECT author_id, count(*) AS posts, count(DISTINCT narrative) AS narratives, count(DISTINCT day) AS days, max(at_us) AS last_us FROM posts GROUP BY author_id ORDER BY posts DESC, author_id"


@operator("shares")
def parent_theme(d):
    """The theme that shares most posts with a copied-text cluster; ties by the theme."""
    return """
    WITH r AS (SELECT kind, cluster, theme, shared, row_number() OVER (PARTITION BY kind, cluster ORDER BY shared DESC, theme) AS k FROM shares)
    SELECT kind, cluster, theme, shared FROM r WHERE k = 1"""


@operator("clusters")
def copy_tiers(d):
    """Tier and label of a copied-text cluster from its kind, authors and bursts."""
    return """
    SELECT kind, cluster, CASE WHEN kind = 'exact' THEN CASE WHEN authors >= 3 THEN 'high' ELSE 'medium' END WHEN burst OR authors >= 3 THEN 'medium' ELSE 'low' END AS tier,
           CASE WHEN kind = 'exact' AND burst AND authors >= 3 THEN 'Template amplification' WHEN kind = 'exact' AND authors >= 3 THEN 'Exact duplicate campaign' WHEN kind = 'exact' THEN 'Near-copy cluster'
                WHEN burst THEN 'Near-copy burst' WHEN authors >= 3 THEN 'Near-copy campaign' ELSE 'Fuzzy similarity' END AS label FROM clusters"""


@operator("copies")
def copy_order(d):
    """Exact copies in the order of a report: bursts, authors in a burst, posts, authors."""
    return "SELECT first_post, posts, authors, burst_authors, burst FROM copies ORDER BY burst DESC, burst_authors DESC, posts DESC, authors DESC, first_post"


@operator("reports")
def group_order(d):
    """Near-copy groups in the order of a report: bursts, authors in a burst, authors, posts, similarity."""
    return "SELECT group_id, posts, authors, burst_authors, burst, similarity FROM reports ORDER BY burst DESC, burst_authors DESC, authors DESC, posts DESC, similarity DESC, group_id"


@operator("tiers")
def frame_order(d):
    """Coordinated frames: high tiers first, then by posts; between three and ten of them by the log of their number."""
    return """
    WITH n AS (SELECT count(*) AS k FROM tiers), r AS (SELECT theme, tier, posts, row_number() OVER (ORDER BY CASE WHEN tier = 'high' THEN 0 ELSE 1 END, posts DESC, theme) AS place FROM tiers)
    SELECT r.theme, r.tier, r.posts FROM r CROSS JOIN n WHERE r.place <= least(10, 3 + floor(log2(greatest(n.k, 1))))"""


@operator("copies", "reports")
def signals(d):
    """Sentences about copied text, and the floor that each puts under the suspicion."""
    text = "STRING" if d.name == "spark" else "VARCHAR"
    return f"""
    SELECT 'exact' AS kind, first_post AS cluster, concat(CAST(authors AS {text}), ' authors posted the same text ', CAST(posts AS {text}), ' times', CASE WHEN burst THEN ' within 90 seconds' ELSE '' END) AS signal,
           CASE WHEN burst THEN 72e-2 WHEN authors >= 2 THEN 32e-2 ELSE 0e0 END AS least FROM copies WHERE authors >= 2
    UNION ALL SELECT 'fuzzy', group_id, concat(CAST(authors AS {text}), ' authors posted near copies', CASE WHEN burst THEN ' within 90 seconds' ELSE '' END), CASE WHEN burst THEN 72e-2 WHEN authors >= 3 THEN 55e-2 ELSE 38e-2 END FROM reports WHERE authors >= 2"""


@operator("reasons")
def filter_buckets(d):
    """Number of the bucket for filtered posts; others have none."""
    return "SELECT post_id, CASE " + " ".join(f"WHEN reason = '{r}' THEN {b}" for r, b in BUCKETS.items()) + " END AS bucket FROM reasons"


@operator("posts")
def ingest_plan(d):
    """Posts that one run takes: the newest of each search, of so many searches, and so many in all."""
    return f"""
    WITH k AS (SELECT narrative FROM posts GROUP BY narrative ORDER BY count(*) DESC, narrative LIMIT {MOST_KEYWORDS}),
    r AS (SELECT p.narrative, p.post_id, p.at_us, row_number() OVER (PARTITION BY p.narrative ORDER BY p.at_us DESC, p.post_id DESC) AS place FROM posts p JOIN k ON p.narrative = k.narrative)
    SELECT narrative, post_id, at_us FROM r WHERE place <= {MOST_PER_SEARCH} ORDER BY at_us DESC, post_id DESC LIMIT {MOST_POSTS}"""


@operator("now", "before")
def sentiment_alerts(d):
    """Narratives whose state has got worse since the state before: trend, week over week, divergent days."""
    return """
    WITH s AS (SELECT n.narrative, n.trend, n.alert, n.days, coalesce(b.trend, 'insufficient_data') AS trend_before, coalesce(b.alert, 'none') AS alert_before, coalesce(b.days, 0) AS days_before FROM now n LEFT JOIN before b ON n.narrative = b.narrative)
    SELECT narrative, 'trend_escalating' AS kind, concat('was ', trend_before) AS detail FROM s WHERE trend = 'escalating' AND trend_before <> 'escalating'
    UNION ALL SELECT narrative, alert, concat('was ', alert_before) FROM s WHERE alert <> 'none' AND alert <> alert_before
    UNION ALL SELECT narrative, 'volume_divergence', 'more divergent days' FROM s WHERE days > days_before"""


@operator("lines", "weeks", "days")
def sentiment_state(d):
    """Trend, week-over-week alert and number of divergent days of each narrative."""
    return """
    WITH c AS (SELECT narrative, count(*) AS days FROM days GROUP BY narrative)
    SELECT l.narrative, l.trend, coalesce(w.alert, 'none') AS alert, coalesce(c.days, 0) AS days FROM lines l LEFT JOIN weeks w ON l.narrative = w.narrative LEFT JOIN c ON l.narrative = c.narrative"""


@operator("scores", "labels")
def benchmark_run(d):
    """Mean index and separation of up to two hundred labelled documents of each subset (a language of quality)."""
    mean = lambda t: f"CAST(sum(CASE WHEN toxic = {t} THEN CAST(floor(outrage_index * 1e4 + 5e-1) AS BIGINT) END) AS DOUBLE) / nullif(count_if(toxic = {t}), 0) / 1e4"
    return f"""
    WITH r AS (SELECT l.quality, l.toxic, s.outrage_index, row_number() OVER (PARTITION BY l.quality ORDER BY l.doc_id) AS k FROM labels l JOIN scores s ON l.doc_id = s.post_id),
    m AS (SELECT quality, count(*) AS n, CAST(count_if(toxic = 1) AS BIGINT) AS toxic, {mean(1)} AS high, {mean(0)} AS low FROM r WHERE k <= 200 GROUP BY quality)
    SELECT quality, n, toxic, {rounded("high")} AS toxic_mean, {rounded("low")} AS other_mean, {rounded("high - low")} AS separation FROM m"""


@operator("posts", "labels")
def label_summary(d):
    """Labelled posts of each narrative, and the labels that occur."""
    text = "STRING" if d.name == "spark" else "VARCHAR"
    return f"SELECT p.narrative, count(*) AS labelled, {d.join_set(f'concat(CAST(l.quality AS {text}), chr(47), CAST(l.toxic AS {text}))')} AS kinds FROM posts p JOIN labels l ON p.post_id = l.doc_id GROUP BY p.narrative"


@operator("posts")
def report_rows(d):
    """Posts, share of all, and age in hours of the last post of each narrative against the newest of all."""
    return f"""
    WITH n AS (SELECT narrative, count(*) AS posts, max(at_us) AS last_us FROM posts GROUP BY narrative), t AS (SELECT CAST(sum(posts) AS BIGINT) AS total, max(last_us) AS newest FROM n)
    SELECT n.narrative, n.posts, t.total, {rounded("CAST(t.newest - n.last_us AS DOUBLE) / 36e8", 2)} AS age_h FROM n CROSS JOIN t"""


@operator("posts", "edges")
def discovered(d):
    """Authors by how they came into view: first as the author of a post or as one who is answered."""
    return """
    WITH u AS (SELECT author_id, at_us, 0 AS side FROM posts UNION ALL SELECT target, at_us, 1 FROM edges),
    f AS (SELECT author_id, min(at_us * 2 + side) AS first, CAST(sum(1 - side) AS BIGINT) AS inserted FROM u GROUP BY author_id)
    SELECT author_id, CASE WHEN first % 2 = 0 THEN 'post' ELSE 'answer' END AS via, inserted FROM f"""
