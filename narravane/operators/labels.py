"""Theme labels: known phrases, label quality and scores, relatedness of themes, and what follows for a theme."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.functions.dialect import operator, rounded
from narravane.operators.scoring import TICKERS
from narravane.operators.text import STOP_WORDS

# Phrases that name a frame.
KNOWN_PHRASES = (
    "red wave", "blue wave", "america first", "deep state", "stop the steal", "great replacement", "open border", "border crisis", "election fraud", "election integrity", "voter fraud", "mail ballot",
    "ballot harvesting", "executive order", "governor race", "midterm election", "fake news", "radical left", "radical right", "lock her up", "climate hoax", "mainstream media", "culture war", "law and order",
    "sanctuary city", "sanctuary cities", "welfare state", "second amendment", "gun control", "pro life", "pro choice",
)
# Words that two themes may share by chance.
GENERIC = (
    "election elections vote votes voting ballot ballots trump biden gop democrat democrats republican republicans midterm midterms senate house state states president political politics campaign primary general "
    "county american america country national rights news media people today year years day days need make just like"
).split()
# Fragments, weak first and last words, and auxiliaries of labels.
FRAGMENTS = ("feel sorry", "he's purposely", "what's coming", "hackers laying", "slow rolling", "spread word", "word spread")
WEAK_START = "he she it we they what that this there here who how when where why he's she's it's we're they're what's that's who's here's there's feel felt".split()
WEAK_END = "laying coming going doing being getting making taking purposely slowly rolling spread sorry really just still again about around".split()
GLUE = "is are was were be been being have has had do does did will would could should may might can purposely slowly".split()
MOODS = "good bad best worst nice great big huge".split()
# Thresholds of themes.
EMERGING_SIZE, EMERGING_COHESION, EMERGING_LEXICON, DISTINCT, MARKET_THEME = 3, "55e-2", "25e-2", "12e-2", "32e-2"
#: Manual merges that an analyst may have.
MANUAL = 10_000
MERGE_SURE, MERGE_RELATED, MERGE_SCORE, CENTROID_EDGE = "93e-2", "82e-2", "28e-2", "35e-2"


def _is(d, x: str, words) -> str:
    return d.like(x, "^(?:" + "|".join(words) + ")$")


@operator("posts")
def known_phrases(d):
    """How often each known phrase stands in the posts of a narrative, without overlaps."""
    rows = ", ".join(f"('{p}')" for p in KNOWN_PHRASES)
    times = "CAST(length(t.low) - length(replace(t.low, k.phrase, '')) AS BIGINT)"
    return f"""
    WITH t AS (SELECT narrative, lower(text) AS low FROM posts WHERE {d.like("lower(text)", "|".join(KNOWN_PHRASES))}),
    c AS (SELECT t.narrative, k.phrase, {d.div(times, "CAST(length(k.phrase) AS BIGINT)")} AS n FROM t CROSS JOIN (VALUES {rows}) AS k(phrase) WHERE contains(t.low, k.phrase))
    SELECT narrative, phrase, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY narrative, phrase"""


@operator("phrases")
def phrase_quality(d):
    """Quality of a label from its words, the first rule that holds; 1 for a known phrase or plain words."""
    words = "(length(p) - length(replace(p, ' ', '')) + 1)"
    first, last = "split_part(p, ' ', 1)", "split_part(p, ' ', -1)"
    meaning = f"length(p) >= 3 AND NOT {d.like('p', '^[0-9]+$')} AND NOT {_is(d, 'p', STOP_WORDS)} AND NOT {_is(d, 'p', MOODS)}"
    return f"""
    WITH d AS (SELECT DISTINCT phrase, trim(lower(phrase)) AS p FROM phrases)
    SELECT phrase, CASE WHEN p = '' THEN 0e0 WHEN {_is(d, "p", FRAGMENTS)} THEN 5e-2 WHEN {_is(d, "p", KNOWN_PHRASES)} THEN 1e0
      WHEN {words} = 1 THEN CASE WHEN {meaning} THEN 1e0 ELSE 0e0 END
      WHEN {_is(d, first, WEAK_START)} THEN 12e-2 WHEN {_is(d, last, WEAK_END)} THEN 18e-2
      WHEN {words} = 2 AND {_is(d, first, GLUE)} AND {_is(d, last, GLUE)} THEN 8e-2 WHEN {words} = 2 AND {_is(d, first, GLUE)} THEN 22e-2 WHEN {words} = 2 AND {_is(d, last, GLUE)} THEN 55e-2
      WHEN NOT {d.like("p", "[^ ]{5,}")} THEN 35e-2 ELSE 1e0 END AS quality FROM d"""


@operator("weights", "qualities")
def label_scores(d):
    """Weight of a label times its quality and the boost of known phrases; nothing below a quality of 0.25."""
    boost = f"CASE WHEN {_is(d, 'w.phrase', KNOWN_PHRASES)} THEN 145e-2 WHEN {d.like('w.phrase', '|'.join(KNOWN_PHRASES))} OR contains('{'|'.join(KNOWN_PHRASES)}', w.phrase) THEN 125e-2 ELSE 1e0 END"
    bonus = "CASE WHEN contains(w.phrase, ' ') THEN 0e0 WHEN length(w.phrase) >= 7 THEN 35e-2 WHEN length(w.phrase) >= 5 THEN 2e-1 ELSE 0e0 END"
    return f"""
    SELECT w.narrative, w.phrase, w.n, {rounded(f"CASE WHEN q.quality < 25e-2 THEN 0e0 ELSE w.weight * q.quality * {boost} END", 3)} AS score, {bonus} AS bonus
    FROM weights w JOIN qualities q ON w.phrase = q.phrase"""


@operator("scores")
def first_labels(d):
    """Up to five labels of each narrative by score, count and phrase, none without a score."""
    return """
    WITH r AS (SELECT narrative, phrase, score, row_number() OVER (PARTITION BY narrative ORDER BY score DESC, n DESC, phrase) AS k FROM scores WHERE score > 0)
    SELECT narrative, phrase, score, CAST(k AS BIGINT) AS place FROM r WHERE k <= 5"""


@operator("labels")
def market_labels(d):
    """Whether the labels of a narrative are about markets: half of their words are tickers, or the very first one is."""
    ticker = _is(d, "x", (*TICKERS, "mkt"))
    words = d.all("phrase", "[^ ]+")
    return f"""
    WITH w AS (SELECT narrative, place, phrase, {d.size(d.keep(words, ticker))} AS market, {d.size(words)} AS words, {_is(d, "split_part(phrase, ' ', 1)", TICKERS)} AS leads FROM labels)
    SELECT narrative, CAST(sum(market) AS BIGINT) AS market_words, CAST(sum(words) AS BIGINT) AS words, 2 * sum(market) >= sum(words) OR max(place = 1 AND leads) AS market_heavy FROM w GROUP BY narrative"""


@operator("tops", "known")
def relatedness(d):
    """Whether two narratives share a frame: a known phrase, or enough of their top ten terms that are not generic."""
    return f"""
    WITH t AS (SELECT narrative, term, NOT {_is(d, "term", (*GENERIC, *MOODS))} AS own FROM tops), n AS (SELECT narrative, count(*) AS k FROM t GROUP BY narrative),
    s AS (SELECT a.narrative AS a, b.narrative AS b, count(*) AS shared, CAST(count_if(a.own) AS BIGINT) AS telling FROM t a JOIN t b ON a.term = b.term AND a.narrative < b.narrative GROUP BY a.narrative, b.narrative),
    f AS (SELECT DISTINCT a.narrative AS a, b.narrative AS b FROM known a JOIN known b ON a.phrase = b.phrase AND a.narrative < b.narrative),
    p AS (SELECT coalesce(s.a, f.a) AS a, coalesce(s.b, f.b) AS b, f.a IS NOT NULL AS frame, coalesce(s.shared, 0) AS shared, coalesce(s.telling, 0) AS telling FROM s FULL JOIN f ON s.a = f.a AND s.b = f.b),
    r AS (SELECT p.*, CAST(p.telling AS DOUBLE) / least(x.k, y.k) AS share FROM p JOIN n x ON p.a = x.narrative JOIN n y ON p.b = y.narrative)
    SELECT a, b, frame OR (telling >= 2 AND share >= 22e-2) OR (telling = 1 AND shared >= 2 AND share >= 35e-2) AS related,
           {rounded("CASE WHEN frame THEN 1e0 WHEN telling >= 2 OR (telling = 1 AND shared >= 2) THEN share ELSE 0e0 END")} AS score FROM r"""


@operator("members", "cohesions", "strengths", "markets", "topics")
def theme_facts(d):
    """Size, cohesion, mean lexicon strength, market mean and distinctiveness of each theme.

    Distinctive is the share of its top ten terms that no other theme has among its own.
    """
    return f"""
    WITH p AS (SELECT m.theme, count(*) AS size, CAST(sum(CAST(floor(h.strength * 1e4 + 5e-1) AS BIGINT)) AS BIGINT) AS strength, CAST(sum(CAST(floor(k.market_score * 1e4 + 5e-1) AS BIGINT)) AS BIGINT) AS market FROM members m JOIN strengths h ON m.post_id = h.post_id JOIN markets k ON m.post_id = k.post_id GROUP BY m.theme),
    x AS (SELECT m.theme, t.tokens FROM members m JOIN topics t ON m.post_id = t.post_id),
    c AS (SELECT theme, term, count(*) AS n FROM x {d.unnest("tokens", "term")} GROUP BY theme, term),
    r AS (SELECT theme, term, row_number() OVER (PARTITION BY theme ORDER BY n DESC, term) AS k FROM c),
    o AS (SELECT term, count(*) AS themes, min(theme) AS theme FROM r WHERE k <= 10 GROUP BY term),
    u AS (SELECT theme, count(*) AS own FROM o WHERE themes = 1 GROUP BY theme)
    SELECT p.theme, p.size, g.cohesion, {rounded("p.strength / (1e4 * p.size)")} AS lexicon_rate, {rounded("p.market / (1e4 * p.size)")} AS market_rate, coalesce(u.own, 0) / 1e1 AS distinctive
    FROM p JOIN cohesions g ON p.theme = g.theme LEFT JOIN u ON p.theme = u.theme"""


@operator("facts", "markets")
def theme_quality(d):
    """Quality, confidence, emerging themes, the boost of their posts, and limits by size for merging and k-means.

    A theme is about markets by the mean of its posts or by its labels (``markets``: narrative, market_heavy).
    ``plain_confidence`` holds for themes over term weights, ``confidence`` for those over embeddings.
    """
    return f"""
    WITH q AS (SELECT f.*, market_rate >= {MARKET_THEME} OR coalesce(m.market_heavy, false) AS market, {rounded("45e-2 * cohesion + 35e-2 * distinctive + 2e-1 * (1e0 - lexicon_rate)")} AS plain FROM facts f LEFT JOIN markets m ON f.theme = m.narrative),
    e AS (SELECT *, CASE WHEN market THEN {rounded("plain * 35e-2")} ELSE plain END AS quality, NOT market AND size >= {EMERGING_SIZE} AND cohesion >= {EMERGING_COHESION} AND lexicon_rate <= {EMERGING_LEXICON} AND distinctive >= {DISTINCT} AS emerging FROM q)
    SELECT theme, size, cohesion, distinctive, market, quality, CASE WHEN quality >= 55e-2 AND cohesion >= 55e-2 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN quality >= 4e-1 THEN 'medium' ELSE 'low' END AS plain_confidence, emerging,
           CASE WHEN emerging THEN {rounded("least(14e-2, 6e-2 + cohesion * 8e-2)")} ELSE 0e0 END AS boost,
           CASE WHEN size <= 0 THEN 48 ELSE least(48, greatest(12, CAST(floor(size * 32e-2) AS BIGINT))) END AS merge_cap, CASE WHEN size < 3 THEN 1 ELSE least(6, greatest(2, {d.div("size", "25")})) END AS kmeans_k FROM e"""


@operator("qualities")
def theme_order(d):
    """Themes in the order of a report: market themes last, then distinctive, emerging, large and cohesive ones first; whether the timeline has them."""
    return f"SELECT theme, market, distinctive, emerging, size, cohesion, emerging OR distinctive >= {DISTINCT} AS in_timeline FROM qualities ORDER BY market, distinctive DESC, emerging DESC, size DESC, cohesion DESC, theme"


@operator("qualities")
def theme_cards(d):
    """The sixteen largest themes that are not about markets, as a client shows them."""
    return "SELECT theme, size, quality, confidence, CASE WHEN emerging THEN 'emerging' ELSE 'established' END AS badge FROM qualities WHERE NOT market ORDER BY size DESC, theme LIMIT 16"


@operator("units")
def centroid_edges(d):
    """Pairs of themes whose centroids have a cosine of 0.35 or more, and what that means for merging."""
    flat = "SELECT vec_id, label, posexplode(v) AS (i, x) FROM units" if d.name == "spark" else "SELECT vec_id, label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM units"
    return f"""
    WITH f AS ({flat}), c AS (SELECT label, i, avg(x) AS m FROM f GROUP BY label, i), l AS (SELECT label, sqrt(sum(m * m)) AS size FROM c GROUP BY label),
    p AS (SELECT a.label AS a, b.label AS b, sum(a.m * b.m) AS dot FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY a.label, b.label),
    s AS (SELECT p.a, p.b, {rounded("p.dot / (x.size * y.size)")} AS cosine FROM p JOIN l x ON p.a = x.label JOIN l y ON p.b = y.label WHERE x.size > 0 AND y.size > 0)
    SELECT a, b, cosine, CASE WHEN cosine >= {MERGE_SURE} THEN 'merge' WHEN cosine >= {MERGE_RELATED} THEN 'merge if related' ELSE 'edge' END AS meaning FROM s WHERE cosine >= {CENTROID_EDGE}"""


@operator("edges", "related")
def merges(d):
    """Pairs of themes that are merged: very near centroids, or near ones of related themes."""
    return f"""
    SELECT e.a, e.b, e.cosine, coalesce(r.score, 0e0) AS score FROM edges e LEFT JOIN related r ON e.a = r.a AND e.b = r.b
    WHERE e.cosine >= {MERGE_SURE} OR (e.cosine >= {MERGE_RELATED} AND r.related AND r.score >= {MERGE_SCORE})"""


def merge_targets(members: DataFrame, merged: DataFrame) -> DataFrame:
    """(theme, at): where the posts of each merged theme are after all manual merges.

    ``merged`` has (step, theme, into_theme).  Merges apply in turn: one whose source or target isn't there any more, or
    never was, is left out.  It is a list that an analyst wrote, so its resolution is a small matter of the driver; of
    the members only the themes it names are asked for.
    """
    steps = [tuple(r) for r in merged.select("step", "theme", "into_theme").orderBy("step", "theme", "into_theme").limit(MANUAL + 1).collect()]
    if len(steps) > MANUAL:
        raise ValueError(f"more than {MANUAL} manual merges")
    named = sorted({t for _, *pair in steps for t in pair})
    alive = {r.theme for r in members.where(F.col("theme").isin(named)).select("theme").distinct().collect()} if named else set()
    at = {t: t for t in alive}
    for _, source, target in steps:
        if source != target and source in alive and target in alive:
            alive.discard(source)
            at = {t: target if place == source else place for t, place in at.items()}
    return members.sparkSession.createDataFrame([(t, place) for t, place in at.items() if t != place], "theme long, at long")


#: DuckDB text for ``merge_targets``: one step after the other.
MERGE_TARGETS_SQL = """
WITH RECURSIVE s AS (SELECT *, row_number() OVER (ORDER BY step, theme, into_theme) AS k FROM merged),
r(k, theme, place) AS (
  SELECT CAST(0 AS BIGINT), theme, theme FROM (SELECT DISTINCT theme FROM members) t
  UNION ALL
  SELECT r.k + 1, r.theme, CASE WHEN r.place = s.theme AND s.theme <> s.into_theme AND max(CASE WHEN r.theme = s.theme AND r.place = s.theme THEN 1 ELSE 0 END) OVER () = 1
    AND max(CASE WHEN r.theme = s.into_theme AND r.place = s.into_theme THEN 1 ELSE 0 END) OVER () = 1 THEN s.into_theme ELSE r.place END FROM r JOIN s ON s.k = r.k + 1)
SELECT theme, place AS "at" FROM r WHERE k = (SELECT count(*) FROM s) AND place <> theme"""


@operator("members", "targets", "split")
def overridden(d):
    """Members after manual changes: merged themes first (``targets``), then ``split`` (theme, post_id, part) replaces a theme.

    A theme is split only if it is there and has two parts or more; they become the themes id * 100 + part, counted
    from 0, and posts in no part go.
    """
    at = '"at"' if d.name == "duckdb" else "at"
    return f"""
    WITH m AS (SELECT DISTINCT coalesce(g.{at}, m.theme) AS theme, m.post_id FROM members m LEFT JOIN targets g ON m.theme = g.theme),
    p AS (SELECT s.theme FROM (SELECT theme FROM split GROUP BY theme HAVING max(part) >= 1) s JOIN (SELECT DISTINCT theme FROM m) t ON s.theme = t.theme)
    SELECT m.theme, m.post_id FROM m LEFT JOIN p ON m.theme = p.theme WHERE p.theme IS NULL
    UNION ALL SELECT s.theme * 100 + s.part, s.post_id FROM (SELECT DISTINCT theme, post_id, part FROM split) s JOIN p ON s.theme = p.theme"""


@operator("members", "groups")
def must_linked(d):
    """Themes after all posts of a near-copy group go to the theme most of them are in; ties by the smaller theme."""
    return """
    WITH c AS (SELECT g.group_id, m.theme, count(*) AS n FROM members m JOIN groups g ON m.post_id = g.post_id GROUP BY g.group_id, m.theme),
    r AS (SELECT group_id, theme, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, theme) AS k FROM c)
    SELECT m.post_id, m.theme AS before, coalesce(r.theme, m.theme) AS theme FROM members m LEFT JOIN groups g ON m.post_id = g.post_id LEFT JOIN r ON g.group_id = r.group_id AND r.k = 1"""
