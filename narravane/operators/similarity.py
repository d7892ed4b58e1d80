"""Fuzzy copies: pairs by Jaccard similarity of token sets, groups, and reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.functions.dialect import operator, rounded
from narravane.operators.bursts import BURST_AUTHORS, burst_authors
from narravane.operators.components import components

#: Fixed value: default threshold in hundredths.
THRESHOLD = 82


@operator("normal_posts")
def token_sets(d):
    """Distinct tokens of the normal text, sorted; posts without a token are left out."""
    tokens = d.distinct(d.all("normal", "[a-z0-9']+"))
    sort = "array_sort" if d.name == "spark" else "list_sort"
    return f"WITH t AS (SELECT post_id, author_id, {sort}({tokens}) AS tokens FROM normal_posts) SELECT post_id, author_id, tokens, {d.size('tokens')} AS n FROM t WHERE {d.size('tokens')} > 0"


def set_classes(sets: DataFrame) -> DataFrame:
    """Distinct token sets: (class_id, n, tokens), named by the smallest post."""
    return sets.groupBy("tokens").agg(F.min("post_id").alias("class_id"), F.first("n").alias("n"))


def _candidates(uniq: DataFrame, percent: int) -> DataFrame:
    """(a, b), not yet distinct: pairs of classes that share a token of their prefixes and may be similar enough.

    Sketches are the parities of tokens by 128 hashes: a bit in which two of them differ stands for a token, at least,
    that one set has alone.  At the first common token no more tokens are common than stand behind it in either set.
    Both bounds hold inside the join, so false candidates are never shuffled.
    """
    word = lambda low: F.expr(f"aggregate(tokens, 0L, (s, x) -> s ^ IF(pmod(xxhash64(x), 128) DIV 64 = {low}, shiftleft(1L, CAST(pmod(xxhash64(x), 64) AS INT)), 0L))")
    tokens = uniq.select("class_id", "n", word(0).alias("s"), word(1).alias("t"), F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    prefix = F.expr(f"n - ({percent} * n + 99) DIV 100 + 1")
    ranked = tokens.join(often, "token").selectExpr("class_id", "n", "s", "t", "token", "row_number() OVER (PARTITION BY class_id ORDER BY df, token) AS r")
    index = ranked.where(F.col("r") <= prefix).select("class_id", "n", "r", "s", "t", "token")
    x, y = index.toDF("a", "na", "ra", "sa", "ta", "token"), index.toDF("b", "nb", "rb", "sb", "tb", "token")
    common = f"({percent} * (na + nb) + {99 + percent}) DIV {100 + percent}"
    may = f"a < b AND 100 * least(na, nb) >= {percent} * greatest(na, nb) AND 1 + least(na - ra, nb - rb) >= {common} AND bit_count(sa ^ sb) + bit_count(ta ^ tb) <= na + nb - 2 * ({common})"
    return x.join(y, "token").where(may).select("a", "b")


def similar_pairs(sets: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """Pairs (a < b) of classes of equal token sets of at least this similarity, by a prefix join.

    Tokens are ordered by rising frequency; two sets that are similar enough
    share a token of their prefixes of n - ceil(t n) + 1 tokens.
    """
    uniq = set_classes(sets)
    near = _candidates(uniq, percent).distinct()
    full = uniq.select("class_id", "tokens")
    common = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - common
    met = near.join(full.toDF("a", "ta"), "a").join(full.toDF("b", "tb"), "b").where(100 * common >= percent * union)
    return met.select("a", "b", common.cast("double").alias("c"), union.alias("t")).selectExpr("a", "b", rounded("c / t") + " AS similarity")


#: DuckDB text for ``similar_pairs`` over ``sets``.
PAIRS_SQL = f"""
WITH u AS (SELECT tokens, min(post_id) AS class_id, max(n) AS n FROM sets GROUP BY tokens),
p AS (SELECT a.class_id AS a, b.class_id AS b, len(list_intersect(a.tokens, b.tokens)) AS common, a.n + b.n AS total FROM u a JOIN u b ON a.class_id < b.class_id AND 100 * least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n))
SELECT a, b, {rounded("CAST(common AS DOUBLE) / (total - common)")} AS similarity FROM p WHERE 100 * common >= {THRESHOLD} * (total - common)"""


def links_across_authors(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b, similarity) that connect posts of different authors, as many as classes and pairs.

    All posts of a class with two authors hang together, and so do all posts of
    two similar classes that have two authors between them.
    """
    classes = sets.join(set_classes(sets).select("tokens", "class_id"), "tokens").groupBy("class_id").agg(F.min("author_id").alias("lo"), F.max("author_id").alias("hi"), F.max("post_id").alias("last"))
    inside = classes.where("lo <> hi").select(F.col("class_id").alias("a"), F.col("last").alias("b"), F.lit(1.0).alias("similarity"))
    x, y = classes.select(F.col("class_id").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha")), classes.select(F.col("class_id").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    between = pairs.join(x, "a").join(y, "b").where(F.least("la", "lb") != F.greatest("ha", "hb")).select("a", "b", "similarity")
    return inside.unionByName(between)


def links_within_authors(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b, similarity) between posts of one author; equal sets of an author are linked through the first."""
    members = sets.join(set_classes(sets).select("tokens", "class_id"), "tokens").groupBy("class_id", "author_id").agg(F.min("post_id").alias("first"), F.max("post_id").alias("last"))
    inside = members.where("first <> last").select(F.col("first").alias("a"), F.col("last").alias("b"), F.lit(1.0).alias("similarity"))
    x = members.select(F.col("class_id").alias("a"), "author_id", F.col("first").alias("pa"))
    y = members.select(F.col("class_id").alias("b"), "author_id", F.col("first").alias("pb"))
    between = pairs.join(x, "a").join(y, ["b", "author_id"]).select(F.col("pa").alias("a"), F.col("pb").alias("b"), "similarity")
    return inside.unionByName(between)


def groups_of(sets: DataFrame, links: DataFrame, same_author: bool) -> DataFrame:
    """(post_id, group_id) of posts that hang together; a group is named by its smallest post."""
    key = ["tokens", "author_id"] if same_author else ["tokens"]
    roots = components(links.select("a", "b"))
    classes = sets.groupBy(*key).agg(F.min("post_id").alias("node"))
    return sets.join(classes, key).join(roots, "node").select("post_id", F.col("component").alias("group_id"))


def post_pairs_sql(same_author: bool) -> str:
    """DuckDB text for all linked pairs of posts over ``sets``, by comparing them all."""
    return f"""
WITH p AS (SELECT a.post_id AS a, b.post_id AS b, len(list_intersect(a.tokens, b.tokens)) AS common, a.n + b.n AS total FROM sets a JOIN sets b ON a.post_id < b.post_id AND a.author_id {"=" if same_author else "<>"} b.author_id)
SELECT a, b, {rounded("CAST(common AS DOUBLE) / (total - common)")} AS similarity FROM p WHERE 100 * common >= {THRESHOLD} * (total - common)"""


#: DuckDB text for ``groups_of`` over ``links``.
GROUPS_SQL = """
WITH RECURSIVE l AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r(node, other) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a)
SELECT node AS post_id, min(other) AS group_id FROM r GROUP BY node"""


@operator("groups", "posts", "links")
def group_report(d):
    """Size, authors, largest similarity, bursts and longest text of each group."""
    longest = "max_by(substring(m.text, 1, 160), struct(length(m.text), -m.post_id))" if d.name == "spark" else "first(substring(m.text, 1, 160) ORDER BY length(m.text) DESC, m.post_id)"
    return f"""
    WITH s AS (SELECT g.group_id, max(l.similarity) AS similarity FROM links l JOIN groups g ON l.a = g.post_id GROUP BY g.group_id),
    m AS (SELECT g.group_id, p.post_id, p.author_id, p.at_us, p.text FROM groups g JOIN posts p ON g.post_id = p.post_id),
    n AS ({burst_authors(d, "m", "group_id")})
    SELECT m.group_id, count(*) AS posts, count(DISTINCT m.author_id) AS authors, max(s.similarity) AS similarity, max(n.burst_authors) AS burst_authors, max(n.burst_authors) >= {BURST_AUTHORS} AS burst, {longest} AS sample
    FROM m JOIN s ON m.group_id = s.group_id JOIN n ON m.group_id = n.group_id GROUP BY m.group_id"""


@operator("groups", "posts")
def author_spam(d):
    """Authors of three posts or more: posts, span in hours, and the smallest of their groups of three or more."""
    return f"""
    WITH a AS (SELECT author_id, count(*) AS posts, {rounded("CAST(max(at_us) - min(at_us) AS DOUBLE) / 36e8", 2)} AS span_h FROM posts GROUP BY author_id HAVING count(*) >= 3),
    k AS (SELECT p.author_id, g.group_id, count(*) AS n FROM groups g JOIN posts p ON g.post_id = p.post_id GROUP BY p.author_id, g.group_id HAVING count(*) >= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY n, group_id DESC) AS at FROM k)
    SELECT a.author_id, a.posts, a.span_h, r.group_id, r.n AS group_posts FROM a LEFT JOIN r ON a.author_id = r.author_id AND r.at = 1"""


@operator("sets", "templates")
def copypasta(d):
    """Similarity of each post to the longest template."""
    inter, union = ("size(array_intersect(s.tokens, t.tokens))", "size(array_union(s.tokens, t.tokens))") if d.name == "spark" else ("len(list_intersect(s.tokens, t.tokens))", "len(list_distinct(list_concat(s.tokens, t.tokens)))")
    return f"""
    WITH t AS (SELECT tokens FROM templates ORDER BY n DESC, post_id LIMIT 1)
    SELECT s.post_id, {rounded(f"CAST({inter} AS DOUBLE) / {union}")} AS score FROM sets s CROSS JOIN t"""


@operator("copies", "reports", "hits")
def text_coordination(d):
    """Text score, the largest of the fixed floors that hold: bursts, copies, fuzzy groups, and actors of other narratives."""
    return f"""
    WITH c AS (SELECT count(*) AS n, CAST(count_if(burst) AS BIGINT) AS bursts, CAST(count_if(authors >= 2) AS BIGINT) AS shared FROM copies),
    f AS (SELECT count(*) AS n, CAST(count_if(burst) AS BIGINT) AS bursts, CAST(count_if(authors >= 3) AS BIGINT) AS three, CAST(count_if(authors >= 2) AS BIGINT) AS two FROM reports), h AS (SELECT count(*) AS n FROM hits)
    SELECT c.n AS copied, f.n AS fuzzy, h.n AS hits, {rounded("greatest(CASE WHEN c.bursts > 0 THEN 72e-2 WHEN c.shared > 0 THEN 32e-2 ELSE 0e0 END, CASE WHEN f.bursts > 0 THEN 72e-2 WHEN f.three > 0 THEN 55e-2 WHEN f.two > 0 THEN 38e-2 ELSE 0e0 END, CASE WHEN h.n >= 3 THEN 6e-1 WHEN h.n >= 1 THEN 45e-2 ELSE 0e0 END)")} AS text_score
    FROM c CROSS JOIN f CROSS JOIN h"""


@operator("text_scores", "graph_scores", "shapes")
def combined_score(d):
    """The larger of graph and text score, its complement, and whether the graph is large enough to tell."""
    return f"""
    SELECT t.text_score, g.suspicion AS graph_score, {rounded("least(1e0, greatest(t.text_score, g.suspicion))")} AS combined, {rounded("1e0 - least(1e0, greatest(t.text_score, g.suspicion))")} AS organic,
           {rounded("CASE WHEN s.authors = 0 THEN 0e0 ELSE 1e2 * s.connected / s.authors END", 1)} AS coverage_pct, s.edges >= 10 AND s.authors > 0 AND CAST(s.connected AS DOUBLE) / s.authors >= 5e-2 AS sufficient
    FROM text_scores t CROSS JOIN graph_scores g CROSS JOIN (SELECT CAST(sum(edges) AS BIGINT) AS edges, CAST(sum(authors) AS BIGINT) AS authors, CAST(sum(connected) AS BIGINT) AS connected FROM shapes) s"""
