"""Keywords against keywords without comparing all with all, a check of queries, and suggestions for what isn't covered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.functions.dialect import operator, rounded
from narravane.operators.keywords import ALIKE, _tokens

# Words that anchor a query, words that spoil one, phrases that are enough, and the suggestions of an audit.
ANCHORS = (
    "midterm midterms election fraud integrity gerrymandering gerrymander democrat democrats republican republicans gop ballot ballots vote voting voter voters senate congress congressional house primary caucus "
    "swing district poll polls turnout impeach resign resigns electoral supreme court scotus immigration border deportation deportations suburban rural"
).split()
BLOCKED = "hulhumale looms phase disaster setting taxes working million americans replaced unregulated dirty post posts spells spell".split()
ENOUGH = ("red wave", "blue wave", "midterm fraud", "election fraud", "election integrity", "supreme court", "midwest democrat", "swing state", "house midterms")
SUGGESTIONS = 8
#: Lengths of the beginnings by which contained texts are found.
BEGINNINGS = (1, 2, 4, 8)
#: Keywords of a narrative at most, as its configuration has them.
CONFIGURED = 10_000


@operator("queries")
def valid_queries(d):
    """Whether a query is fit for a search, and the first reason why not."""
    words = lambda among: d.size(d.keep("tokens", "x IN (" + ", ".join(f"'{w}'" for w in among) + ")"))
    return f"""
    WITH t AS (SELECT DISTINCT query, trim(lower(query)) AS q, {d.distinct(_tokens(d, "trim(query)"))} AS tokens FROM queries),
    r AS (SELECT query, CASE WHEN length(q) < 8 THEN 'too short' WHEN q LIKE 'author:%' THEN 'author poll' WHEN {d.size("tokens")} = 0 THEN 'no words' WHEN {words(BLOCKED)} > 0 THEN 'blocked word'
                 WHEN {d.like("q", "|".join(ENOUGH))} THEN '' WHEN {words(ANCHORS)} = 0 THEN 'no anchor' WHEN {d.size("tokens")} >= 2 OR length(q) >= 12 THEN '' ELSE 'one short word' END AS reason FROM t)
    SELECT query, reason = '' AS ok, reason FROM r"""


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay): texts that stand in others.  A needle is looked up by its beginning among the parts of that length of a hay."""
    begins = F.expr(" ".join(["CASE", *[f"WHEN length(needle) >= {n} THEN substring(needle, 1, {n})" for n in reversed(BEGINNINGS)], "END"]))
    keyed = needles.where("needle <> ''").distinct().withColumn("part", begins)
    of_length = ", ".join(f"IF(length(hay) < {n}, CAST(array() AS ARRAY<STRING>), transform(sequence(1, length(hay) - {n - 1}), i -> substring(hay, i, {n})))" for n in BEGINNINGS)
    parts = hays.distinct().select("hay", F.explode(F.array_distinct(F.expr(f"concat({of_length})"))).alias("part"))
    return parts.join(keyed, "part").where(F.col("hay").contains(F.col("needle"))).select("needle", "hay")


def covered(queries: DataFrame, existing: DataFrame) -> DataFrame:
    """(query, covered): whether a keyword in use covers a term: one holds the other, or they share a word."""
    asked = queries.select("query", F.lower(F.trim("query")).alias("text"), F.regexp_extract_all(F.lower("query"), F.lit(r"[^ \t\n\r\f]+"), F.lit(0)).alias("words")).distinct()
    used = existing.select(F.lower(F.trim("keyword")).alias("text"), F.regexp_extract_all(F.lower("keyword"), F.lit(r"[^ \t\n\r\f]+"), F.lit(0)).alias("words")).distinct()
    inside = contained(asked.select(F.col("text").alias("needle")), used.select(F.col("text").alias("hay"))).select(F.col("needle").alias("text"))
    around = contained(used.select(F.col("text").alias("needle")), asked.select(F.col("text").alias("hay"))).select(F.col("hay").alias("text"))
    filled = lambda df: df.where("text <> ''").select("text", F.explode("words").alias("word"))
    shared = filled(asked).join(filled(used).select("word").distinct(), "word", "left_semi").select("text")
    hits = inside.unionByName(around).unionByName(shared).distinct().withColumn("hit", F.lit(True))
    return asked.join(hits, "text", "left").groupBy("query").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("covered"))


def similar_to_existing(queries: DataFrame, existing: DataFrame) -> DataFrame:
    """(query, alike): whether a suggestion is like a keyword in use: equal, part of it, words inside each other, or two thirds in common.

    Pairs with enough common words share one of the rarest words of one side: as many as it may lack, and one more.
    """
    from narravane.functions.dialect import SPARK

    tokens = lambda c: F.expr(f"array_distinct({_tokens(SPARK, c)})")
    asked = queries.select("query", F.lower(F.trim("query")).alias("text"), tokens("query").alias("words")).distinct()
    used = existing.select(F.lower(F.trim("keyword")).alias("text"), tokens("keyword").alias("words")).distinct()
    inside = contained(asked.select(F.col("text").alias("needle")), used.select(F.col("text").alias("hay"))).select(F.col("needle").alias("text"))
    around = contained(used.select(F.col("text").alias("needle")), asked.select(F.col("text").alias("hay"))).select(F.col("hay").alias("text"))
    # an empty text is part of any other
    empty = asked.where("text = ''").select("text").join(used.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_semi")
    all_empty = asked.select("text").join(used.where("text = ''").select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_semi")
    often = asked.unionByName(used.withColumn("query", F.col("text"))).select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("f"))

    def ranked(df: DataFrame) -> DataFrame:
        by_word = df.where("size(words) > 0").select("text", "words", F.explode("words").alias("word")).join(often, "word")
        return by_word.groupBy("text", "words").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "word"))), lambda x: x["word"]).alias("words_"))

    left, right = (ranked(df.select("text", "words").distinct()).select(F.col("text").alias(t), F.col("words_").alias(w)) for df, t, w in ((asked, "text", "a"), (used, "other", "b")))
    rare = F.expr(f"slice(a, 1, greatest(1, CAST(size(a) - ceil({ALIKE} * size(a)) + 1 AS INT)))")
    by_left = left.select("text", "a", F.explode(rare).alias("word")).join(right.select("other", "b", F.explode("b").alias("word")), "word")
    by_right = right.select("other", "b", F.col("b")[0].alias("word")).join(left.select("text", "a", F.explode("a").alias("word")), "word")
    common = F.size(F.array_intersect("a", "b"))
    near = by_left.unionByName(by_right).where((common == F.size("a")) | (common == F.size("b")) | (common / F.size(F.array_union("a", "b")) >= F.expr(ALIKE))).select("text")
    hits = inside.unionByName(around).unionByName(near).unionByName(empty).unionByName(all_empty).distinct().withColumn("hit", F.lit(True))
    return asked.join(hits, "text", "left").groupBy("query").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("alike"))


@operator("terms", "covers", "checks")
def suggestions(d):
    """Up to eight queries that no keyword covers: terms of themes, and as many of the corpus as there is room for, one at least.

    ``terms`` has (term, score, source), the source being theme or corpus; ``covers`` (query, covered) and ``checks``
    (query, ok) judge each term.
    """
    return f"""
    WITH t AS (SELECT term, min(CASE source WHEN 'theme' THEN 0 ELSE 1 END) AS side FROM terms GROUP BY term),
    b AS (SELECT x.term, t.side, max(x.score) AS score FROM terms x JOIN t ON x.term = t.term AND t.side = CASE x.source WHEN 'theme' THEN 0 ELSE 1 END GROUP BY x.term, t.side),
    u AS (SELECT b.* FROM b JOIN covers c ON c.query = b.term JOIN checks v ON v.query = b.term WHERE NOT c.covered AND v.ok),
    n AS (SELECT count(*) AS themes FROM u WHERE side = 0),
    k AS (SELECT term, score, side FROM u WHERE side = 1 ORDER BY score DESC, term LIMIT {SUGGESTIONS}), p AS (SELECT *, row_number() OVER (ORDER BY score DESC, term) AS place FROM k),
    a AS (SELECT term, score, side FROM u WHERE side = 0 UNION ALL SELECT p.term, p.score, p.side FROM p CROSS JOIN n WHERE p.place <= greatest(1, {SUGGESTIONS} - n.themes))
    SELECT term AS query, CASE side WHEN 0 THEN 'theme' ELSE 'corpus' END AS source, {rounded("score", 3)} AS score FROM a ORDER BY score DESC, query LIMIT {SUGGESTIONS}"""


def ingest_gate(reasons: DataFrame, posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(post_id, gate, allow, keyword_hits): whether a post may enter, and why not; without a keyword in its text it is off topic.

    The keywords of a narrative are configuration; they go along as one literal, so posts are read once and not joined.
    """
    words = [r.word for r in keywords.select(F.lower(F.trim("keyword")).alias("word")).limit(CONFIGURED + 1).collect()]
    if len(words) > CONFIGURED:
        raise ValueError(f"more than {CONFIGURED} keywords")
    low = F.lower("text")
    hits = sum((F.when(low.contains(w), 1).otherwise(0) for w in words if w), F.lit(0)).cast("long") if len(words) <= 64 else F.size(F.filter(F.array(*[F.lit(w) for w in words if w]), lambda w: low.contains(w))).cast("long")
    judged = reasons.join(posts.select("post_id", hits.alias("keyword_hits")), "post_id")
    gate = F.when(F.col("reason") == "market", "market_chatter").when(F.col("reason") != "narrative", F.col("reason")).when(F.col("keyword_hits") == 0, "off_topic").otherwise("ok")
    return judged.select("post_id", gate.alias("gate"), ((F.col("reason") == "narrative") & (F.col("keyword_hits") > 0)).alias("allow"), "keyword_hits")
