"""Search keywords: validity, coverage, similarity, and a rotation plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.functions.dialect import operator

#: Share of common tokens that makes two queries alike, and the limits of a stale keyword.
ALIKE, STALE_RUNS, STALE_INSERTED, STALE_YIELD = "66e-2", 5, 2, "15e-2"


def _tokens(d, text: str) -> str:
    """Words of three characters or more that are no years."""
    return d.keep(d.all(f"lower({text})", "[^ \\t\\n\\r\\f]+"), f"length(x) >= 3 AND NOT {d.like('x', '^(19|20)[0-9][0-9]$')}")


def _common(d, a: str, b: str) -> str:
    return f"CAST(size(array_intersect({a}, {b})) AS BIGINT)" if d.name == "spark" else f"CAST(len(list_intersect({a}, {b})) AS BIGINT)"


def _union(d, a: str, b: str) -> str:
    return f"CAST(size(array_union({a}, {b})) AS BIGINT)" if d.name == "spark" else f"CAST(len(list_distinct(list_concat({a}, {b}))) AS BIGINT)"


@operator("queries")
def fingerprints(d):
    """A query's tokens, and a digest of them that ignores their order."""
    tokens = _tokens(d, "query")
    sort = "array_sort" if d.name == "spark" else "list_sort"
    return f"SELECT query, {d.join_array(f'{sort}({d.distinct(tokens)})')} AS tokens, substring({d.sha256(d.join_array(f'{sort}({d.distinct(tokens)})'))}, 1, 16) AS fingerprint FROM queries"


@operator("queries", "existing")
def similar_to_existing(d):
    """Whether a suggestion is like a keyword in use: equal, part of it, tokens inside each other, or two thirds in common."""
    a, b = d.distinct(_tokens(d, "q.query")), d.distinct(_tokens(d, "e.keyword"))
    return f"""
    WITH p AS (SELECT q.query, lower(trim(q.query)) AS x, lower(trim(e.keyword)) AS y, {a} AS a, {b} AS b FROM queries q CROSS JOIN existing e),
    s AS (SELECT query, x, y, {d.size("a")} AS na, {d.size("b")} AS nb, {_common(d, "a", "b")} AS common, {_union(d, "a", "b")} AS total FROM p)
    SELECT query, max(CASE WHEN contains(x, y) OR contains(y, x) THEN true WHEN na = 0 OR nb = 0 THEN false ELSE common = na OR common = nb OR CAST(common AS DOUBLE) / total >= {ALIKE} END) AS alike FROM s GROUP BY query"""


@operator("queries", "existing")
def covered(d):
    """Whether a keyword in use covers a term: one holds the other, or they share a word."""
    a, b = d.all("lower(q.query)", "[^ \\t\\n\\r\\f]+"), d.all("lower(e.keyword)", "[^ \\t\\n\\r\\f]+")
    return f"""
    WITH p AS (SELECT q.query, lower(trim(q.query)) AS x, lower(trim(e.keyword)) AS y, {_common(d, a, b)} AS common FROM queries q CROSS JOIN existing e)
    SELECT query, max(x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x) OR common > 0)) AS covered FROM p GROUP BY query"""


@operator("stats", "lifetime")
def stale(d):
    """Keywords that a window shows dead or weak and that their lifetime doesn't protect, worst first."""
    return f"""
    WITH c AS (
      SELECT s.keyword, s.per_run, CASE WHEN s.inserted = 0 AND s.fetched = 0 THEN 'dead' ELSE 'low yield' END AS reason FROM stats s LEFT JOIN lifetime l ON s.keyword = l.keyword
      WHERE s.runs >= {STALE_RUNS} AND s.inserted <= {STALE_INSERTED} AND s.per_run <= {STALE_YIELD} AND NOT coalesce(l.inserted >= 15 OR (l.runs >= 5 AND l.per_run >= 25e-2), false))
    SELECT keyword, reason, CAST(row_number() OVER (ORDER BY per_run, keyword) AS BIGINT) AS place FROM c"""


def rotation(current: DataFrame, removed: DataFrame, added: DataFrame, most: int) -> DataFrame:
    """Keywords after a rotation: what stays in its order, then what is added, ``most`` in all: (keyword, place)."""
    stays = current.join(removed.select("keyword"), "keyword", "left_anti").select("keyword", F.lit(0).alias("side"), "place")
    both = stays.unionByName(added.select("keyword", F.lit(1).alias("side"), "place"))
    return both.orderBy("side", "place", "keyword").limit(most).select("keyword", F.expr("CAST(row_number() OVER (ORDER BY side, place, keyword) AS BIGINT)").alias("place"))
