"""How themes change between two snapshots: one-to-one matches, and what was merged, split, lost, found or renamed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.functions.dialect import operator, rounded
from narravane.functions.scratch import written

# Least overlap of a match, of labels that are the same, distinctiveness of a new theme, and a drop of it.
OVERLAP, SAME_LABELS, NEW_LEAST, DROP = "35e-2", "35e-2", "12e-2", "15e-2"


@operator("olds", "news")
def overlaps(d):
    """Pairs of an old and a new theme of a narrative whose posts overlap by 0.35 or more (Jaccard); ``olds`` and ``news`` have (narrative, theme, post_id)."""
    return f"""
    WITH o AS (SELECT DISTINCT narrative, theme, post_id FROM olds), n AS (SELECT DISTINCT narrative, theme, post_id FROM news),
    x AS (SELECT narrative, theme, count(*) AS k FROM o GROUP BY narrative, theme), y AS (SELECT narrative, theme, count(*) AS k FROM n GROUP BY narrative, theme),
    s AS (SELECT o.narrative, o.theme AS before, n.theme AS after, count(*) AS shared FROM o JOIN n ON o.narrative = n.narrative AND o.post_id = n.post_id GROUP BY o.narrative, o.theme, n.theme),
    j AS (SELECT s.narrative, s.before, s.after, CAST(s.shared AS DOUBLE) / (x.k + y.k - s.shared) AS jaccard FROM s JOIN x ON s.narrative = x.narrative AND s.before = x.theme JOIN y ON s.narrative = y.narrative AND s.after = y.theme)
    SELECT narrative, before, after, {rounded("jaccard", 6)} AS jaccard FROM j WHERE jaccard >= {OVERLAP}"""


def matches(overlap: DataFrame) -> DataFrame:
    """One-to-one matches (narrative, before, after, jaccard): old themes choose in their order, each the new one left that it overlaps most.

    Equal overlaps go to the smaller new theme.  In a round every old theme asks for the best new one that hasn't
    refused it, and a new theme refuses all but the first old one that ever asked.  Since all new themes rank the old
    ones alike, the only stable outcome is the one of choosing in order.
    """
    left = written(overlap.select("narrative", "before", "after", "jaccard"))
    while True:
        asked = left.groupBy("narrative", "before").agg(F.min(F.struct((-F.col("jaccard")).alias("far"), "after")).alias("best")).select("narrative", "before", F.col("best.after").alias("after"))
        taken = asked.groupBy("narrative", "after").agg(F.min("before").alias("first"))
        refused = written(asked.join(taken, ["narrative", "after"]).where("before <> first").select("narrative", "before", "after"))
        if refused.isEmpty():
            return asked.join(left, ["narrative", "before", "after"]).select("narrative", "before", "after", "jaccard")
        left = written(left.join(refused, ["narrative", "before", "after"], "left_anti"))


#: DuckDB text for ``matches`` over ``overlap``: one old theme after the other.
MATCHES_SQL = """
WITH RECURSIVE o AS (SELECT narrative, before, dense_rank() OVER (PARTITION BY narrative ORDER BY before) AS k FROM (SELECT DISTINCT narrative, before FROM overlap) x),
r(narrative, k, used, before, after) AS (
  SELECT DISTINCT narrative, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM overlap
  UNION ALL
  SELECT narrative, k, CASE WHEN choice IS NULL THEN used ELSE list_append(used, choice) END, old, choice
  FROM (SELECT r.narrative, r.k + 1 AS k, r.used, o.before AS old, (SELECT p.after FROM overlap p WHERE p.narrative = r.narrative AND p.before = o.before AND NOT list_contains(r.used, p.after) ORDER BY p.jaccard DESC, p.after LIMIT 1) AS choice
        FROM r JOIN o ON o.narrative = r.narrative AND o.k = r.k + 1) s)
SELECT p.narrative, p.before, p.after, p.jaccard FROM r JOIN overlap p ON p.narrative = r.narrative AND p.before = r.before AND p.after = r.after"""


@operator("old_facts", "new_facts", "overlap", "matched")
def drift_report(d):
    """What happened to each theme: (narrative, kind, theme, other, value), where ``other`` is a theme of the other snapshot.

    ``split``: an old theme overlaps several new ones; ``merged``: a new one overlaps several old ones; ``vanished`` and
    ``emerged``: without a match, the latter only if it is distinctive; ``label_drift``: a match whose first labels
    differ and whose labels hardly overlap; ``distinctiveness_drop``: a match that is less distinctive than before.
    Facts have (narrative, theme, labels, distinctive), labels being an array in order.
    """
    size = lambda x: f"CAST(size({x}) AS BIGINT)" if d.name == "spark" else f"CAST(len({x}) AS BIGINT)"
    both, either = ("array_intersect(o.labels, n.labels)", "array_union(o.labels, n.labels)") if d.name == "spark" else ("list_intersect(o.labels, n.labels)", "list_distinct(list_concat(o.labels, n.labels))")
    first = (lambda x: f"get({x}, 0)") if d.name == "spark" else (lambda x: f"{x}[1]")
    return f"""
    WITH p AS (SELECT m.narrative, m.before, m.after, {size(both)} AS common, {size(either)} AS total, {first("o.labels")} AS was, {first("n.labels")} AS now, o.distinctive - n.distinctive AS fall
               FROM matched m JOIN old_facts o ON o.narrative = m.narrative AND o.theme = m.before JOIN new_facts n ON n.narrative = m.narrative AND n.theme = m.after)
    SELECT narrative, 'split' AS kind, before AS theme, CAST(NULL AS BIGINT) AS other, CAST(count(*) AS DOUBLE) AS value FROM overlap GROUP BY narrative, before HAVING count(*) > 1
    UNION ALL SELECT narrative, 'merged', after, CAST(NULL AS BIGINT), CAST(count(*) AS DOUBLE) FROM overlap GROUP BY narrative, after HAVING count(*) > 1
    UNION ALL SELECT o.narrative, 'vanished', o.theme, CAST(NULL AS BIGINT), o.distinctive FROM old_facts o LEFT JOIN matched m ON m.narrative = o.narrative AND m.before = o.theme WHERE m.before IS NULL
    UNION ALL SELECT n.narrative, 'emerged', n.theme, CAST(NULL AS BIGINT), n.distinctive FROM new_facts n LEFT JOIN matched m ON m.narrative = n.narrative AND m.after = n.theme WHERE m.after IS NULL AND n.distinctive >= {NEW_LEAST}
    UNION ALL SELECT narrative, 'label_drift', before, after, {rounded("CASE WHEN total = 0 OR common = 0 THEN 0e0 ELSE CAST(common AS DOUBLE) / total END")} FROM p WHERE coalesce(was, '') <> coalesce(now, '') AND (common = 0 OR CAST(common AS DOUBLE) / total < {SAME_LABELS})
    UNION ALL SELECT narrative, 'distinctiveness_drop', before, after, {rounded("fall")} FROM p WHERE floor(fall * 1e4 + 5e-1) / 1e4 >= {DROP}"""
