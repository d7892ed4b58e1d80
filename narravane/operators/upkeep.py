"""Keyword audits, ingest logs, upserts, cleanups, and state that follows from a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.functions.dialect import operator, rounded
from narravane.functions.places import numbered

DAY_US = 86_400_000_000


@operator("events")
def runs(d):
    """Ingest runs read off an event log: two keywords each, fetched and inserted counts, some skipped."""
    return f"""
    SELECT event_id AS run_id, concat('kw', CAST(user_id % 12 AS STRING)) AS keyword_1, concat('kw', CAST(event_id % 12 AS STRING)) AS keyword_2,
           CAST(floor(abs(value)) AS BIGINT) AS fetched, {d.div("CAST(floor(abs(value)) AS BIGINT)", "3")} AS inserted, event_id % 11 = 0 AS skipped, {d.micros("ts")} AS at_us FROM events"""


@operator("runs")
def keyword_stats(d):
    """Runs, fetched and inserted posts of each keyword; a run's counts are split by floor division."""
    return f"""
    WITH k AS (SELECT keyword_1 AS keyword, {d.div("fetched", "2")} AS fetched, {d.div("inserted", "2")} AS inserted, skipped FROM runs UNION ALL SELECT keyword_2, {d.div("fetched", "2")}, {d.div("inserted", "2")}, skipped FROM runs)
    SELECT keyword, count(*) AS runs, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(count_if(skipped) AS BIGINT) AS skipped, {rounded("CAST(sum(inserted) AS DOUBLE) / count(*)")} AS per_run FROM k GROUP BY keyword"""


@operator("stats")
def protected_keywords(d):
    """Keywords that stay: fifteen inserts, or five runs with a quarter insert each."""
    return "SELECT keyword, inserted >= 15 OR (runs >= 5 AND per_run >= 25e-2) AS protected FROM stats"


@operator("stats")
def explore_order(d):
    """Keywords to try next: the least run first, then the best yield."""
    return "SELECT keyword, CAST(row_number() OVER (ORDER BY runs, keyword) AS BIGINT) AS explore, CAST(row_number() OVER (ORDER BY per_run DESC, keyword) AS BIGINT) AS exploit FROM stats"


@operator("runs")
def recent_yield(d):
    """Runs, inserts and duplicate rate of the last 14 days of the log."""
    return f"""
    WITH l AS (SELECT max(at_us) AS as_of FROM runs), r AS (SELECT runs.* FROM runs CROSS JOIN l WHERE at_us >= as_of - 14 * {DAY_US})
    SELECT count(*) AS runs, CAST(sum(inserted) AS BIGINT) AS net_new, CAST(sum(fetched - inserted) AS BIGINT) AS seen_again, {rounded("CAST(sum(fetched - inserted) AS DOUBLE) / sum(fetched)")} AS duplicate_rate, max_by(run_id, at_us * 1000 + run_id % 1000) AS last_run FROM r"""


@operator("stats")
def round_robin(d):
    """Keywords by a cursor that goes round."""
    return "WITH o AS (SELECT keyword, row_number() OVER (ORDER BY keyword) - 1 AS i, count(*) OVER () AS n FROM stats) SELECT keyword, CAST((i + n - 5 % n) % n AS BIGINT) AS turn FROM o"


@operator("posts")
def sightings_by_day(d):
    """New authors and authors seen again by day, with a total."""
    return """
    WITH f AS (SELECT author_id, day, row_number() OVER (PARTITION BY author_id ORDER BY at_us, post_id) AS k FROM posts)
    SELECT coalesce(day, 'total') AS day, CAST(count_if(k = 1) AS BIGINT) AS net_new, CAST(count_if(k > 1) AS BIGINT) AS seen_again FROM f GROUP BY ROLLUP(day)"""


@operator("target", "batch")
def upsert_actions(d):
    """What an upsert does with each row of a batch: inserted, updated if the text differs, or duplicate."""
    return """
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY narrative, external_id ORDER BY at_us DESC, text) AS k FROM batch)
    SELECT b.narrative, b.external_id, CASE WHEN t.external_id IS NULL THEN 'inserted' WHEN t.text <> b.text THEN 'updated' ELSE 'duplicate' END AS action FROM b LEFT JOIN target t ON b.narrative = t.narrative AND b.external_id = t.external_id WHERE b.k = 1"""


@operator("target", "batch")
def upserted(d):
    """The table after the upsert: the batch's text wins, the first time stays, the last seen time moves."""
    return """
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY narrative, external_id ORDER BY at_us DESC, text) AS k FROM batch)
    SELECT coalesce(t.narrative, b.narrative) AS narrative, coalesce(t.external_id, b.external_id) AS external_id, coalesce(b.text, t.text) AS text, coalesce(t.at_us, b.at_us) AS at_us, greatest(coalesce(b.at_us, t.at_us), coalesce(t.at_us, b.at_us)) AS seen_us
    FROM target t FULL JOIN (SELECT * FROM b WHERE k = 1) b ON b.narrative = t.narrative AND b.external_id = t.external_id"""


@operator("orders", "customer")
def orphans(d):
    """Rows whose parent is missing."""
    return f"SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id FROM orders o {'LEFT ANTI' if d.name == 'spark' else 'ANTI'} JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o.o_custkey = c.c_custkey"


@operator("posts", "keep")
def pruned(d):
    """Posts of the narratives that are kept."""
    return f"SELECT p.narrative, count(*) AS posts FROM posts p {'LEFT SEMI' if d.name == 'spark' else 'SEMI'} JOIN keep k ON p.narrative = k.narrative GROUP BY p.narrative"


@operator("posts")
def last_of_day(d):
    """The last post of each day and narrative replaces the earlier ones."""
    return "WITH r AS (SELECT *, row_number() OVER (PARTITION BY narrative, day ORDER BY at_us DESC, post_id DESC) AS k FROM posts) SELECT narrative, day, post_id, score_u FROM r WHERE k = 1"


@operator("posts")
def tier_crossings(d):
    """Upward moves between watch levels of a narrative's daily largest score."""
    return """
    WITH m AS (SELECT narrative, day, max(score_u) AS top FROM posts GROUP BY narrative, day),
    t AS (SELECT narrative, day, CASE WHEN top >= 650000 THEN 3 WHEN top >= 550000 THEN 2 WHEN top >= 380000 THEN 1 ELSE 0 END AS level FROM m),
    l AS (SELECT *, lag(level) OVER (PARTITION BY narrative ORDER BY day) AS before FROM t)
    SELECT narrative, day, before, level FROM l WHERE level > coalesce(before, 0)"""


@operator("posts")
def daily_budget(d):
    """Requests in order within a day, and whether they are within the cap of 45."""
    return "WITH r AS (SELECT post_id, day, row_number() OVER (PARTITION BY day ORDER BY at_us, post_id) AS used FROM posts) SELECT post_id, day, CAST(used AS BIGINT) AS used, used <= 45 AS allowed FROM r"


@operator("posts")
def bounded_history(d):
    """The last hundred entries of each narrative."""
    return "WITH r AS (SELECT narrative, post_id, row_number() OVER (PARTITION BY narrative ORDER BY at_us DESC, post_id DESC) AS k FROM posts) SELECT narrative, post_id, CAST(k AS BIGINT) AS k FROM r WHERE k <= 100"


@operator("posts")
def newest_then_filtered(d):
    """The newest hundred posts first, then those of a high score among them."""
    return "WITH n AS (SELECT * FROM posts ORDER BY at_us DESC, post_id DESC LIMIT 100) SELECT post_id, narrative, score_u FROM n WHERE score_u >= 320000"


@operator("posts")
def newest_cohort(d):
    """The newest 250 posts."""
    return "SELECT post_id, narrative, at_us FROM posts ORDER BY at_us DESC, post_id DESC LIMIT 250"


@operator("ours", "theirs")
def merged_logs(d):
    """Their lines in order, then ours that they lack, each once."""
    return """
    WITH u AS (SELECT line, 0 AS side, pos FROM theirs UNION ALL SELECT line, 1, pos FROM ours), r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY side, pos) AS k FROM u)
    SELECT line, CAST(row_number() OVER (ORDER BY side, pos) AS BIGINT) AS place FROM r WHERE k = 1"""


@operator("posts", "scored")
def stale_narratives(d):
    """Posts without a current score by narrative."""
    return "SELECT p.narrative, count(*) AS posts, CAST(count_if(s.post_id IS NULL) AS BIGINT) AS unscored FROM posts p LEFT JOIN scored s ON p.post_id = s.post_id GROUP BY p.narrative"


def merge_logs(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(line, place): what ``merged_logs`` gives, numbered by ranges."""
    both = theirs.select("line", F.lit(0).alias("side"), "pos").unionByName(ours.select("line", F.lit(1).alias("side"), "pos"))
    first = both.groupBy("line").agg(F.min(F.struct("side", "pos")).alias("at")).select("line", "at.side", "at.pos")
    return numbered(first, ["side", "pos", "line"]).select("line", "place")
