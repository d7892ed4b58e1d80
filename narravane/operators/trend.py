"""Daily sentiment: buckets, smoothing, robust trends, divergence, week over week.

Scores arrive in millionths, so that sums are exact whatever the order.
"""

from __future__ import annotations

from narravane.functions.dialect import operator, rounded

#: Least R2 and slope of a trend; divergence factors; week-over-week alerts.
R2_LEAST, SLOPE_LEAST = "35e-2", "8e-3"
DIVERGENCE_POSTS, DIVERGENCE_FACTOR, DIVERGENCE_MEAN = 5, "15e-1", "1e-1"
WEEK_MEAN_RISE, WEEK_VOLUME_RISE, WEEK_POSTS = "6e-2", "4e-1", 3
#: Scores at and above these are high conflict and escalating.
HIGH, ESCALATING = 550_000, 320_000


@operator("posts")
def daily_buckets(d):
    """Count, mean score and tier counts of each narrative and day."""
    return f"""
    SELECT narrative, day, count(*) AS n, {rounded("CAST(sum(score_u) AS DOUBLE) / count(*) / 1e6")} AS mean_score,
           CAST(count_if(score_u >= {HIGH}) AS BIGINT) AS high_conflict,
           CAST(count_if(score_u >= {ESCALATING} AND score_u < {HIGH}) AS BIGINT) AS escalating,
           CAST(count_if(score_u < {ESCALATING}) AS BIGINT) AS neutral
    FROM posts GROUP BY narrative, day"""


@operator("buckets")
def tier_share(d):
    """Share of each tier in a day, in percent."""
    return f"SELECT narrative, day, {rounded('1e2 * high_conflict / n', 2)} AS high_pct, {rounded('1e2 * escalating / n', 2)} AS escalating_pct, {rounded('1e2 * neutral / n', 2)} AS neutral_pct FROM buckets"


@operator("buckets")
def rolling_mean(d):
    """Centred mean of three buckets; an edge repeats its own value, and a series under three stays as it is."""
    return f"""
    WITH i AS (
      SELECT narrative, day, mean_score, n, CAST(row_number() OVER s - 1 AS BIGINT) AS idx, count(*) OVER (PARTITION BY narrative) AS nb,
             coalesce(lag(mean_score) OVER s, mean_score) AS a, coalesce(lead(mean_score) OVER s, mean_score) AS b
      FROM buckets WINDOW s AS (PARTITION BY narrative ORDER BY day))
    SELECT narrative, day, n, mean_score, idx, nb, CASE WHEN nb < 3 THEN mean_score ELSE (a + mean_score + b) / 3e0 END AS smooth FROM i"""


@operator("series")
def theil_sen(d):
    """Median of pairwise slopes, with and without the largest and smallest bucket, and R2 of the line."""
    return f"""
    WITH marked AS (
      SELECT *, row_number() OVER (PARTITION BY narrative ORDER BY smooth DESC, idx) AS top, row_number() OVER (PARTITION BY narrative ORDER BY smooth, idx) AS low FROM series),
    trimmed AS (SELECT * FROM marked WHERE nb < 4 OR (top > 1 AND low > 1)),
    slopes AS (SELECT a.narrative, median((b.smooth - a.smooth) / (b.idx - a.idx)) AS slope FROM series a JOIN series b ON a.narrative = b.narrative AND a.idx < b.idx GROUP BY a.narrative),
    cut AS (SELECT a.narrative, median((b.smooth - a.smooth) / (b.idx - a.idx)) AS slope FROM trimmed a JOIN trimmed b ON a.narrative = b.narrative AND a.idx < b.idx GROUP BY a.narrative),
    kept AS (SELECT narrative, count(*) AS k FROM trimmed GROUP BY narrative),
    line AS (SELECT s.narrative, median(s.smooth - coalesce(t.slope, 0e0) * s.idx) AS base FROM series s LEFT JOIN slopes t ON s.narrative = t.narrative GROUP BY s.narrative),
    mid AS (SELECT narrative, avg(smooth) AS m FROM series GROUP BY narrative),
    fit AS (
      SELECT s.narrative, max(s.nb) AS buckets, sum((s.smooth - l.base - coalesce(t.slope, 0e0) * s.idx) * (s.smooth - l.base - coalesce(t.slope, 0e0) * s.idx)) AS res, sum((s.smooth - m.m) * (s.smooth - m.m)) AS tot
      FROM series s JOIN line l ON s.narrative = l.narrative JOIN mid m ON s.narrative = m.narrative LEFT JOIN slopes t ON s.narrative = t.narrative GROUP BY s.narrative)
    SELECT f.narrative, f.buckets, {rounded("coalesce(t.slope, 0e0)", 6)} AS slope,
           {rounded("CASE WHEN k.k < 3 THEN 0e0 ELSE coalesce(c.slope, 0e0) END", 6)} AS trimmed_slope,
           {rounded("CASE WHEN f.tot <= 1e-12 THEN 0e0 ELSE 1e0 - f.res / f.tot END")} AS r2
    FROM fit f LEFT JOIN slopes t ON f.narrative = t.narrative LEFT JOIN cut c ON f.narrative = c.narrative LEFT JOIN kept k ON f.narrative = k.narrative"""


@operator("lines")
def trend_class(d):
    """Escalating, declining, stable or too short a series."""
    return f"""
    SELECT narrative, buckets, slope, trimmed_slope, r2,
           CASE WHEN buckets < 3 THEN 'insufficient_data' WHEN r2 >= {R2_LEAST} AND slope >= {SLOPE_LEAST} AND trimmed_slope >= {SLOPE_LEAST} THEN 'escalating'
                WHEN r2 >= {R2_LEAST} AND slope <= -{SLOPE_LEAST} AND trimmed_slope <= -{SLOPE_LEAST} THEN 'declining' ELSE 'stable' END AS trend
    FROM lines"""


@operator("buckets")
def divergence_days(d):
    """Days of high volume and low score."""
    return f"""
    WITH m AS (SELECT narrative, median(n) AS mid FROM buckets GROUP BY narrative)
    SELECT b.narrative, b.day, b.n, b.mean_score FROM buckets b JOIN m ON b.narrative = m.narrative
    WHERE b.n >= greatest({DIVERGENCE_POSTS}e0, {DIVERGENCE_FACTOR} * m.mid) AND b.mean_score < {DIVERGENCE_MEAN}"""


@operator("buckets")
def peak_days(d):
    """The busiest day of a narrative, and whether it is a spike of mild posts."""
    return f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY narrative ORDER BY n DESC, day) AS k FROM buckets), m AS (SELECT narrative, median(n) AS mid FROM buckets GROUP BY narrative)
    SELECT r.narrative, r.day, r.n, r.mean_score, r.n >= greatest({DIVERGENCE_POSTS}e0, {DIVERGENCE_FACTOR} * m.mid) AND r.mean_score < {DIVERGENCE_MEAN} AS divergent FROM r JOIN m ON r.narrative = m.narrative WHERE r.k = 1"""


@operator("buckets")
def week_over_week(d):
    """The last seven buckets against the seven before, weighted by posts; an alert on a rise."""
    return f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY narrative ORDER BY day DESC) AS k FROM buckets),
    w AS (
      SELECT narrative, count(*) AS buckets, CAST(sum(CASE WHEN k <= 7 THEN n ELSE 0 END) AS BIGINT) AS recent_n, CAST(sum(CASE WHEN k BETWEEN 8 AND 14 THEN n ELSE 0 END) AS BIGINT) AS before_n,
             CAST(sum(CASE WHEN k <= 7 THEN n * CAST(floor(mean_score * 1e4 + 5e-1) AS BIGINT) ELSE 0 END) AS BIGINT) AS recent_s, CAST(sum(CASE WHEN k BETWEEN 8 AND 14 THEN n * CAST(floor(mean_score * 1e4 + 5e-1) AS BIGINT) ELSE 0 END) AS BIGINT) AS before_s
      FROM r GROUP BY narrative),
    m AS (SELECT *, CAST(recent_s AS DOUBLE) / recent_n / 1e4 AS recent_mean, CAST(before_s AS DOUBLE) / before_n / 1e4 AS before_mean FROM w WHERE buckets >= 14 AND recent_n >= {WEEK_POSTS} AND before_n >= {WEEK_POSTS})
    SELECT narrative, recent_n, before_n, {rounded("recent_mean")} AS recent_mean, {rounded("before_mean")} AS before_mean,
           CASE WHEN recent_mean - before_mean >= {WEEK_MEAN_RISE} THEN 'rising_score' WHEN CAST(recent_n AS DOUBLE) / before_n - 1 >= {WEEK_VOLUME_RISE} AND recent_mean < {DIVERGENCE_MEAN} THEN 'volume_surge' ELSE 'none' END AS alert
    FROM m"""


@operator("posts")
def iso_weeks(d):
    """Posts by ISO week."""
    year, week = d.weekday_year("CAST(day AS DATE)")
    return f"SELECT narrative, {year} AS iso_year, {week} AS iso_week, count(*) AS n FROM posts GROUP BY 1, 2, 3"


@operator("posts")
def score_histogram(d):
    """Five equal bins of the score; the last one is closed."""
    return f"SELECT narrative, least({d.div('score_u', '200000')}, 4) AS bin, count(*) AS n FROM posts GROUP BY 1, 2"


@operator("posts")
def nearest_rank(d):
    """Nearest-rank percentiles and the median of the score."""
    return f"""
    WITH r AS (SELECT narrative, score_u, row_number() OVER (PARTITION BY narrative ORDER BY score_u, post_id) - 1 AS k, count(*) OVER (PARTITION BY narrative) AS n FROM posts)
    SELECT narrative, max(CASE WHEN k = CAST(floor(n * 75e-2) AS BIGINT) THEN score_u END) AS p75, max(CASE WHEN k = CAST(floor(n * 9e-1) AS BIGINT) THEN score_u END) AS p90, {rounded("median(score_u)", 1)} AS median FROM r GROUP BY narrative"""


@operator("posts")
def score_stats(d):
    """Count, largest and mean score; compressed if no score is above 0.15."""
    return f"SELECT narrative, count(*) AS n, max(score_u) AS largest_u, {rounded('CAST(sum(score_u) AS DOUBLE) / count(*) / 1e6')} AS mean_score, max(score_u) <= 150000 AS compressed FROM posts GROUP BY narrative"


def daily_trend(posts):
    """Trend class of each narrative from its posts."""
    return trend_class(theil_sen(rolling_mean(daily_buckets(posts))))
