"""Labels of themes: phrases that tell a theme from all others, ranked without repeating a word, and claimed by the strongest theme."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.functions.dialect import operator, rounded
from narravane.functions.scratch import written
from narravane.operators.labels import KNOWN_PHRASES

# Labels of a theme, least quality of a phrase label and of any, least information, labels below which a theme takes more, and the scale of distinctiveness.
LABELS, PHRASES, PHRASE_QUALITY, LEAST_QUALITY, LEAST_PMI, ENOUGH, SCALE = 6, 3, "55e-2", "25e-2", "65e-2", 2, 6


@operator("topics", "known")
def contrast_scores(d):
    """Information of the two and three word phrases of a theme against all other themes, times the log of their count.

    ``topics`` has (narrative, tokens), a narrative being a theme; ``known`` (narrative, phrase, n) counts phrases that
    name a frame, beside their places among the tokens.  A single theme is its own contrast.
    """
    if d.name == "spark":  # one pass over the tokens
        gram = lambda n: f"IF(size(tokens) < {n}, CAST(array() AS ARRAY<STRING>), transform(sequence(0, size(tokens) - {n}), i -> concat_ws(' ', tokens[i], " + ", ".join(f"tokens[i + {k}]" for k in range(1, n)) + ")))"
        grams = f"SELECT narrative, phrase, count(*) AS n FROM (SELECT narrative, phrase FROM topics LATERAL VIEW explode(concat({gram(2)}, {gram(3)})) p AS phrase) x GROUP BY narrative, phrase"
    else:
        grams = f"SELECT narrative, phrase, count(*) AS n FROM (SELECT narrative, phrase FROM topics {d.unnest(d.grams('tokens', 2), 'phrase')} UNION ALL SELECT narrative, phrase FROM topics {d.unnest(d.grams('tokens', 3), 'phrase')}) x GROUP BY narrative, phrase"
    known = ", ".join(f"'{p}'" for p in KNOWN_PHRASES)
    return f"""
    WITH g AS ({grams}), c AS (SELECT narrative, phrase, CAST(sum(n) AS BIGINT) AS n FROM (SELECT narrative, phrase, n FROM g UNION ALL SELECT narrative, phrase, n FROM known) u GROUP BY narrative, phrase),
    o AS (SELECT narrative, CAST(sum({d.size("tokens")}) AS BIGINT) AS own FROM topics GROUP BY narrative), w AS (SELECT CAST(sum(own) AS BIGINT) AS whole, count(*) AS themes FROM o), e AS (SELECT phrase, CAST(sum(n) AS BIGINT) AS everywhere FROM c GROUP BY phrase),
    p AS (SELECT c.narrative, c.phrase, c.n, log2((CAST(c.n AS DOUBLE) / greatest(o.own, 1) + 1e-9) / ((CASE WHEN w.themes = 1 THEN e.everywhere ELSE e.everywhere - c.n END + 5e-1) / (greatest(CASE WHEN w.themes = 1 THEN w.whole ELSE w.whole - o.own END, 1) + 1e0) + 1e-9)) AS pmi
          FROM c JOIN o ON c.narrative = o.narrative JOIN e ON c.phrase = e.phrase CROSS JOIN w)
    SELECT narrative, phrase, n, {rounded("pmi * ln(1 + n)", 6)} AS weight FROM p WHERE pmi >= {LEAST_PMI} OR phrase IN ({known})"""


def ranked_labels(scores: DataFrame) -> DataFrame:
    """(narrative, phrase, quality, score, place, kind) of the labels of each theme: the best phrases of which no two share a word.

    ``scores`` has (narrative, phrase, quality, score), those without a positive score don't count.  ``kind`` is ``term``
    for the first six and ``phrase`` for those behind them that are good phrases, until there are three of these.
    Equal scores go by the phrase.  In a round every theme takes its best phrase and drops what shares a word with it.
    """
    left = written(scores.where("score > 0").select("narrative", "phrase", "quality", "score", F.split("phrase", " ").alias("words")))
    taken, place = None, 0
    while True:
        best = left.groupBy("narrative").agg(F.min(F.struct((-F.col("score")).alias("low"), "phrase", "quality", "score", "words")).alias("b"))
        best = written(best.select("narrative", "b.phrase", "b.quality", "b.score", F.col("b.words").alias("taken"), F.lit(place).alias("place")))
        if best.isEmpty():
            break
        taken = best if taken is None else written(taken.unionByName(best))
        place += 1
        full = taken.groupBy("narrative").agg(F.count(F.lit(1)).alias("k"), F.count_if(_good(F.col("phrase"), F.col("quality"))).alias("good"))
        open_ = best.join(full.where(f"k < {LABELS} OR good < {PHRASES}").select("narrative"), "narrative").select("narrative", "taken")
        left = written(left.join(open_, "narrative").where(~F.arrays_overlap("words", "taken")).drop("taken"))
    if taken is None:
        return scores.limit(0).selectExpr("narrative", "phrase", "quality", "score", "CAST(NULL AS INT) AS place", "CAST(NULL AS STRING) AS kind")
    kind = F.when(F.col("place") < LABELS, "term").when(_good(F.col("phrase"), F.col("quality")), "phrase")
    return taken.withColumn("kind", kind).where("kind IS NOT NULL").drop("taken")


def _good(phrase, quality):
    return phrase.contains(" ") & (quality >= F.expr(PHRASE_QUALITY))


def exclusive_labels(scores: DataFrame) -> DataFrame:
    """(narrative, label, place, kind) after stronger themes claimed theirs first: no word is a label of two themes.

    A theme is as strong as the weight of its best label.  It takes those of its ranked labels of which no stronger
    theme has claimed a word.  One that is left with fewer than two takes further phrases in their order, whose words
    may be claimed but not the whole phrase, up to six; one without any takes its best six.  Equal themes go by name.

    Themes are decided in rounds.  A theme can be decided if none before it that is still open has a word of its labels,
    and none before it might take further phrases; the strongest open theme always can.
    ``scores`` has (narrative, phrase, weight, quality, score).
    """
    spark = scores.sparkSession
    usable = written(scores.where(F.col("quality") >= F.expr(LEAST_QUALITY)))
    ranked = written(ranked_labels(usable.select("narrative", "phrase", "quality", "score")))
    first = usable.where("score > 0").groupBy("narrative").agg(F.min(F.struct((-F.col("score")).alias("low"), "phrase", "weight")).alias("b"))
    open_ = written(first.select("narrative", F.struct((-F.col("b.weight")).alias("weak"), F.col("narrative").alias("name")).alias("ord")))
    words = written(ranked.select("narrative", "phrase", "kind", "place", F.explode(F.split("phrase", " ")).alias("word")))
    claimed = spark.createDataFrame([], "phrase string, word string")
    out = None
    while not open_.isEmpty():
        mine = words.join(open_, "narrative")
        gone = mine.join(claimed.select("word").distinct(), "word", "left_semi").select("narrative", "phrase").distinct()
        free = mine.join(gone, ["narrative", "phrase"], "left_anti")
        holder = free.groupBy("word").agg(F.min("ord").alias("holder"))
        seen = free.join(holder, "word").groupBy("narrative", "ord", "phrase", "kind", "place").agg(F.max(F.col("holder") < F.col("ord")).alias("held"))
        state = open_.join(seen.groupBy("narrative").agg(F.max("held").alias("held"), F.count_if((F.col("kind") == "term") & ~F.col("held")).alias("sure")), "narrative", "left")
        state = written(state.select("narrative", "ord", F.coalesce("held", F.lit(False)).alias("held"), (F.coalesce("sure", F.lit(0)) < ENOUGH).alias("short")))
        limit = state.where("short").agg(F.min("ord").alias("limit"))  # one row
        decided = written(state.where("NOT held").crossJoin(F.broadcast(limit)).where("limit IS NULL OR ord <= limit").drop("limit"))
        labels = written(seen.join(decided.select("narrative", "short"), "narrative").select("narrative", F.col("phrase").alias("label"), "place", "kind", "short"))
        short = decided.where("short").select("narrative")
        if not short.isEmpty():
            labels = written(labels.drop("short").unionByName(_further(usable.join(short, "narrative"), labels.where("kind = 'term'"), claimed)))
        labels = labels.select("narrative", "label", F.col("place").cast("int").alias("place"), "kind")
        out = labels if out is None else written(out.unionByName(labels))
        claimed = written(claimed.unionByName(labels.select(F.col("label").alias("phrase"), F.explode(F.split("label", " ")).alias("word"))))
        open_ = written(open_.join(decided.select("narrative"), "narrative", "left_anti"))
    return out if out is not None else spark.createDataFrame([], f"narrative {scores.schema['narrative'].dataType.simpleString()}, label string, place int, kind string")


def _further(phrases: DataFrame, own: DataFrame, claimed: DataFrame) -> DataFrame:
    """Further labels of a theme with too few: unclaimed phrases in their order, or its best ones if there are none."""
    order = "PARTITION BY narrative ORDER BY score DESC, phrase"
    held = own.groupBy("narrative").agg(F.count(F.lit(1)).alias("k"))
    rest = phrases.join(own.select("narrative", F.col("label").alias("phrase")), ["narrative", "phrase"], "left_anti").join(claimed.select("phrase").distinct(), "phrase", "left_anti")
    rest = rest.selectExpr("narrative", "phrase", f"row_number() OVER ({order}) AS r").join(held, "narrative", "left").where(f"r <= {LABELS} - coalesce(k, 0)")
    more = rest.select("narrative", F.col("phrase").alias("label"), (F.lit(100) + F.col("r")).alias("place"), F.lit("more").alias("kind"))
    has = own.select("narrative").unionByName(more.select("narrative")).distinct()
    best = phrases.join(has, "narrative", "left_anti").selectExpr("narrative", "phrase AS label", f"100 + row_number() OVER ({order}) AS place", "'more' AS kind").where(f"place <= {100 + LABELS}")
    return more.unionByName(best)


def label_facts(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """(narrative, labels, distinctive): the labels in their order, and how telling the three best phrases are."""
    top = scores.where("score > 0").selectExpr("narrative", "score", "row_number() OVER (PARTITION BY narrative ORDER BY score DESC, phrase) AS k").where("k <= 3")
    telling = top.groupBy("narrative").agg(F.expr(rounded(f"least(1e0, avg(score) / {SCALE})")).alias("distinctive"))
    named = labels.where("kind <> 'phrase'").groupBy("narrative").agg(F.expr(f"slice(transform(array_sort(collect_list(struct(place, label))), x -> x.label), 1, {LABELS})").alias("labels"))
    return named.join(telling, "narrative", "left")
