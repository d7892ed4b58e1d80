"""Small cases with known results, and properties."""

import random

import pytest
from narravane.functions.dialect import SPARK
from narravane.operators import actors, analyst, bursts, coordination, graph, labels, scoring, similarity, sinks, trend
from narravane.operators.components import components


def posts(spark, rows):
    fields = "post_id long, narrative string, author_id string, platform string, at_us long, day string, score_u long, text string"
    return spark.createDataFrame([(i, n, a, "x", at, d, s, t) for i, (n, a, at, d, s, t) in enumerate(rows)], fields)


def series(spark, means):
    rows = [("n", f"2024-01-{i + 1:02d}", 10, m, 0, 0, 10) for i, m in enumerate(means)]
    return spark.createDataFrame(rows, "narrative string, day string, n long, mean_score double, high_conflict long, escalating long, neutral long")


@pytest.mark.parametrize(("means", "want"), [([0.1 + 0.03 * i for i in range(10)], "escalating"), ([0.5 - 0.03 * i for i in range(10)], "declining"), ([0.2, 0.21, 0.2, 0.21, 0.2, 0.21], "stable"), ([0.1, 0.9], "insufficient_data")])
def test_trend_classes(spark, means, want):
    (row,) = trend.trend_class(trend.theil_sen(trend.rolling_mean(series(spark, means)))).collect()
    assert row.trend == want


def test_slope_changes_sign_with_the_series(spark):
    rng = random.Random(1)
    means = [round(rng.random(), 3) for _ in range(12)]
    (up,), (down,) = (trend.theil_sen(trend.rolling_mean(series(spark, m))).collect() for m in (means, [1 - x for x in means]))
    assert up.slope == pytest.approx(-down.slope, abs=2e-6) and up.r2 == pytest.approx(down.r2, abs=2e-4)


def test_bursts_have_inclusive_bounds(spark):
    near = [("a", f"u{i}", i * 22_500_000, "d", 0, "t") for i in range(5)]
    far = [("b", f"u{i}", i * 3_600_000_000, "d", 0, "t") for i in range(5)]
    got = {r.narrative: (r.most_authors, r.burst) for r in bursts.bursts(posts(spark, near + far)).collect()}
    assert got == {"a": (5, True), "b": (1, False)}


def test_exact_copies_by_normal_text(spark):
    rows = [("n", "u1", 0, "d", 0, "Same  TEXT here"), ("n", "u2", 5_000_000, "d", 0, "same text\nhere "), ("n", "u1", 9_000_000, "d", 0, "other"), ("n", "u1", 0, "d", 0, " "), ("n", "u2", 0, "d", 0, "")]
    (c,) = bursts.exact_copies(bursts.normalized(posts(spark, rows))).collect()
    assert (c.first_post, c.posts, c.authors, c.author_ids, c.span_s, c.gap_s) == (0, 2, 2, "u1,u2", 5.0, 5.0)


def scored(spark, *texts):
    rows = posts(spark, [("n", "u", 0, "d", 0, t) for t in texts])
    return scoring.outrage_scores(scoring.lexicon_hits(rows)).orderBy("post_id").collect()


def test_scores_order_tiers_and_polarity(spark):
    calm, angry, fond, empty, threat = scored(spark, "a quiet day at the lake", "they are vermin and scum, exterminate the traitors, burn it down!!", "i love you all, thank you", "", "bring guns tonight")
    assert calm.outrage_index < 0.05 and calm.tier == "neutral" and calm.polarity == "neutral"
    # 0.18 * 0.5525 + 0.2 * 1 + 0.2 * 0.49 + 0.08 * 0.24 + 0.12 * 0.4, by hand
    assert angry.outrage_index == pytest.approx(0.4646, abs=1e-4) and angry.tier == "escalating" and angry.polarity == "negative"
    assert fond.polarity == "positive" and empty.outrage_index == 0 and empty.tier == "neutral" and threat.tier == "escalating"


def test_market_chatter_and_prefilter(spark):
    texts = ["$SPY $QQQ calls puts btc/eth spx +1.4%", "the election is near and voters worry about the border", "follow me for a giveaway of many things today", "hi", "спасибо большое за всё это сегодня"]
    rows = posts(spark, [("n", "u", 0, "d", 0, t) for t in texts])
    markets = scoring.market_scores(rows)
    assert [r.market for r in markets.orderBy("post_id").collect()] == [True, False, False, False, False]
    assert [r.reason for r in scoring.prefilter(rows, markets).orderBy("post_id").collect()] == ["market", "narrative", "promo", "short", "non_english"]


def test_groups_equal_all_pairs(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.sample(base, 20) if rng.random() < 0.5 else base[:20] + [rng.choice(base)]) for _ in range(60)] + ["a b c"] * 3 + ["x y z"] * 2
    authors = [f"u{i % 4}" for i in range(63)] + ["u9", "u9"]
    sets = similarity.token_sets(bursts.normalized(posts(spark, [("n", a, i, "d", 0, t) for i, (a, t) in enumerate(zip(authors, texts, strict=True))])))
    pairs = similarity.similar_pairs(sets, 75)
    tokens = [frozenset(t[:280].split()) for t in texts]
    alike = {(i, j) for i in range(65) for j in range(i + 1, 65) if 100 * len(tokens[i] & tokens[j]) >= 75 * len(tokens[i] | tokens[j])}
    first = {t: tokens.index(t) for t in tokens}
    assert {(r.a, r.b) for r in pairs.collect()} == {tuple(sorted((first[tokens[i]], first[tokens[j]]))) for i, j in alike if tokens[i] != tokens[j]}
    for same, links in ((True, similarity.links_within_authors(sets, pairs)), (False, similarity.links_across_authors(sets, pairs))):
        root = list(range(65))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        linked = set()
        for i, j in alike:
            if (authors[i] == authors[j]) == same:
                linked |= {i, j}
                x, y = sorted((find(i), find(j)))
                root[y] = x
        got = {r.post_id: r.group_id for r in similarity.groups_of(sets, links, same).collect()}
        assert got == {i: find(i) for i in linked} and len(got) > 10


def test_components_partition_the_nodes(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


def test_graph_of_one_hub(spark):
    edges = spark.createDataFrame([(i, "n", "hub", f"leaf{i}", "share", 0) for i in range(5)], "edge_id long, narrative string, source string, target string, kind string, at_us long")
    (shape,) = graph.density_and_hub(edges).collect()
    assert (shape.nodes, shape.edges, shape.hub_ratio) == (6, 5, 1.0)
    assert graph.topology(edges).first()["shape"] == "star" and graph.top_amplifiers(graph.degrees(edges)).first()["author_id"] == "hub"


def test_actors_need_two_narratives(spark):
    rows = posts(spark, [("a", "u1", 0, "d", 5, ""), ("b", "u1", 86_400_000_000, "d", 9, ""), ("a", "u2", 0, "d", 1, ""), ("a", "u2", 1, "d", 1, "")])
    rollup = actors.actor_rollup(rows)
    top = actors.actors(rollup)
    (row,) = top.collect()
    assert (row.actor, row.narratives, row.posts, row.span_days, row.names) == ("x:u1", 2, 2, 1.0, "a,b")
    assert [tuple(r) for r in actors.actor_pairs(rollup, top).collect()] == [("a", "b", 1)]


def test_drift_matches_one_to_one(spark):
    overlap = spark.createDataFrame([("n", 1, 10, 0.9), ("n", 1, 11, 0.8), ("n", 2, 10, 0.7), ("n", 2, 12, 0.1)], "narrative string, before long, after long, jaccard double")
    assert [tuple(r) for r in coordination.drift(overlap).collect()] == [("n", 1, 10, 0.9)]


def test_sinks(spark, tmp_path):
    target = spark.createDataFrame([("x", "1", "old")], "platform string, id string, label string")
    rows = spark.createDataFrame([("x", "1", "new"), ("x", "2", "b"), ("x", "2", "c")], target.schema)
    out = sinks.insert_ignore(target, rows, ["platform", "id"]).collect()
    assert len(out) == 2 and [r.label for r in out if r.id == "1"] == ["old"]
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").write.partitionBy("k").parquet(path)
    sinks.replace_partitions(spark.createDataFrame([(9, "a")], "v int, k string"), path, "k")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()) == [("a", 9), ("b", 2)]
    assert sinks.with_defaults(target, {"label": "z", "depth": 0}).first().depth == 0
    sinks.write_documents(target, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["label"] == "old"


def test_operators_check_their_inputs(spark):
    with pytest.raises(TypeError):
        graph.degrees(posts=spark.range(1))
    assert "row_number" in trend.rolling_mean.text(SPARK)


def test_known_phrases_and_label_quality(spark):
    posts = spark.createDataFrame([("a", "Red wave, RED WAVE and deep state"), ("a", "red waves"), ("b", "nothing")], "narrative string, text string")
    assert {(r.narrative, r.phrase, r.n) for r in labels.known_phrases(posts).collect()} == {("a", "red wave", 3), ("a", "deep state", 1)}
    want = {
        "": 0.0, "he's purposely": 0.05, "red wave": 1.0, "governor": 1.0, "great": 0.0, "123": 0.0, "they won": 0.12, "word going": 0.18, "is being": 0.18, "will have": 0.08, "will vote": 0.22, "market would": 0.55,
        "the red cat": 0.35, "border wall": 1.0,
    }
    got = labels.phrase_quality(spark.createDataFrame([(p,) for p in want], "phrase string")).collect()
    assert {r.phrase: r.quality for r in got} == want
    weights = spark.createDataFrame([("a", "red wave", 3, 2.0), ("a", "the red wave", 3, 2.0), ("a", "they won", 9, 5.0), ("a", "governor", 2, 1.0)], "narrative string, phrase string, n long, weight double")
    scores = {r.phrase: (r.score, r.bonus) for r in labels.label_scores(weights, labels.phrase_quality(weights)).collect()}
    assert scores == {"red wave": (2.9, 0.0), "the red wave": (0.875, 0.0), "they won": (0.0, 0.0), "governor": (1.25, 0.35)}  # governor: part of a known phrase


def test_relatedness_of_themes(spark):
    tops = spark.createDataFrame([(n, t) for n, ts in {"a": "border wall fence trump", "b": "border wall vote trump", "c": "trump vote senate good"}.items() for t in ts.split()], "narrative string, term string")
    known = spark.createDataFrame([("a", "gun control"), ("c", "gun control")], "narrative string, phrase string")
    got = {(r.a, r.b): (r.related, r.score) for r in labels.relatedness(tops, known).collect()}
    assert got == {("a", "b"): (True, 0.5), ("a", "c"): (True, 1.0), ("b", "c"): (False, 0.0)}


def test_sentiment_alerts_on_worse_states_only(spark):
    kind = "narrative string, trend string, alert string, days long"
    now = spark.createDataFrame([("a", "escalating", "none", 1), ("b", "escalating", "surge", 2), ("c", "stable", "surge", 0), ("d", "escalating", "none", 1)], kind)
    before = spark.createDataFrame([("a", "stable", "surge", 1), ("b", "escalating", "surge", 3), ("c", "stable", "none", 0)], kind)
    assert {(r.narrative, r.kind) for r in analyst.sentiment_alerts(now, before).collect()} == {("a", "trend_escalating"), ("c", "surge"), ("d", "trend_escalating"), ("d", "volume_divergence")}


@pytest.mark.parametrize("percent", [60, 82])
def test_false_candidates_die_inside_the_join(spark, percent):
    """Sets of frequent tokens share prefixes with nearly all others; bounds leave few of them, and no pair is lost."""
    rng = random.Random(percent)
    sets = [sorted(rng.sample([f"w{k}" for k in range(60)], rng.randint(12, 24))) for _ in range(150)]
    sets += [sorted({*rng.sample(s, len(s) - rng.randint(0, 3)), f"w{rng.randrange(60)}"}) for s in sets[:60]]
    frame = spark.createDataFrame([(i, f"u{i % 5}", s, len(s)) for i, s in enumerate(sets)], "post_id long, author_id string, tokens array<string>, n long")
    first = {tuple(s): i for i, s in reversed(list(enumerate(sets)))}
    want = {(i, j) for s, i in first.items() for t, j in first.items() if i < j and 100 * len({*s} & {*t}) >= percent * len({*s} | {*t})}
    assert {(r.a, r.b) for r in similarity.similar_pairs(frame, percent).collect()} == want and len(want) > 20
    assert similarity._candidates(similarity.set_classes(frame), percent).distinct().count() < len(want) + 150 * 149 // 40
