"""Rules with values worked out by hand, not by their SQL."""

import pytest
from narravane.operators import analyst, labels, scoring, watch


def posts(spark, *texts):
    return spark.createDataFrame([(i, "n", "u", t) for i, t in enumerate(texts)], "post_id long, narrative string, author_id string, text string")


# 0.5 * tickers / words + 0.2 * min(1, forms / 2) + 0.15 * min(1, runs / 3); see each case.
MARKET = [
    # five of seven words are tickers (0.3571) and spx is a form (0.1): 0.4571; "state" alone is no frame
    ("BTC ETH SPX calls puts state street", 0.4571, True),
    # the same score with gop, wave and state: three words, none of them strong
    ("BTC ETH SPX calls puts nvda gop wave state", 0.4333, True),
    # two strong words rescue: five of seven again
    ("BTC ETH SPX calls puts election fraud", 0.4571, False),
    # three words of which one is strong: six of nine (0.3333) and a form
    ("BTC ETH SPX calls puts nvda gop wave vote", 0.4333, False),
    # one strong and one weak word are too few: five of seven
    ("BTC ETH SPX calls puts vote gop", 0.4571, True),
    # a phrase rescues: five of seven
    ("BTC ETH SPX calls puts red wave", 0.4571, False),
    # nothing but tickers, two forms and a run: 0.5 + 0.2 + 0.05; from 0.65 on nothing rescues
    ("SPX $QQQ btc/eth", 0.75, True),
    # a word is a token of its own: "states" is not "state", "voters" not "voter"
    ("red waves, voters and elections", 0.0, False),
    ("", 0.0, False),
]


@pytest.mark.parametrize(("text", "score", "market"), MARKET)
def test_market_rescue(spark, text, score, market):
    row = scoring.market_scores(posts(spark, text)).first()
    assert (row.market_score, row.market) == (score, market)


@pytest.mark.parametrize(
    ("text", "rage"),
    [("so!!wow", 1), (" !!wow", 1), ("!! wow", 0), ("wow!!", 0), ("xwake up", 1), ("wake upx", 0), ("wake up", 1), ("unhate you", 1), ("WAKE UP, sheeple", 2), ("", 0)],
)
def test_rage_terms_may_start_anywhere(spark, text, rage):
    """The family has a boundary at its end only: after signs a word must follow, before words anything may stand."""
    assert scoring.lexicon_hits(posts(spark, text)).first().rage == rage


@pytest.mark.parametrize(("text", "dehuman"), [("xvermin", 0), ("vermin", 1), ("vermins", 0), ("vermin and SCUM.", 2)])
def test_other_families_have_both_boundaries(spark, text, dehuman):
    assert scoring.lexicon_hits(posts(spark, text)).first().dehuman == dehuman


def test_facts_take_the_mean_strength(spark):
    texts = ["vermin", "vermin and deep state", "calm", "calm"]
    rows = posts(spark, *texts)
    strengths = analyst.lexicon_strength(scoring.lexicon_hits(rows))
    # one family of nine, two of nine, none, none: 0.1111, 0.2222, 0, 0
    assert [r.strength for r in strengths.orderBy("post_id").collect()] == [0.1111, 0.2222, 0.0, 0.0]
    members = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 3)], "theme string, post_id long")
    cohesions = spark.createDataFrame([("a", 0.9), ("b", 0.2)], "theme string, cohesion double")
    topics = spark.createDataFrame([(0, ["x"]), (1, ["x", "y"]), (2, ["y"]), (3, ["z"])], "post_id long, tokens array<string>")
    facts = {r.theme: r for r in labels.theme_facts(members, cohesions, strengths, scoring.market_scores(rows), topics).collect()}
    assert (facts["a"].lexicon_rate, facts["a"].distinctive, facts["b"].lexicon_rate) == (0.1111, 0.2, 0.0)


def test_quality_looks_at_labels_too(spark):
    facts = spark.createDataFrame([("a", 10, 0.8, 0.1, 0.0, 0.4), ("b", 10, 0.8, 0.1, 0.0, 0.4), ("c", 2, 0.2, 0.5, 0.4, 0.0)], "theme string, size long, cohesion double, lexicon_rate double, market_rate double, distinctive double")
    markets = spark.createDataFrame([("b", True)], "narrative string, market_heavy boolean")
    got = {r.theme: r for r in labels.theme_quality(facts, markets).collect()}
    # 0.45 * 0.8 + 0.35 * 0.4 + 0.2 * 0.9 = 0.68, and 0.35 of it for a theme whose labels are tickers
    assert (got["a"].quality, got["a"].confidence, got["a"].plain_confidence, got["a"].emerging, got["a"].boost) == (0.68, "high", "medium", True, 0.124)
    assert (got["b"].quality, got["b"].market, got["b"].emerging, got["b"].confidence, got["b"].plain_confidence) == (0.238, True, False, "medium", "low")
    # 0.09 + 0 + 0.1 = 0.19, of which 0.35
    assert (got["c"].market, got["c"].quality, got["c"].plain_confidence) == (True, 0.0665, "low")


def overrides(spark, merged, split):
    members = spark.createDataFrame([(t, p) for t in (1, 2, 3, 4) for p in (10 * t, 10 * t + 1, 10 * t + 2)], "theme long, post_id long")
    targets = labels.merge_targets(members, spark.createDataFrame(merged, "step long, theme long, into_theme long"))
    out = labels.overridden(members, targets, spark.createDataFrame(split, "theme long, post_id long, part long"))
    themes = {}
    for r in out.collect():
        themes.setdefault(r.theme, set()).add(r.post_id)
    return themes


def test_merges_apply_in_turn(spark):
    themes = overrides(spark, [(0, 1, 2), (1, 2, 3), (2, 4, 1), (3, 4, 9), (4, 3, 3)], [])
    # 1 goes to 2, both go to 3; theme 1 isn't there any more, and 9 never was
    assert themes == {3: {10, 11, 12, 20, 21, 22, 30, 31, 32}, 4: {40, 41, 42}}


def test_parts_replace_a_theme(spark):
    themes = overrides(spark, [(0, 1, 2)], [(2, 10, 0), (2, 21, 0), (2, 22, 1), (3, 30, 0), (7, 1, 0), (7, 2, 1)])
    # posts of theme 2 in no part go; one part alone splits nothing; theme 7 isn't there
    assert themes == {200: {10, 21}, 201: {22}, 3: {30, 31, 32}, 4: {40, 41, 42}}


@pytest.mark.parametrize(("posts_", "lines"), [(0, 0), (1, 1), (2, 2), (3, 3), (4, 5), (10, 6), (255, 10), (256, 11), (1000, 12), (10**6, 12)])
def test_section_sizes(spark, posts_, lines):
    assert watch.section_sizes(spark.createDataFrame([("n", posts_)], "narrative string, posts long")).first().section_lines == lines


def test_next_poll_order(spark):
    watched = spark.createDataFrame([("a", 5, 1), ("b", 9, 1), ("c", 7, 1), ("d", 7, 1), ("e", 99, 1), ("f", 98, 1)], "author_id string, priority long, last_us long")
    polled = spark.createDataFrame([("b", 3, 50, 0, "active"), ("c", 1, 70, 2, "active"), ("d", 1, 60, 0, "active"), ("e", 1, 1, 3, "active"), ("f", 2, 1, 0, "pruned")], "author_id string, polls long, polled_us long, depth long, status string")
    # never polled first, whatever the priority; then by priority, then the one not polled for longest; e is too deep, f is pruned
    assert [r.author_id for r in watch.next_poll(watched, polled).collect()] == ["a", "b", "d", "c"]


def test_posts_are_off_topic_only_where_keywords_tell(spark):
    rows = [("a", 1), ("a", 0), ("a", 0), ("a", 0), ("b", 1), *[("b", 0)] * 4]
    posts_ = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(rows)], "post_id long, narrative string")
    gates = spark.createDataFrame([(i, h) for i, (_, h) in enumerate(rows)], "post_id long, keyword_hits long")
    reasons = spark.createDataFrame([(i, "promo" if i == 3 else "narrative") for i in range(len(rows))], "post_id long, reason string")
    got = {r.post_id: r.reason for r in scoring.topic_filter(reasons, gates, posts_).collect()}
    # a keyword stands in one post of four, which is a quarter, and in one of five, which is less
    assert got == {0: "narrative", 1: "off_topic", 2: "off_topic", 3: "promo"} | {i: "narrative" for i in range(4, 9)}
    assert {r.bucket for r in analyst.filter_buckets(scoring.topic_filter(reasons, gates, posts_)).collect()} == {None, -3, -6}
