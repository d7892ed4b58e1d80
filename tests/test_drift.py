"""Drift of themes: matches against a plain loop, and each kind of change in a case made by hand."""

import random

from narravane.operators import drift


def test_matches_equal_choosing_in_order(spark):
    rng = random.Random(1)
    rows = [(n, o, w, rng.choice([0.35, 0.4, 0.5, 0.6])) for n in ("a", "b") for o in range(14) for w in range(12) if rng.random() < 0.3]
    want = set()
    for narrative in ("a", "b"):
        used = set()
        for old in range(14):
            best = min(((-j, w) for n, o, w, j in rows if (n, o) == (narrative, old) and w not in used), default=None)
            if best:
                used.add(best[1])
                want.add((narrative, old, best[1], -best[0]))
    got = drift.matches(spark.createDataFrame(rows, "narrative string, before long, after long, jaccard double"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 15
    assert drift.matches(got.limit(0)).count() == 0


def report(spark, olds, news, old_facts, new_facts):
    posts = lambda x: spark.createDataFrame([("n", t, p) for t, ps in x.items() for p in ps], "narrative string, theme long, post_id long")
    facts = lambda x: spark.createDataFrame([("n", t, labels, d) for t, (labels, d) in x.items()], "narrative string, theme long, labels array<string>, distinctive double")
    overlap = drift.overlaps(posts(olds), posts(news))
    return {(r.kind, r.theme, r.other, r.value) for r in drift.drift_report(facts(old_facts), facts(new_facts), overlap, drift.matches(overlap)).collect()}


def test_each_kind_of_change(spark):
    olds = {1: range(10), 2: range(10, 20), 3: range(20, 30), 4: range(30, 40), 5: range(40, 50), 6: range(50, 60)}
    news = {11: range(5), 12: range(5, 10), 13: range(10, 30), 15: range(40, 50), 16: range(50, 60), 17: range(70, 80), 18: range(80, 90)}
    plain = (["a", "b"], 0.3)
    got = report(
        spark, olds, news,
        {1: plain, 2: plain, 3: plain, 4: plain, 5: (["wave", "red", "heat"], 0.5), 6: (["x", "y", "z"], 0.6)},
        {11: plain, 12: plain, 13: plain, 15: (["texas", "senate", "red"], 0.5), 16: (["y", "x", "z"], 0.4), 17: (["new"], 0.12), 18: (["dull"], 0.11)},
    )
    assert got == {
        ("split", 1, None, 2.0), ("merged", 13, None, 2.0),
        # 2 and 3 overlap 13 alike, and 2 comes first; 1 takes 11, so 12 has no old theme
        ("vanished", 3, None, 0.3), ("vanished", 4, None, 0.3), ("emerged", 12, None, 0.3), ("emerged", 17, None, 0.12),
        # one label of five in common; all labels of 6 and 16 are in common, so another first label is no drift
        ("label_drift", 5, 15, 0.2), ("distinctiveness_drop", 6, 16, 0.2),
    }


def test_without_a_baseline_distinctive_themes_emerge(spark):
    assert report(spark, {}, {1: range(3), 2: range(3, 6)}, {}, {1: (["nazi"], 0.9), 2: (["dull"], 0.1)}) == {("emerged", 1, None, 0.9)}


def test_overlap_bound(spark):
    # seven of twenty posts in common are 0.35, six of twenty are not
    assert {r[0] for r in report(spark, {1: range(13)}, {2: range(6, 20)}, {1: (["a"], 0.5)}, {2: (["b"], 0.5)})} == {"label_drift"}
    assert {r[0] for r in report(spark, {1: range(13)}, {2: range(7, 20)}, {1: (["a"], 0.5)}, {2: (["b"], 0.5)})} == {"vanished", "emerged"}
