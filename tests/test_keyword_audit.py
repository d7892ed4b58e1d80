"""Keyword joins against comparing all with all, the check of queries by hand, and suggestions."""

import random

import pytest
from narravane.operators import keyword_audit as ka
from narravane.operators import keywords


def frames(spark, queries, existing):
    return spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(k,) for k in existing], "keyword string")


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcé", k=rng.randrange(1, 5)))
    text = lambda: rng.choice(["", " "]) + " ".join(rng.choice([word(), "vote", "2026", "ballot"]) for _ in range(rng.randrange(1, 6))).upper()
    queries, existing = frames(spark, [text() for _ in range(60)] + ["ballot", "x y z w", "Ballot"], [text() for _ in range(25)] + ["quite long keyword here", "abcabcabcabc"])
    for fast, slow in ((ka.covered, keywords.covered), (ka.similar_to_existing, keywords.similar_to_existing)):
        assert sorted(fast(queries, existing).collect()) == sorted(slow(queries, existing).collect())
        plan = fast(queries, existing)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
    found = {r.covered for r in ka.covered(queries, existing).collect()}
    assert found == {True, False}


def test_empty_texts_and_tables(spark):
    queries, existing = frames(spark, ["", "one"], ["two", ""])
    for fast, slow in ((ka.covered, keywords.covered), (ka.similar_to_existing, keywords.similar_to_existing)):
        assert sorted(fast(queries, existing).collect()) == sorted(slow(queries, existing).collect())
    assert {r.covered for r in ka.covered(queries, existing.limit(0)).collect()} == {False}
    assert ka.covered(queries.limit(0), existing).count() == 0


CHECKS = {
    "senate": "too short", "author:someone": "author poll", "2024 2026 a b": "no words", "senate post race": "blocked word", "the red wave": "", "Red Wave 2026": "", "governor race": "no anchor", "ballots now": "",
    "congressional": "", "election": "one short word", "2026 election": "", "  senate race  ": "", "supreme court": "",
}


def test_checks_of_queries(spark):
    got = {r.query: (r.ok, r.reason) for r in ka.valid_queries(frames(spark, CHECKS, [])[0]).collect()}
    # "2026 election" has one word beside the year, but twelve characters
    assert got == {q: (reason == "", reason) for q, reason in CHECKS.items()}


def test_suggestions(spark):
    rows = [(f"senate race {i}", 10.0 + i, "theme") for i in range(3)] + [(f"ballot count {i:02d}", 5.0 + i, "corpus") for i in range(12)] + [("senate race 1", 99.0, "corpus"), ("dull words here", 50.0, "theme"), ("used ballot words", 60.0, "theme")]
    terms = spark.createDataFrame(rows, "term string, score double, source string")
    queries = terms.selectExpr("term AS query")
    _, existing = frames(spark, [], ["used"])
    made = lambda t: [(r.query, r.source, r.score) for r in ka.suggestions(t, ka.covered(queries, existing), ka.valid_queries(queries)).collect()]
    # three terms of themes, five of the corpus; "dull words here" has no anchor, "used ballot words" is covered
    assert made(terms) == [("ballot count 11", "corpus", 16.0), ("ballot count 10", "corpus", 15.0), ("ballot count 09", "corpus", 14.0), ("ballot count 08", "corpus", 13.0), ("senate race 2", "theme", 12.0), ("ballot count 07", "corpus", 12.0), ("senate race 1", "theme", 11.0), ("senate race 0", "theme", 10.0)] or sorted(made(terms)) == sorted([("ballot count 11", "corpus", 16.0), ("ballot count 10", "corpus", 15.0), ("ballot count 09", "corpus", 14.0), ("ballot count 08", "corpus", 13.0), ("ballot count 07", "corpus", 12.0), ("senate race 2", "theme", 12.0), ("senate race 1", "theme", 11.0), ("senate race 0", "theme", 10.0)])
    many = terms.selectExpr("term", "score", "CASE WHEN term LIKE 'ballot%' THEN 'theme' ELSE 'corpus' END AS source")
    # twelve terms of themes leave room for one of the corpus
    assert sum(s == "corpus" for _, s, _ in made(many)) == 1 and len(made(many)) == 8


def test_gate_reads_posts_once(spark):
    posts = spark.createDataFrame([(0, "Vote NOW"), (1, "nothing"), (2, "vote ballot"), (3, "vote")], "post_id long, text string")
    reasons = spark.createDataFrame([(0, "narrative"), (1, "narrative"), (2, "market"), (3, "short")], "post_id long, reason string")
    for words in (["vote", " BALLOT ", ""], ["vote", "ballot", *[f"none{i}" for i in range(80)]]):
        gate = ka.ingest_gate(reasons, posts, frames(spark, [], words)[1])
        assert {r.post_id: (r.gate, r.allow, r.keyword_hits) for r in gate.collect()} == {0: ("ok", True, 1), 1: ("off_topic", False, 0), 2: ("market_chatter", False, 2), 3: ("short", False, 1)}
        assert "NestedLoop" not in gate._jdf.queryExecution().executedPlan().toString()
