"""Snapshot documents: the round trip, odd texts, missing fields, and broken documents at the gates."""

import json

from narravane.operators import snapshots


def sample(spark):
    rows = spark.createDataFrame(
        [("a", 10, 4, "2024-01-01", "2024-01-09", 0.1234, "stable", 1e-6, 7, 3, 1, 0), ('odd "name"\n', 1, 1, "2024-01-01", "2024-01-01", 0.0, "escalating", -0.25, None, None, None, None)],
        "narrative string, posts long, authors long, first_day string, last_day string, mean_score double, trend string, slope double, edges long, connected long, isolated long, known_bots long",
    )
    alerts = spark.createDataFrame([("a", "trend", "it's “up”", 1, 2), ("a", "level", "level 3", 0, 1), ("other", "week", "x", 2, 3)], "narrative string, kind string, message string, severity int, place long")
    return rows, alerts


def test_round_trip(spark, tmp_path):
    rows, alerts = sample(spark)
    snapshots.save(snapshots.documents(rows, alerts), str(tmp_path / "s"))
    loaded = snapshots.load(spark, str(tmp_path / "s"))
    got = snapshots.flat(loaded).drop("version", "alerts").select(rows.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert sorted(tuple(r) for r in snapshots.alerts_of(loaded).collect()) == [("a", 1, "level", "level 3", 0), ("a", 2, "trend", "it's “up”", 1)]
    doc = json.loads(snapshots.documents(rows, alerts).where("narrative = 'a'").first().document)
    assert doc["version"] == 5 and doc["summary"]["posts"] == 10 and [x["kind"] for x in doc["alerts"]] == ["level", "trend"]


def test_gates_find_broken_documents(spark, tmp_path):
    rows, alerts = sample(spark)
    good = snapshots.documents(rows, alerts).where("narrative = 'a'").first().document
    broken = [good, good.replace('"version":5', '"version":4'), good.replace('"posts":10', '"posts":"ten"'), '{"version":5}', "no json", good.replace('"connected":3', '"connected":9')]
    spark.createDataFrame([(t,) for t in broken], "document string").coalesce(1).write.text(str(tmp_path / "s"))
    failed = {r.gate: r.failed for r in snapshots.document_gates(snapshots.flat(snapshots.load(spark, str(tmp_path / "s")))).collect()}
    assert failed == {"version": 1, "named": 1, "has posts": 2, "authors within posts": 2, "days in order": 1, "score in range": 1, "trend known": 1, "graph adds up": 2, "bots within authors": 1, "has alerts": 1}
