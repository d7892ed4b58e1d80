"""Places and rows before, against plain windows; ties, nulls, hot groups and empty tables."""

import random

import pytest
from narravane.functions.places import lagged, numbered
from pyspark.sql import Window
from pyspark.sql import functions as F


@pytest.mark.parametrize("parts", [1, 7])
def test_equal_plain_windows(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(40) if rng.random() < 0.95 else None, i, rng.choice([None, i % 9])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, t long, id long, x long").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        places = numbered(df, ["t", "id"])
        assert {(r.id, r.place) for r in places.collect()} == {(r.id, r.place) for r in df.withColumn("place", F.row_number().over(Window.orderBy("t", "id"))).collect()}
        before = lagged(df, ["g"], ["t", "id"], F.col("x") + 1, "before")
        want = df.withColumn("before", F.lag(F.col("x") + 1).over(Window.partitionBy("g").orderBy("t", "id")))
        assert {tuple(r) for r in before.collect()} == {tuple(r) for r in want.collect()} and before.columns == want.columns
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, t long")
    assert numbered(df, ["t"]).count() == 0 and lagged(df, ["g"], ["t"], F.col("t"), "before").count() == 0


def test_written_tables_can_be_removed(spark, monkeypatch):
    import os

    from narravane.functions import scratch

    monkeypatch.setattr(scratch, "_MADE", [])
    rows = scratch.written(spark.range(5))
    (path,) = scratch._MADE
    assert rows.count() == 5 and os.path.isdir(path)
    assert scratch.remove_all(spark) == 1 and not os.path.exists(path) and scratch._MADE == []
