"""The vector store: what is encoded, what a replay and a failed run change, and the vectors themselves."""

import math

import pytest
from narravane.operators import vector_store as vs
from pyspark.sql import functions as F


def posts(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "post_id long, text string")


def contents(spark, path):
    return sorted((r.key, tuple(r.vector)) for r in vs.stored(spark, path).collect())


def test_texts_are_encoded_once(spark, tmp_path):
    path, asked = str(tmp_path), []

    def counted(texts):
        asked.append(texts.count())
        return vs.hashed_terms(texts)

    texts = [f"text number {i % 60} of a corpus" for i in range(100)] + [None, "", "é!"]
    vectors, encoded = vs.resolve(posts(spark, texts[:50]), path, counted)
    assert (vectors.count(), encoded, asked) == (50, 50, [50])
    vectors, encoded = vs.resolve(posts(spark, texts), path, counted)
    assert (vectors.count(), encoded, asked) == (102, 12, [50, 12])
    before = contents(spark, path)
    vectors, encoded = vs.resolve(posts(spark, texts), path, counted)
    assert (vectors.count(), encoded, asked) == (102, 0, [50, 12]) and contents(spark, path) == before and len(before) == 62
    by_id = {r.post_id: r.vector for r in vectors.collect()}
    assert by_id[20] == by_id[80] != by_id[21] and 100 not in by_id and not any(by_id[101]) and not any(by_id[102])


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path)
    vs.resolve(posts(spark, [f"some text {i}" for i in range(200)]), path)
    vs.resolve(posts(spark, ["one more text"]), path)
    commits = vs._commits(spark, path).groupBy("number").count().orderBy("number").collect()
    assert commits[0]["count"] > 40 and commits[1]["count"] == 1
    assert vs.stored(spark, path).count() == 201


def test_a_run_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    vs.resolve(posts(spark, ["a text", "another text"]), path)
    before = contents(spark, path)

    def broken(texts):
        return vs.hashed_terms(texts).withColumn("vector", F.expr("IF(key IS NOT NULL, CAST(raise_error('lost') AS array<float>), vector)"))

    with pytest.raises(Exception, match="lost"):
        vs.resolve(posts(spark, ["a third text"]), path, broken)
    assert contents(spark, path) == before
    assert vs.resolve(posts(spark, ["a third text"]), path)[1] == 1 and vs.stored(spark, path).count() == 3


def test_vectors_have_unit_length_and_likeness(spark):
    texts = spark.createDataFrame([("a", "red wave over the state"), ("b", "red wave over the states"), ("c", "an entirely different matter"), ("d", "wave")], "key string, text string")
    v = {r.key: r.vector for r in vs.hashed_terms(texts).collect()}
    dot = lambda x, y: sum(p * q for p, q in zip(v[x], v[y], strict=True))
    assert all(math.isclose(dot(k, k), 1, abs_tol=1e-5) and len(v[k]) == vs.WIDTH for k in v)
    assert dot("a", "b") > 0.6 > dot("a", "c") and sum(x != 0 for x in v["d"]) == 1


def test_bytes_round_trip(spark):
    df = spark.createDataFrame([(1, [0.5, -1.25, 3e-7]), (2, None), (3, [])], "post_id long, vector array<float>")
    packed = vs.as_bytes(df)
    assert [None if r.vector is None else len(r.vector) for r in packed.orderBy("post_id").collect()] == [12, None, 0]
    assert vs.from_bytes(packed).orderBy("post_id").collect() == df.orderBy("post_id").collect()
