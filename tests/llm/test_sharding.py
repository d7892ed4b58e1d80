import math
import zlib
from collections import Counter

import numpy as np
import pytest
from narravane.llm import sharding
from pyspark.sql import functions as F


def test_matrix_has_exact_margins_and_is_spread():
    matrix = np.array(sharding.communication_matrix([10, 0, 25, 7], sharding.shard_sizes(42, 5), 3))
    assert matrix.sum(axis=1).tolist() == [10, 0, 25, 7]
    assert matrix.sum(axis=0).tolist() == [9, 9, 8, 8, 8]
    cells = [sharding.communication_matrix([50, 50], [50, 50], s)[0][0] for s in range(400)]
    assert abs(np.mean(cells) - 25) < 0.6 and abs(np.var(cells) - 50 * 50 * 50 * 50 / (100 * 100 * 99)) < 1.6
    assert sharding.communication_matrix([], [], 1) == []
    big = sharding.communication_matrix([3 * 10**9, 10**9], [2 * 10**9, 2 * 10**9], 1)
    assert np.array(big).sum(axis=0).tolist() == [2 * 10**9] * 2


@pytest.mark.parametrize("bucket", [7, 20_000])
def test_shards_are_exact_gapless_and_repeatable(docs_of, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    texts = [None, "", "é" * 5, "same", "same"] + [f"text {i}" for i in range(495)]
    got = sharding.shard_documents(docs_of(texts)).collect()
    assert sorted(r.doc_id for r in got) == list(range(500))
    counts = Counter(r.shard for r in got)
    assert sorted(counts) == list(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(24):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    again = sharding.shard_documents(docs_of(texts).repartition(7)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_repeated_rows_nulls_empty_table_and_clashing_columns(spark, docs_of):
    rows = spark.createDataFrame([(None, None)] * 30 + [(1, "a")] * 30, "doc_id long, text string")
    got = sharding.shard_documents(rows, shards=7).collect()
    assert len(got) == 60 and sorted(Counter(r.shard for r in got).values()) == [8, 8, 8, 9, 9, 9, 9]
    assert sharding.shard_documents(docs_of([])).count() == 0
    clash = docs_of(["a", "b"]).selectExpr("*", "1 AS shard", "2 AS slot", "3 AS size")
    assert {r.slot for r in sharding.shard_documents(clash, shards=1).collect()} == {0, 1}


@pytest.mark.parametrize("few", [2, 32])
def test_draws_follow_the_law(monkeypatch, few):
    """All draws go through one scheme, whatever the size of the urn; here against the exact probabilities."""
    monkeypatch.setattr(sharding, "FEW_DRAWS", few)
    rng = np.random.default_rng(7)
    for good, bad, draws in ((9, 14, 11), (30, 10, 7), (60, 80, 70), (5, 200, 100), (0, 8, 4), (8, 0, 4)):
        every, n = math.comb(good + bad, draws), 6000
        seen = Counter(sharding._hypergeometric(rng, good, bad, draws) for _ in range(n))
        law = {x: n * math.comb(good, x) * math.comb(bad, draws - x) / every for x in range(max(0, draws - bad), min(good, draws) + 1)}
        assert set(seen) <= set(law)
        likely = [x for x in law if law[x] >= 5]
        assert sum((seen[x] - law[x]) ** 2 / law[x] for x in likely) < len(likely) + 5 * (2 * len(likely)) ** 0.5


def test_large_urns_have_the_moments_of_the_law():
    rng = np.random.default_rng(3)
    good, bad, draws = 3 * 10**11, 7 * 10**11, 4 * 10**10
    x = np.array([sharding._hypergeometric(rng, good, bad, draws) for _ in range(800)], float)
    total, mean = good + bad, draws * good / (good + bad)
    variance = mean * bad / total * (total - draws) / (total - 1)
    assert abs(x.mean() - mean) < 4 * (variance / 800) ** 0.5 and abs(x.var() / variance - 1) < 0.25


@pytest.mark.parametrize("bucket", [5, 20_000])
def test_same_rows_as_a_plain_version(spark, monkeypatch, bucket):
    """The whole query again: hashes from Spark, ranks and runs by sorted lists."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    rows = [(i % 40, f"text {i % 7}" if i % 5 else None) for i in range(300)] + [(None, "same")] * 100
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    copies, plain = Counter(), []
    for doc, text in rows:
        raw = (text or "").encode()
        key = (doc, len(raw) + 8, zlib.crc32(raw))
        plain.append((*key, copies[key]))
        copies[key] += 1
    hashed = [F.xxhash64(F.lit(f"20/{salt}"), "doc_id", "size", "text_crc32", "copy").alias(salt) for salt in ("deal", "local", "final")]
    keyed = spark.createDataFrame(plain, "doc_id long, size long, text_crc32 long, copy long").select("*", *hashed).collect()
    place = lambda key, buckets: (((key % 2**64) >> 20) % buckets, key)
    parts = [sorted((r for r in keyed if r.deal % 64 == p), key=lambda r: place(r.local, 400 // (64 * bucket) + 1)) for p in range(64)]
    matrix = sharding.communication_matrix(list(map(len, parts)), sharding.shard_sizes(400, 24), 20)
    shards = [[] for _ in range(24)]
    for part, row in zip(parts, matrix, strict=True):
        ends = np.cumsum(row)
        for at, r in enumerate(part):
            shards[int(np.searchsorted(ends, at, "right"))].append(r)
    want = Counter((r.doc_id, r.size, r.text_crc32, s, slot) for s, rs in enumerate(shards) for slot, r in enumerate(sorted(rs, key=lambda r: place(r.final, 400 // (24 * bucket) + 1))))
    got = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(frame).collect())
    assert got == want
    spread = Counter(s for d, _, _, s, _ in got if d is None)
    assert len(spread) > 18  # copies are dealt like other rows


def test_pairs_meet_at_the_uniform_rate(spark):
    rows = spark.range(200).selectExpr("id AS doc_id")
    together = 0
    for seed in range(6):
        got = sharding.shuffle_into_shards(rows, ["doc_id"], 4, seed, partitions=8).collect()
        shard = {r.doc_id: r.shard for r in got}
        together += sum(shard[i] == shard[i + 1] for i in range(0, 200, 2))
    assert abs(together / 600 - 49 / 199) < 0.06
