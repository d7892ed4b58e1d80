import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from narravane.llm import phrase_fingerprint as pf


def plain_parse(text):
    """Phrases byte by byte."""
    known, start = [], 0
    seen = set()
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            known.append(text[start:end])
            start = end
    return known


def make(seed, count):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["the", "é", "ing", "on", "ña", "x"], k=rng.randrange(1, 5)))
    return [rng.choice([None, "", "a", "aaaaaaaaaaaaaaa", *[" ".join(word() for _ in range(rng.randrange(1, 120)))] * 4]) for _ in range(count)]


def test_phrases_equal_the_plain_parse():
    for text in make(1, 200):
        raw = (text or "").encode()
        phrases = plain_parse(raw)
        ends, _ = pf.parse(raw, set())
        assert [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)] == phrases
        for limit in (0, len(raw) // 2, len(raw)):
            known = set()
            ends, at = pf.parse(raw, known, 0, limit)
            assert all(e <= limit for e in ends)
            rest, _ = pf.parse(raw, known, at)
            assert len(ends) + len(rest) == len(phrases)


def test_likeness_estimates_the_jaccard_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for size in (20, 200, 2000):
        for share in (0.1, 0.5, 0.9):
            common, a, b = int(size * share), None, None
            pool = rng.integers(0, 2**64, 2 * size, np.uint64)
            a, b = pool[:size], np.concatenate((pool[:common], pool[size : 2 * size - common]))
            sig = pf.signatures(np.concatenate((a, b)), np.repeat([0, 1], size), 2)
            errors.append(pf.likeness(sig[:1], sig[1:])[0] - common / (2 * size - common))
    assert max(map(abs, errors)) < 0.2 and abs(np.mean(errors)) < 0.06


@pytest.mark.parametrize("rows", [5, 8000])
def test_rows_equal_brute_force(docs_of, monkeypatch, rows):
    monkeypatch.setattr(pf, "RANGE_ROWS", rows)
    monkeypatch.setattr(pf, "STEP_BYTES", 700)
    texts = make(3, 90)
    got = {r.doc_id: r for r in pf.with_next(docs_of(texts, 7)).collect()}
    assert sorted(got) == list(range(7, 97))
    def sig(t):
        raw = (t or "").encode()
        h = [pf.span_hashes(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]))[0] for p in plain_parse(raw)]
        return pf.signatures(np.array(h, np.uint64), np.zeros(len(h), np.int64), 1)[0], bool(h)

    for d, r in got.items():
        text, after = texts[d - 7] or "", texts[(d - 8) % 90] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        (own, a), (twin, b), (other, c) = sig(text), sig(edited), sig(after)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == (own.astype(">u2").tobytes().hex() if a else "")
        assert r.edited_fingerprint == (twin.astype(">u2").tobytes().hex() if b else "")
        assert r.near_edited == pytest.approx((own == twin).mean() if a and b else float(a == b))
        assert r.near_next == pytest.approx((own == other).mean() if a and c else float(a == c))


def test_ranges_and_their_ends_come_from_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(pf, "RANGE_ROWS", 40)
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", "2")
    try:
        rows = [(i if i % 3 else None if i % 2 else 600, f"text {i % 50} of {i % 7}") for i in range(3000)]
        out = pf.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(9))
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.rangeExchange.sampleSizePerPartition")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 or "ReusedExchange" in plan
    key = lambda doc, text: (doc is None, -(doc or 0), hashes[text])
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(rows, key=lambda r: key(*r))
    want = Counter()
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        want[doc, hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_cases(spark, docs_of):
    one = pf.with_next(docs_of(["abcdef"])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert pf.with_next(docs_of([])).count() == 0
    rows = [(None, "x y z"), (None, None), (4, "same text"), (4, "same text"), (4, "same text"), (9, "é" * 100_000)]
    got = pf.with_next(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS range")).collect()
    assert len(got) == 6 and {r.fingerprint for r in got if r.doc_id == 4}.__len__() == 1
    assert sorted(str(r.doc_id) for r in got) == ["4", "4", "4", "9", "None", "None"]
