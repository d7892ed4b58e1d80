import itertools
import zlib

import numpy as np
import pyarrow as pa
from narravane.llm import line_quality as lq
from narravane.llm.textarrays import as_bytes
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def enumerated(model, x):
    """Marginals and expected moves by all label sequences."""
    n = len(x)
    p, moves, total = np.zeros(n), np.zeros((2, 2)), 0.0
    for labels in itertools.product((0, 1), repeat=n):
        w = np.exp(sum((x[i] @ model.weights) * labels[i] for i in range(n)) + sum(model.moves[a, b] for a, b in itertools.pairwise(labels)))
        total += w
        p += w * np.array(labels)
        for a, b in itertools.pairwise(labels):
            moves[a, b] += w
    return p / total, moves / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 4, 7, 1, 3, 6]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    model = lq.Chain(rng.normal(size=5), rng.normal(size=(2, 2)))
    x = rng.normal(size=(bounds[-1], 5))
    p, moves = model.marginals(x, bounds, pairs=True)
    want = [enumerated(model, x[b:e]) for b, e in itertools.pairwise(bounds)]
    assert np.allclose(p, np.concatenate([w[0] for w in want]))
    assert np.allclose(moves, sum(w[1] for w in want))


def test_lines_and_their_features():
    texts = ["", "one line", "a\n\nb b b\n", None, "\n", "Ünï 123 !!\nÜnï 123 !!"]
    raw, off = as_bytes(pa.array(texts))
    x, size, bounds = lq.line_features(raw, off)
    assert np.diff(bounds).tolist() == [1, 1, 4, 1, 2, 2]
    assert size.tolist() == [0, 8, 1, 0, 5, 0, 0, 0, 0, 12, 12]
    assert x[:, 3].tolist() == [1, 0, 0, 1, 0, 1, 1, 1, 1, 0, 0]  # empty
    assert x[:, 23].tolist() == [0] * 9 + [1, 1]  # stands elsewhere in the document
    assert x[4, 19] == 1 and abs(x[4, 20] - 2 / 3) < 1e-12  # repeated words, runs
    y = lq.with_neighbours(x, bounds)
    assert (y[1, lq.LINE_FEATURES :] == 0).all() and (y[3, lq.LINE_FEATURES : 2 * lq.LINE_FEATURES] == x[2]).all()


def test_held_out_accuracy_and_labels_of_the_fold_are_unused(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in lq.quality(docs, labels).collect()}
    assert len(got) == 1000
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    fold = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(g.predicted == q for g, q in fold) / len(fold) > 0.95
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    again = {r.doc_id: r.score for r in lq.quality(docs, flipped).collect()}
    assert all(abs(again[d] - r.score) < 1e-9 for d, r in got.items())


def test_cases(spark, docs_of):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (2, 7)], "doc_id long, quality int").selectExpr("*", "0 AS text")
    docs = docs_of([None, "", "x" * 300_000, "a\n" * 5000, "same", "same"]).selectExpr("*", "1 AS score")
    got = {r.doc_id: r for r in lq.quality(docs, labels).collect()}
    assert len(got) == 6 and got[0].score == got[1].score and got[4].score == got[5].score
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in lq.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert lq.quality(docs_of([]), labels).count() == 0
    kept = lq.score(docs, lq.Chain()).collect()
    assert len(kept) == 6 and kept[0].score == 0.5 and kept[0].lang == "en"


def test_one_long_document_does_not_end_the_sample(spark):
    """The first labelled document in the order of the hash gets more lines than a document may have."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    usable = lq.line_sample(docs, labels, lq.TRAIN_DOCS, lq.TRAIN_LINES, lq.DOC_LINES)
    first = usable.orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("a line\n"), lq.TRAIN_LINES + 1)).otherwise(F.col("text")))
    assert lq.line_sample(long, labels, lq.TRAIN_DOCS, lq.TRAIN_LINES, lq.DOC_LINES).count() == usable.count() - 1
    fold = [r.doc_id for r in labels.where(lq.held_out()).collect()]
    before, after = ({r.doc_id: r.predicted for r in lq.quality(d, labels).where(F.col("doc_id").isin(fold)).collect()} for d in (docs, long))
    assert sum(before[d] == after[d] for d in fold) >= 0.98 * len(fold) and len(set(after.values())) == 2


def test_the_number_of_lines_is_bounded(spark, docs_of):
    docs = docs_of(["a\nb\nc", "d", "e\nf", None, "g\nh\ni\nj\nk"])
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int").where(~lq.held_out())
    for lines, each in ((100, 3), (4, 2), (2, 2), (1, 1)):
        texts = [r.text or "" for r in lq.line_sample(docs, labels, 10, lines, each).collect()]
        assert all(t.count("\n") < each for t in texts) and sum(t.count("\n") + 1 for t in texts) <= lines and texts


def test_mixed_documents_have_a_label_for_each_line(spark, docs_of):
    texts = ["g1\ng2\ng3\ng4", "b1\nb2\nb3", None, "b9", "g7"]
    rows = docs_of(texts).selectExpr("doc_id", "CASE WHEN doc_id IN (1, 3) THEN 0 ELSE 1 END AS good", "text")
    got = {r.doc_id: (r.text.split("\n"), r.good) for r in lq.spliced(rows).collect()}
    assert set(got) == set(range(5))
    for d, (lines, good) in got.items():
        assert len(lines) == len(good) and set(good) == {0, 1}
        assert [x for x, g in zip(lines, good, strict=True) if g == (d not in (1, 3))] == (texts[d] or "").split("\n")
        assert all((x[:1] != "b") == bool(g) for x, g in zip(lines, good, strict=True))
    assert lq.spliced(rows.where("good = 1")).count() == 0


def test_lines_of_mixed_documents(spark):
    """Held-out documents spliced with one another: the chain tells the lines apart, not only the documents."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = lq.train(docs, labels)
    fold = docs.join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id").where(lq.held_out()).select("doc_id", "good", "text")
    right = lines = changed = plain = 0
    for r in lq.spliced(fold).collect():
        raw, off = as_bytes(pa.array([r.text]))
        x, size, bounds = lq.line_features(raw, off)
        p, _ = model.marginals(lq.with_neighbours(x, bounds), bounds)
        right += ((p >= 0.5) == np.array(r.good)).sum()
        lines += len(p)
        plain += max(sum(r.good), len(r.good) - sum(r.good))
        changed += 0 < (p >= 0.5).sum() < len(p)
    assert lines > 500 and changed > 20
    assert right / lines > max(0.85, plain / lines), (right / lines, plain / lines)
