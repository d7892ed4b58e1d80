"""Each stage against a plain version of it, on a whole small table."""

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest
from narravane.llm import decontamination as dec
from narravane.llm import line_quality as lq
from narravane.llm import merge_dropout as md
from narravane.llm import secrets as sec
from narravane.llm.spans import replaced
from narravane.llm.textarrays import as_bytes
from test_decontamination import distances
from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append({r.doc_id: r for r in docs.collect()})
    for _, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, SF))
        out.append({r.doc_id: r for r in docs.collect()})
        assert docs.count() == len(out[-1])
    return out


def test_quality(spark, stages):
    before, after = stages[0], stages[1]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lq.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {d for d, r in before.items() if lq.scores_of(model, *as_bytes(pa.array([r.text])))[0] >= 0.3}
    assert set(after) == keep and all(after[d] == before[d] for d in keep)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good & keep) >= 0.98 * len(good) and len(keep) < len(before)


def test_near_duplicates(stages):
    before, after = stages[1], stages[2]
    ids = sorted(before)
    groups, _ = brute([before[d].text for d in ids], 5, 80)
    assert set(after) == {ids[i] for i, (_, c) in groups.items() if i == c}
    assert all(after[d] == before[d] for d in after)


def test_decontamination(spark, stages):
    before, after = stages[2], stages[3]
    items = [dec.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for d, r in before.items():
        text = dec.normal(r.text)
        exact = any(i in text for i in items)
        assert not (exact and d in after)
        if d not in after and not exact:
            assert any(distances(i, text) <= len(i) * 8 // 100 for i in items)
    assert set(after) <= set(before)


def test_secrets_and_encoding(stages):
    before, after, ids = stages[3:]
    assert set(before) == set(after) == set(ids)
    find, model = sec.finder(), md.pieces(md.MODEL_PATH)
    for d, r in before.items():
        text = replaced(r.text, [s for part in find(r.text) for s in part], lambda kind: "[SECRET]")
        assert after[d].text == text and after[d].n_chars == len(text) and not any(find(text))
        assert md.decode(model, ids[d].ids) == text
        assert ids[d].ids == md.encode(model, *as_bytes(pa.array([text])), 0.1, 1)[0].tolist()


def test_run_gives_the_rows_of_the_stages(spark, stages):
    got = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    assert got.keys() == stages[-1].keys() and all(np.array_equal(got[d].ids, r.ids) for d, r in stages[-1].items())


def test_odd_rows(spark, docs_of):
    docs = docs_of([None, "", "a b c d e f", "a b c d e f", None]).unionByName(docs_of(["repeat it", "repeat it"], 0).selectExpr("NULL AS doc_id", "text", "lang", "source", "n_chars"))
    kept = cp.keep_one_of_near_duplicates(spark, docs.unionByName(docs.where("doc_id = 2")), SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["0", "1", "2", "4", "None"]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    mixed = spark.createDataFrame([(None, item), (None, "clean text"), (7, item), (7, "clean text"), (8, None)], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars", "0.25 AS score", "9 AS _key")
    assert sorted((str(r.doc_id), r.text) for r in cp.drop_benchmark_leaks(spark, mixed, SF).where("text IS NOT NULL").collect()) == [("7", "clean text"), ("None", "clean text")]
    assert {r.score for r in cp.keep_good_quality(spark, mixed, SF).collect()} <= {mixed.first().score}
    assert cp.redact_secrets(spark, docs, SF).count() == 7 and cp.drop_benchmark_leaks(spark, docs, SF).count() == 7
    assert cp.encode_with_dropout(spark, docs_of([]), SF).count() == 0


def test_stages_bound_the_batches_of_workers(spark):
    docs, setting = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1), "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    longest = docs.selectExpr("max(octet_length(text))").first()[0] + 1000
    try:
        for _, stage in cp.STAGES:
            spark.conf.unset(setting)
            stage(spark, docs, SF)
            got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r.rows for r in got) == docs.count() and max(r.bytes for r in got) <= cp.BATCH_BYTES + longest
        spark.conf.set(setting, "64k")  # a smaller one stays
        cp.redact_secrets(spark, docs, SF)
        assert spark.conf.get(setting) == "64k"
    finally:
        spark.conf.unset(setting)
