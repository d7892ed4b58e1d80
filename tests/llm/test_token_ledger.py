import random
import re

import pytest
from narravane.llm import token_ledger as tl
from narravane.functions.scratch import folder
from pyspark.sql import functions as F


@pytest.fixture()
def ledger(spark):
    return tl.TokenLedger(spark, folder(spark))


def totals(ledger):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}


@pytest.mark.parametrize("compact", [2, 16])
def test_random_batches_equal_a_recount(spark, ledger, monkeypatch, compact):
    monkeypatch.setattr(tl, "COMPACT_AFTER", compact)
    rng, truth = random.Random(5), {}
    for batch in range(1, 6):
        rows = []
        for _ in range(40):
            key = (*rng.choice([(None, 1), (None, 2), *((i, None) for i in range(25))]), rng.choice(["v1", "v2"]))
            value = None if rng.random() < 0.3 else rng.randrange(1, 99)
            rows.append((*key, rng.choice(["a", "b", None]), rng.choice(["en", "de"]), value, len(rows)))
            truth[key] = rows[-1]
        changes = spark.createDataFrame(rows, tl.CHANGES)
        assert ledger.commit(batch, changes)
        assert not ledger.commit(batch, changes.limit(3))
        want = {}
        for row in truth.values():
            if row[5] is not None:
                d, t = want.get((row[3], row[4], row[2]), (0, 0))
                want[(row[3], row[4], row[2])] = (d + 1, t + row[5])
        assert totals(ledger) == want
    with pytest.raises(ValueError):
        ledger.commit(0, changes)


def test_a_failed_batch_is_written_again(spark, ledger, monkeypatch):
    one = spark.createDataFrame([(1, None, "v", "a", "en", 5, None), (1, None, "v", "a", "en", 5, None)], tl.CHANGES)
    ledger.commit(1, one)
    with monkeypatch.context() as m:
        m.setattr(tl.TokenLedger, "_mark", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ledger.commit(2, spark.createDataFrame([(1, None, "v", "a", "en", 9, None)], tl.CHANGES))
    assert totals(ledger) == {("a", "en", "v"): (1, 5)}
    assert ledger.commit(2, spark.createDataFrame([(1, None, "v", "b", "en", 7, None), (2, None, "v", "b", "en", None, None)], tl.CHANGES))
    assert totals(ledger) == {("b", "en", "v"): (1, 7)}


def recount(docs, version="byte_bpe_50k"):
    """Totals after each batch, from the texts: {(batch, source, lang, version): (n_docs, n_tokens)}."""
    encode = tl.tokenizer(tl.VOCABULARY_PATH).encode_ordinary
    rows = {("text", r.text or "") if r.doc_id is None else r.doc_id: r for r in docs}
    out, held, first = {}, {}, {}
    for k, r in sorted(rows.items(), key=lambda x: str(x[0]).zfill(20)):
        if r.doc_id is not None and r.text is not None:
            first.setdefault(r.text, k)
    for batch in (1, 2, 3, 4):
        for k, r in rows.items():
            text = r.text or ""
            if batch == 1:
                held[k, version] = len(encode(text))
            elif batch == 2:
                held[k, "words"] = len(re.findall(r"\S+", text, re.A))
            elif batch == 3 and r.doc_id is not None and "  " in text:
                held[k, version] = len(encode(re.sub(" {2,}", " ", text)))
            elif batch == 4 and r.doc_id is not None and r.text is not None and first[text] != k:
                del held[k, version], held[k, "words"]
        for (k, v), n in held.items():
            at = (batch, rows[k].source, rows[k].lang, v)
            d, t = out.get(at, (0, 0))
            out[at] = (d + 1, t + n)
    return out


def totals_by_batch(docs, spark):
    return {(r.batch, r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in tl.rollup(docs, folder(spark)).collect()}


def test_batches_equal_a_recount_of_odd_rows(spark, docs_of):
    texts = [None, None, "", "Hello world", "Hello  world", "Hello world", "été 123", "x" * 50_000, "Hello  world"]
    docs = docs_of(texts).unionByName(docs_of(["a b", "a b", None, "c"]).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.selectExpr("*", "1 AS n_tokens", "2 AS version", "3 AS part", "4 AS batch")
    assert totals_by_batch(docs, spark) == recount(docs.collect())
    assert totals_by_batch(docs_of([]), spark) == {}


def test_whole_table_equals_a_recount(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert totals_by_batch(docs, spark) == recount(docs.collect())
