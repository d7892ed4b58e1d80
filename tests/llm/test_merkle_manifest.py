"""The manifest against plain trees, and against the reference SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from narravane.llm import merkle_manifest
from narravane.llm.merkle_manifest import manifest
from narravane.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """The contract, with whole trees in lists."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = {}
    for doc_id, text, lang, source, n in rows:
        leaf = lambda n: H("".join(map(field, (doc_id, source, lang, n, text))))  # noqa: B023, E731
        bad = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf(n), leaf(n + 1) if bad else leaf(n)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, i):
        out = []
        for level in tree[:-1]:
            out.append(("", "") if (i ^ 1) >= len(level) else (level[i ^ 1], "") if i % 2 else ("", level[i ^ 1]))
            i //= 2
        return out

    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    whole = {lang: levels([x[2] for x in sorted(trees[lang])]) for lang in order}
    top = levels([whole[lang][-1][0] for lang in order]) if order else [[]]
    out = []
    for k, lang in enumerate(order):
        for i, (has, doc_id, leaf, forged) in enumerate(sorted(trees[lang])):
            way, node = path(whole[lang], i) + path(top, k), forged
            for before, after in way:
                node = H(before + node + after)
            out.append((doc_id if has else None, leaf, whole[lang][-1][0], top[-1][0], H("".join(b + a for b, a in way)), node, node == top[-1][0]))
    return out


def results(rows):
    return sorted(map(repr, map(tuple, rows)))


def odd_rows():
    rng = random.Random(4)
    rows = [(i, "ä" * rng.randrange(5) + str(i), rng.choice(["en", "fr", "de", "é", "Z"]), rng.choice(["a", None]), rng.choice([None, i, 0])) for i in range(150)]
    rows += [(7, "same", "en", "s", 4)] * 9 + [(None, None, None, None, None)] * 3 + [(None, "", "en", "", 0), (3, "again", "en", "s", 5), (900, "alone", "solo", "s", 5), (901, "x" * 100_000, "en", None, 7)]
    return rows


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_equals_plain_trees_for_blocks_of_any_size(spark, monkeypatch, height):
    monkeypatch.setattr(merkle_manifest, "HEIGHT", height)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 2**height)
    rows = odd_rows()
    got = manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert results(got.collect()) == results(plain(rows))


def test_tampered_rows_alone_fail(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(60)]
    for r in manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


@pytest.mark.parametrize("rows", [[], [(7, "one", "en", "s", 3)], [(None, None, None, None, None)], [(1, "a", None, "s", 1), (2, "b", "en", "s", 1)]])
def test_few_rows(spark, rows):
    assert results(manifest(spark.createDataFrame(rows, SCHEMA)).collect()) == results(plain(rows))


def test_extra_columns_and_names_of_its_own(spark):
    rows = odd_rows()[:40]
    plain_frame = spark.createDataFrame(rows, SCHEMA)
    crowded = plain_frame.selectExpr("*", "1 AS tree", "2 AS node", "'x' AS _place", "3 AS at", "4 AS _row")
    assert results(manifest(crowded).collect()) == results(manifest(plain_frame).collect())


def test_query_equals_reference_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(ORACLE_SQL["op12_merkle_manifest"])
    got = QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns
    assert results(got.collect()) == results(want.fetchall())
