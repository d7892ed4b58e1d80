import os
import random
import re

import duckdb
import pytest
from narravane.llm import ngram_join, queries
from narravane.llm.ngram_join import Bands, near_duplicate_groups
from pyspark.sql import functions as F


def brute(texts, n=3, percent=90):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if a and sets[j] and 100 * inter >= percent * (len(a) + len(sets[j]) - inter):
                links += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}, links


def corpus(seed, groups=14, hub=True):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(4000))
    texts = [None, "", "  \t\n ", "One", "one", "two words", "TWO  words", "a b c", "x y z", "x y z"]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([5, 9, 12, 20, 24, 40, 90, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5, 14])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[: max(1, int(len(copy) * rng.uniform(0.88, 1)))]
            texts.append((" " if rng.random() < 0.7 else "\n").join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("hot", [2, 64])
def test_same_groups_as_brute_force(docs_of, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT_KEY", hot)
    texts = corpus(hot)
    want, links = brute(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_groups(docs_of(texts)).collect()}
    assert links > 40 and got == want


def test_other_parameters(docs_of):
    texts = corpus(5, groups=8)
    want, _ = brute(texts, n=5, percent=80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_groups(docs_of(texts), 5, 80).collect()} == want


def test_memberships_cover_all_pairs_in_reach():
    for percent in (80, 90, 100):
        bands = Bands(percent)
        for big in range(1, 400):
            band = bands.of(big)
            for small in range(-(-percent * big // 100), big + 1):
                differ = (100 - percent) * (small + big) // (100 + percent)
                if differ:
                    assert all(dict(bands.memberships(k))[band] >= differ for k in (small, big))
                    assert differ < bands.segments(band) - 1


def test_empty_table_nulls_and_repeated_rows(spark, docs_of):
    assert near_duplicate_groups(docs_of([])).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, None), (7, "q r s"), (3, "Q R  S")]
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS component_id", "2 AS c1")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 2, 5), (3, 1, 3), (5, 2, 5), (5, 2, 5), (7, 1, 3)]


def dense(seed, docs=700, vocabulary=60, planted=250):
    """Short texts from so few words that most subsets are shared by many, with planted pairs."""
    rng = random.Random(seed)
    texts = [" ".join(rng.sample([f"v{i}" for i in range(vocabulary)], rng.randrange(20, 23))) for _ in range(docs)]
    for at in rng.sample(range(docs), planted):
        copy = texts[rng.randrange(docs)].split()
        copy[rng.randrange(len(copy))] = f"v{rng.randrange(vocabulary)}"
        texts[at] = " ".join(copy)
    return texts


@pytest.mark.parametrize("hot, around", [(2, 0.22), (4, 0.22), (64, 0.22), (2, 0.0)])
@pytest.mark.parametrize("percent", [80, 90])
def test_dense_vocabulary(docs_of, monkeypatch, hot, around, percent):
    monkeypatch.setattr(ngram_join, "HOT_KEY", hot)
    monkeypatch.setattr(ngram_join, "AROUND", around)
    texts = dense(hot)
    want, links = brute(texts, 1, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_groups(docs_of(texts), 1, percent).collect()}
    assert links > 100 and got == want


@pytest.mark.parametrize("hot", [4, 64])
def test_templates_with_passages_of_many(docs_of, monkeypatch, hot):
    """Texts that mostly consist of a few passages, so most of their subsets are hot, and unlinked variants of them."""
    monkeypatch.setattr(ngram_join, "HOT_KEY", hot)
    rng = random.Random(hot)
    passages = [" ".join(f"p{k}x{i}" for i in range(60)) for k in range(5)]
    texts = []
    for i in range(300):
        parts = rng.sample(passages, rng.choice([1, 2, 3])) + [" ".join(f"u{rng.randrange(40)}" for _ in range(rng.randrange(4, 60)))]
        texts.append(" ".join(parts))
        if rng.random() < 0.3:
            texts.append(texts[-1] + f" end{i} of {i}")
    want, links = brute(texts, 5, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_groups(docs_of(texts), 5, 80).collect()}
    assert links > 100 and got == want


def test_repeated_ids_with_other_texts_are_one_node(spark):
    rows = [(5, "a b c d"), (5, "m n o p"), (9, "m n o p"), (2, "A B C D"), (4, "z"), (4, None), (4, "y"), (8, "Y")]
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (4, 4), (4, 4), (4, 4), (5, 2), (5, 2), (8, 4), (9, 2)]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (1, 90)])
def test_allocation_finds_all_links_if_every_subset_is_hot(spark, docs_of, n, percent):
    texts = []
    for words in (8, 14, 20, 26, 33, 40, 60):
        base = [f"t{words}x{i}" for i in range(words)]
        for slots in range(3):
            filled = [f"s{slots}" if i in (words // 3, words // 3 + 1) else w for i, w in enumerate(base)]
            texts += [" ".join(filled + ["e", "f", "g"][:tail]) for tail in range(4)]
    docs = docs_of(texts)
    sig = docs.mapInArrow(ngram_join._signatures(n, percent), "doc_id long, n_shingles long, c1 long, sketch array<long>, crowded array<long>")
    classes = sig.selectExpr("c1 AS node", "doc_id AS id", "n_shingles AS n", "sketch")
    rows = docs.mapInArrow(ngram_join._index_rows(n, percent), "key long, c1 long, band int, need int")
    hot = rows.groupBy("key").count().where("count > 1").selectExpr("key", "count AS groups")
    held = rows.join(hot, "key").groupBy("c1", "band").agg(F.count(F.lit(1)).alias("h"), F.min("need").alias("need")).where("h >= need").withColumnRenamed("c1", "rep")
    records = classes.selectExpr("node AS rep", "n", "sketch", "node AS comp")
    id_of = {r.node: r.id for r in classes.collect()}
    got = {frozenset((id_of[r.a], id_of[r.b])) for r in ngram_join._allocated(docs, classes, held.select("rep", "band"), hot, records, n, percent).collect()}
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in map(str.split, texts)]
    links = {frozenset((i, j)) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 100 * len(a & b) >= percent * len(a | b)}
    # a pair with a record that doesn't skip more than it may for free shares a subset that is not hot
    hidden = {(id_of[r.rep], r.band) for r in held.collect()}
    bands = ngram_join.Bands(percent)
    sought = {p for p in links if all((d, bands.of(max(len(sets[i]) for i in p))) in hidden for d in p)}
    assert len(sought) > 20 and sought <= got


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    path = f"{folder}/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = con.sql(queries.ORACLE_SQL["op7_ngram_jaccard"])
    got = queries.op7_ngram_jaccard(spark, folder).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
