import random

import pytest
from narravane.llm import decontamination as dec


def distances(pattern, text):
    """Least distance of pattern to any substring, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("abcdé")
        elif kind == 1:
            out.insert(i, rng.choice("abcdé"))
        else:
            del out[i]
    return "".join(out)


def test_myers_equals_the_full_table():
    rng = random.Random(1)
    for _ in range(300):
        pattern = "".join(rng.choices("abé ", k=rng.randrange(1, 90)))
        text = "".join(rng.choices("abé ", k=rng.randrange(0, 120)))
        best, end = dec.myers(pattern, text)
        assert best == distances(pattern, text)
        assert distances(pattern, text[:end]) == best


def test_finds_exactly_what_brute_force_finds(docs_of, spark, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_CHARS", 600)
    monkeypatch.setattr(dec, "SLICE", 900)
    monkeypatch.setattr(dec, "STEP", 64)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(1, 8)))
    items = [" ".join(word() for _ in range(rng.choice([2, 12, 30]))) for _ in range(15)]
    texts = []
    for _ in range(80):
        t = " ".join(word() for _ in range(rng.choice([0, 3, 40, 120])))
        if rng.random() < 0.8:
            item = rng.choice(items)
            t += "\n" + edited(rng, item.upper() if rng.random() < 0.3 else item, rng.choice([0, 1, 3, 6, 9, 14])) + "  " + word()
        texts.append(t)
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            p, n = dec.normal(item), dec.normal(t)
            if (best := distances(p, n)) <= dec.budget(len(p), 8):
                want.add((d, i, best))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = dec.contaminated(docs_of(texts), table, 8).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want) > 30
    for r in got:
        p, s = dec.normal(items[r.item_id]), dec.normal(texts[r.doc_id][r.start : r.end])
        assert dec.myers(p, s, anchored=True)[0] == r.distance


@pytest.mark.parametrize("errors", [0, 3, 10, 20])
def test_matcher_equals_the_full_table_on_dense_alphabets(errors):
    """Few letters, so pieces stand everywhere; items from one character on, some of them in one another."""
    rng = random.Random(errors)
    items = [(i, "".join(rng.choices("ab é", k=n))) for i, n in enumerate([1, 2, 5, 9, 10, 14, 15, 20, 33, 60, 130])]
    items += [(20, items[8][1] * 3), (21, items[9][1])]
    matcher = dec.Matcher(items, errors)
    for _ in range(40):
        texts = ["".join(rng.choices("ab é", k=rng.randrange(80))) + edited(rng, rng.choice(items[3:])[1] * 2, rng.randrange(6)) for _ in range(4)]
        texts = [dec.normal(x) for x in texts]
        want = {(t, i, best) for t, x in enumerate(texts) for i, p in items if (n := dec.normal(p)) and (best := distances(n, x)) <= dec.budget(len(n), errors)}
        assert {m[:3] for m in matcher.matches(texts)} == want


@pytest.mark.parametrize(("rate", "least"), [(0.05, 1.0), (0.08, 0.97), (0.1, 0.95)])
def test_recall_at_edit_rates(rate, least):
    """Items of 80 to 400 characters inside other text, with so many random edits for each hundred characters."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(20, 90)))) for i in range(60)]
    matcher = dec.Matcher(items, 10)
    found = 0
    for i, item in items:
        text = " ".join(word() for _ in range(200)) + edited(rng, item, round(len(item) * rate)) + " ".join(word() for _ in range(200))
        found += any(m[1] == i for m in matcher.matches([dec.normal(text)]))
    assert found / len(items) >= least


def test_items_longer_than_a_block_and_clean_texts(docs_of, spark, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_CHARS", 50)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 9)))
    items = [" ".join(word() for _ in range(n)) for n in (3000, 4, 30, 6)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    clean = [" ".join(word() for _ in range(300)) for _ in range(20)]
    got = dec.contaminated(docs_of([*clean, edited(rng, items[0], 900), items[2].upper()]), table, 10).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(20, 0), (21, 2)}


@pytest.mark.parametrize("errors", [0, 8])
def test_cases(spark, docs_of, errors):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None), (3, " "), (None, "zeta eta theta iota kappa"), (1, "alpha beta gamma delta")], "item_id long, text string").selectExpr("*", "0 AS doc_id")
    docs = docs_of([None, "", "İ x ALPHA\n beta  gamma\tdelta!", "zeta eta theta iota kappa", "alpha beta gamma"])
    got = [tuple(r) for r in dec.contaminated(docs, items, errors).collect()]
    assert sorted(got, key=str) == [(2, 1, 0, 4, 28), (2, 1, 0, 4, 28), (3, None, 0, 0, 25)]
    assert dec.contaminated(docs_of([]), items).count() == 0
    assert dec.contaminated(docs, items.limit(0)).count() == 0
