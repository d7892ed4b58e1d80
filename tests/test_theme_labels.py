"""Exclusive labels against the sequential rule, and cases with known labels."""

import random

import pytest
from narravane.operators import labels, text
from narravane.operators.theme_labels import contrast_scores, exclusive_labels, label_facts, ranked_labels


def twin_ranked(rows):
    out, used, good = [], set(), 0
    for score, phrase, quality in sorted(((-s, p, q) for p, _, q, s in rows if s > 0)):
        if used & set(phrase.split()):
            continue
        used |= set(phrase.split())
        fine = " " in phrase and quality >= 0.55
        good += fine
        out.append((phrase, "term" if len(out) < 6 else "phrase" if fine else None))
        if len(out) >= 6 and good >= 3:
            break
    return [(p, i, k) for i, (p, k) in enumerate(out) if k]


def twin_exclusive(themes):
    """themes: {name: [(phrase, weight, quality, score)]}"""
    usable = {n: [r for r in rows if r[2] >= 0.25] for n, rows in themes.items()}
    best = {n: min((-s, p, w) for p, w, _, s in rows if s > 0)[2] for n, rows in usable.items() if any(r[3] > 0 for r in rows)}
    phrases, words, out = set(), set(), {}
    for name in sorted(best, key=lambda n: (-best[n], n)):
        ranked, mine = twin_ranked(usable[name]), []
        for phrase, _, kind in ranked:
            if not words & set(phrase.split()):
                mine.append((phrase, kind))
        terms = [p for p, k in mine if k == "term"]
        order = [p for _, p in sorted((-s, p) for p, _, _, s in usable[name])]
        if len(terms) < 2:
            more = [p for p in order if p not in terms and p not in phrases][: 6 - len(terms)]
            if not terms and not more:
                more = order[:6]
            mine += [(p, "more") for p in more]
        for p, _ in mine:
            phrases.add(p)
            words |= set(p.split())
        out[name] = set(mine)
    return out


def make(rng, themes, vocabulary):
    word = lambda: f"w{rng.randrange(vocabulary)}"
    out = {}
    for t in range(themes):
        rows = {}
        for _ in range(rng.randrange(1, 25)):
            phrase = " ".join(word() for _ in range(rng.choice([2, 2, 3])))
            quality = rng.choice([1.0, 1.0, 0.35, 0.12])
            weight = rng.randrange(1, 60) / 10
            rows[phrase] = (phrase, weight, quality, round(weight * quality, 3) if quality >= 0.25 else 0.0)
        out[f"t{t:02d}"] = list(rows.values())
    return out


@pytest.mark.parametrize(("themes", "vocabulary"), [(12, 400), (12, 25)])
def test_labels_equal_the_sequential_rule(spark, themes, vocabulary):
    """Few words make themes compete, so some are left with few labels and take further phrases."""
    made = make(random.Random(vocabulary), themes, vocabulary)
    frame = spark.createDataFrame([(n, *r) for n, rows in made.items() for r in rows], "narrative string, phrase string, weight double, quality double, score double")
    got = {}
    for r in exclusive_labels(frame).collect():
        got.setdefault(r.narrative, set()).add((r.label, r.kind))
    want = twin_exclusive(made)
    assert got == {n: w for n, w in want.items() if w}
    assert vocabulary == 400 or sum(k == "more" for w in want.values() for _, k in w) > 5
    ranked = {}
    for r in ranked_labels(frame.select("narrative", "phrase", "quality", "score")).collect():
        ranked.setdefault(r.narrative, []).append((r.phrase, r.place, r.kind))
    assert {n: sorted(v) for n, v in ranked.items()} == {n: sorted(twin_ranked(rows)) for n, rows in made.items() if twin_ranked(rows)}


def scored(spark, texts):
    posts = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate((n, t) for n, ts in texts.items() for t in ts)], "post_id long, narrative string, text string")
    weights = contrast_scores(text.topic_tokens(posts), labels.known_phrases(posts))
    scores = labels.label_scores(weights, labels.phrase_quality(weights))
    return weights.select("narrative", "phrase", "weight").join(scores, ["narrative", "phrase"]).join(labels.phrase_quality(weights), "phrase")


def test_frames_lead_and_fragments_go(spark):
    texts = {
        "governor": ["Governor race free fair elections, GOP may lose swing state.", "Governor race election fraud claims in battleground.", "Free fair governor race turnout predictions."],
        "order": ["Executive order on mail ballot rules ahead of midterm election.", "New executive order restricts mail ballot drop boxes statewide.", "Challenge to executive order over mail ballot access."],
        "slow": ["He's purposely slow rolling the agenda items.", "Slow rolling orders purposely delayed again.", "Purposely slow rolling every policy move."],
    }
    scores = scored(spark, texts)
    found = exclusive_labels(scores)
    named = {}
    for r in sorted(found.collect(), key=lambda r: (r.place, r.label)):
        named.setdefault(r.narrative, []).append(r.label)
    assert named["order"][0] in ("executive order", "mail ballot") and {"executive order", "mail ballot"} <= set(named["order"])
    assert "governor race" in named["governor"] and "slow rolling" not in named["slow"] and "he's purposely" not in named["slow"]
    words = [w for n, ls in named.items() for w in {w for x in ls for w in x.split()}]
    assert len(words) == len(set(words))  # no word of two themes
    facts = {r.narrative: r for r in label_facts(scores, found).collect()}
    assert all(0 < f.distinctive <= 1 and f["labels"] for f in facts.values())


def test_information_against_the_other_themes(spark):
    rows = {r.narrative + ":" + r.phrase: r for r in scored(spark, {"a": ["alpha beta alpha beta"], "b": ["gamma delta gamma delta", "alpha beta"]}).collect()}
    # theme a: 4 tokens, "alpha beta" twice; elsewhere once of 6 tokens: log2((0.5 + 1e-9) / (1.5 / 7 + 1e-9)) * ln 3
    assert rows["a:alpha beta"].weight == pytest.approx(1.3425, abs=1e-3)
    assert "b:alpha beta" not in rows  # log2((1 / 6) / (2.5 / 5)) is negative


def test_one_theme_and_no_theme(spark):
    assert exclusive_labels(scored(spark, {"a": ["plain words stand here", "plain words stand there"]})).count() == 0
    assert exclusive_labels(scored(spark, {"a": ["x"]})).count() == 0
