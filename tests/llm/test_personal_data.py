import hashlib
import itertools
import math
import random
import re

from narravane.llm import personal_data as pd_
from narravane.llm.personal_data import SegmentField, Window


def plain_base(text):
    """The fixed patterns as they are written, one by one."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(8)
    bits = ["a", "x.y", "@", "@b-c", ".", "com", "1", "23", "255", "256", "0", ".", "-", " ", "+", "(", ")", "4111111111111111", "5500 0000 0000 0004", "é", "+1 (437) 555-0689", "a@b.c", "007", "\n"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randrange(12)))
        assert pd_.base_spans(text) == plain_base(text), text
    assert pd_.base_spans("x" * 200_000 + "1" * 200_000 + "@") == []


def segmentations(n, cands):
    """All sets of candidates that do not overlap."""
    for k in range(4):
        for combo in itertools.combinations(cands, k):
            s = sorted(combo, key=lambda c: c[0])
            if all(x[1] <= y[0] for x, y in itertools.pairwise(s)):
                yield combo


def test_dynamic_programme_equals_enumeration():
    rng = random.Random(3)
    for text in ("+1 (437) 555-0689 x", "ab at cd dot com 12", "1.2.3.4 555-0689"):
        window = Window(text, 0, len(text))
        weights = {}
        for _, _, kind, features in window.candidates():
            for name in (kind, *(f"{kind}|{f}" for f in features)):
                weights.setdefault(name, rng.uniform(-0.8, 0.8))
        field = SegmentField(weights)
        cands = field.scored(window)
        every = [(sum(c[4] for c in s), s) for s in segmentations(len(window.tokens), cands)] if len(cands) < 25 else None
        probs, log_z = field.marginals(window)
        assert all(0 <= p[4] <= 1 + 1e-9 for p in probs)
        if every and max(len(s) for _, s in every) < 3:
            assert math.isclose(log_z, math.log(sum(math.exp(x) for x, _ in every)))
            best = max(every, key=lambda x: x[0])
            assert math.isclose(sum(c[4] for c in cands if (c[0], c[1], c[2]) in field.decode(window)), best[0], abs_tol=1e-9)


def test_held_out_sentences():
    find = pd_.finder(pd_.trained().weights)
    hit = extra = missed = 0
    for text, gold in pd_.training_sentences(400, seed=1234):
        base, added = find(text)
        got = {*base, *added}
        hit, extra, missed = hit + len(got & set(gold)), extra + len(got - set(gold)), missed + len(set(gold) - got)
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.95


def test_report_and_redaction(spark, docs_of):
    texts = [
        None, "", "call (437) 555-0689 now", "write to ann.lee (at) mail.example.com please", "on 2024-05-06 at 12:30:45, version 1.2.3", "card 4111 1111 1111 1111 ok",
        "From 10.0.0.1 to é a@b.org +44 20 7946 0958", "plain words only. And more at noon.", "z" * 150_000 + " phone: 437-555-0689",
    ]
    got = {r.doc_id: r for r in pd_.personal_report(docs_of(texts).selectExpr("*", "'x' AS spans")).collect()}
    assert got[2].spans == "phone:5:19" and got[2].n_added == 1 and got[2].n_phone == 0
    assert got[3].spans == "email:9:38"
    assert [got[i].spans for i in (0, 1, 4, 7)] == [""] * 4
    assert got[5].spans == "card:5:24" and got[5].n_card == 1
    assert (got[6].n_ip, got[6].n_email, got[6].n_phone) == (1, 1, 1)
    assert got[6].base_sha256 == hashlib.sha256(b"ip:5:13,email:19:26,phone:27:43").hexdigest()
    assert got[8].spans == "phone:150008:150020"
    clean = {r.doc_id: r for r in pd_.without_personal_data(docs_of(texts)).collect()}
    assert clean[2].text == "call [PHONE] now" and clean[2].n_chars == 16 and clean[0].text is None
    assert pd_.personal_report(docs_of([])).count() == 0


def test_every_window_is_decoded():
    weights = pd_.trained().weights
    find, field = pd_.finder(weights), SegmentField(weights)
    spoken = ["JANE AT EXAMPLE DOT COM", "jane at example (dot) com", "write to jane at example\tdot com", "jane AT example[DOT]org"]
    spaced = ["call 4 3 7 5 5 5 0 6 8 9", "phone: 4-3-7-5-5-5-0-6-8-9", "card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "ip 1.2.3.4", "no 5 of them at noon"]
    added = 0
    for text in spoken + spaced:
        want = []
        for low, high in pd_.windows(text):
            window = Window(text, low, high)
            want += [(kind, window.spans[i][0], window.spans[j - 1][1]) for i, j, kind in field.decode(window)]
        base, got = find(text)
        assert got == pd_.outside(want, base)
        added += text in spoken and bool(got)
    assert added == len(spoken)


#: Sentences written by hand, not by the generator that the field is trained on, and their entities.
HAND_WRITTEN = [
    ("Please pay to IBAN DE44 5001 0517 5407 3249 31 by Friday", []),
    ("the index rose +1234567 points overnight", []),
    ("You can reach Maria under 030 1234567 during office hours", ["phone:030 1234567"]),
    ("Call our office at (415) 555-0132 before noon.", ["phone:(415) 555-0132"]),
    ("my number is 415-555-0198, text me", ["phone:415-555-0198"]),
    ("write to john dot smith at example dot com please", ["email:john dot smith at example dot com"]),
    ("contact jane [at] widgets [dot] org for details", ["email:jane [at] widgets [dot] org"]),
    ("support(at)acme.io answers quickly", ["email:support(at)acme.io"]),
    ("Version 10.4.2.1 was released", ["ip:10.4.2.1"]),
    ("ISBN 978-3-16-148410-0 is out of print", []),
    ("Order 4929 1023 4411 shipped on 2021-03-04", []),
    ("Card 4111-1111-1111-1111 exp 12/26", ["card:4111-1111-1111-1111"]),
    ("we paid with 5500/0000/0000/0004 last week", ["card:5500/0000/0000/0004"]),
    ("The meeting is at 10 dot sharp", []),
    ("Invoice 20230415-0093, total 1,204.50", []),
    ("born 12.05.1987 in Graz", []),
    ("tel. 0049 89 1234567", ["phone:0049 89 1234567"]),
    ("Fax: 212.555.0147", ["phone:212.555.0147"]),
    ("population 8 336 817 in 2019", []),
    ("look at the dot on the map", []),
    ("coordinates 48.1374, 11.5755", []),
    ("Mobile 0171/9876543 (evenings)", ["phone:0171/9876543"]),
    ("he scored 3-0 6-4 7-5", []),
    ("bob @ company . net is my address", ["email:bob @ company . net"]),
    ("serial 1234-5678-9012-3456", []),
    ("the years 1914-1918 and 1939-1945", []),
    ("ring +44 20 7946 0958 after six", ["phone:+44 20 7946 0958"]),
    ("ticket #55512345 closed", []),
    ("1 800 555 0199 is toll free", ["phone:1 800 555 0199"]),
    ("phone 555 0199", []),
]


def test_sentences_written_by_hand():
    find = pd_.finder(pd_.trained().weights)
    right = wrong = missed = 0
    for text, entities in HAND_WRITTEN:
        got = {f"{kind}:{text[s:e]}" for part in find(text) for kind, s, e in part}
        right, wrong, missed = right + len(got & set(entities)), wrong + len(got - set(entities)), missed + len(set(entities) - got)
    assert right >= 13 and wrong <= 3 and missed <= 2
