import heapq
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from narravane.llm import merge_dropout as md
from narravane.llm.textarrays import as_bytes, mix, span_hashes

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=md.MODEL_PATH)


def texts(seed=1):
    rng = random.Random(seed)
    bits = ["the", "tion", "ing", "é", "ñ", " ", "  ", "\n", "日本", "🎉", "Q", "z" * 9, "http://", "1234", "\t", " ", "ﬁ", "\x01"]
    return ["", " ", "   ", "a"] + ["".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(300)]


def by_agenda(model, text, rate, seed):
    """One priority queue for the whole text, symbol by symbol."""
    if not text:
        return []
    raw, off = as_bytes(pa.array([text]))
    salt = int(mix(span_hashes(raw, off[:-1], off[1:]) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))[0])
    chars = [" ", *text]
    sym = [-1 if c == "▁" else int(model.char[0x2581 if c == " " else ord(c)]) for c in chars]
    after = [*range(1, len(sym)), -1]
    before = list(range(-1, len(sym) - 1))
    queue, alive = [], [True] * len(sym)

    def push(i, j):
        if i < 0 or j < 0 or sym[i] < 0 or sym[j] < 0:
            return
        made = int(model.joined(np.array([sym[i]]), np.array([sym[j]]))[0])
        if made >= 0:
            word = ((i << 32) + (sym[i] << 16) + sym[j]) & (2**64 - 1)
            if int(mix(np.array([salt ^ word], np.uint64))[0]) >> 11 >= int(rate * (1 << 53)) or rate == 0:
                heapq.heappush(queue, (int(model.priority[made]), i, j, sym[i], sym[j], made))

    for i in range(len(sym) - 1):
        push(i, i + 1)
    while queue:
        _, i, j, a, b, made = heapq.heappop(queue)
        if not (alive[i] and alive[j] and after[i] == j and sym[i] == a and sym[j] == b):
            continue
        sym[i], alive[j], after[i] = made, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(before[i], i)
        push(i, after[i])
    out = []
    for i, c in enumerate(chars):
        if alive[i]:
            out += [sym[i]] if 0 <= sym[i] < model.size else [int(model.byte_ids[x]) for x in c.encode()]
    return out


def encoded(batch, rate, seed=0):
    ids, bounds = md.encode(md.pieces(md.MODEL_PATH), *as_bytes(pa.array(batch)), rate, seed)
    return [ids[b:e].tolist() for b, e in zip(bounds[:-1], bounds[1:], strict=True)]


def test_without_dropout_it_is_the_library():
    batch = texts()
    assert encoded(batch, 0.0) == [LIBRARY.encode(t) for t in batch]


@pytest.mark.parametrize("rate", [0.1, 0.5])
def test_dropout_equals_a_sequential_agenda_and_decodes(rate):
    batch = [*texts(2), "▁x ▁▁", "a▁b"]
    model = md.pieces(md.MODEL_PATH)
    got = encoded(batch, rate, 7)
    assert got == [by_agenda(model, t, rate, 7) for t in batch]
    assert [md.decode(model, x) for x in got] == batch


def test_segmentations_vary_with_seed_and_place():
    word = " international"
    seeds = {tuple(encoded([word], 0.2, s)[0]) for s in range(30)}
    places = encoded([word * 200], 0.2, 1)[0]
    assert len(seeds) > 5 and len(places) > 1.2 * len(encoded([word * 200], 0.0)[0])
    assert encoded(["same", "x", "same"], 0.3, 4)[0] == encoded(["y", "same"], 0.3, 4)[1]


def test_frames(spark, docs_of):
    docs = docs_of([None, "", "hello  world", "é" * 90_000, "same", "same"]).selectExpr("*", "1 AS ids", "2 AS decoded")
    got = md.with_text(md.with_ids(docs, 0.3, 5)).collect()
    assert [r.decoded for r in got] == [None, "", "hello  world", "é" * 90_000, "same", "same"]
    assert got[0].ids is None and got[1].ids == [] and got[4].ids == got[5].ids and got[2].lang == "en"
    trip = md.round_trip(docs, 0.3, 5).collect()
    assert [r.ids for r in trip] == [r.ids for r in got] and all(r.lossless and r.n_ids == len(r.ids or []) for r in trip)
    assert md.round_trip(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        md.with_ids(docs, 1.0)
