"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A BPE model joins the adjacent pair of symbols whose joined piece has the best
score, the leftmost one on ties, until no pair is left.  With dropout, each
candidate merge is skipped for good if a keyed hash of the seed, the text, its
place and its two symbols falls below the rate.  So a text has one segmentation
for each seed, words get varied ones at different places, and rate 0 gives the
library's encoding.

The agenda of all words of a slice is processed together in numpy: each round
takes the best remaining candidate of every word.  That equals one agenda for
the text if no piece holds a space mark after another character, since merges
then never cross words; a model with such pieces is processed text by text.

Decoding joins the bytes of the pieces, and gives the text back exactly: a
character without a piece is encoded by its bytes, and so is a literal U+2581,
which the library would confuse with a space.

The model file is a parameter; it is read once a worker and never stored.

Cases: a null text gives null ids, an empty one an empty list; repeated rows
get equal ids; very long texts are encoded whole; other input columns are kept,
and replaced if they have the name of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.llm.textarrays import mix, slices, span_hashes

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
_U = np.uint64
_NEVER = np.uint32(0xFFFFFFFF)
_MARK = 0x2581


class Pieces:
    """The tables of a BPE model: symbols, merges and priorities."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        byte_set = set(self.byte_ids.tolist())
        normal = {model.id_to_piece(i): i for i in range(size) if not special[i] and i not in byte_set}
        # symbols: pieces by their id, then characters that only stand inside pieces
        symbols = dict(normal)
        for piece in normal:
            for c in piece:
                symbols.setdefault(c, size + len(symbols) - len(normal))
        self.size, self.bits = size, max(15, int(max(symbols.values(), default=0)).bit_length())
        scores = sorted({model.get_score(i) for i in normal.values()}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        self.priority = np.zeros(size, np.uint32)
        for i in normal.values():
            self.priority[i] = order[model.get_score(i)]
        self.by_word = not any("▁" in p.lstrip("▁") for p in normal)
        self.char = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        keys, values = [], []
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << self.bits | b)
                    values.append(i)
        self._index(np.array(keys, np.int64), np.array(values, np.int32))
        self.bytes = [b""] * size
        for s, i in normal.items():
            self.bytes[i] = s.replace("▁", " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            self.bytes[i] = bytes([b])

    def _index(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table with linear probing."""
        self.shift = 64 - max(16, int(len(keys) * 6).bit_length())
        slots = 1 << (64 - self.shift)
        self.keys, self.values = np.full(slots + 64, -1, np.int64), np.full(slots + 64, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == -1
            _, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            at[left] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(self.shift)).astype(np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make together, or -1."""
        keys = a.astype(np.int64) << self.bits | b
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] += 1
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        out[(a < 0) | (b < 0)] = -1
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(model: Pieces, raw: np.ndarray, off: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice, one after the other, and the n+1 bounds of the texts in them."""
    rows = len(off) - 1
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = (raw & 0xC0) != 0x80
    seen = np.concatenate(([0], np.cumsum(lead)))[off]  # bounds of the rows in code points
    some = np.flatnonzero(np.diff(seen) > 0)
    points = np.insert(points, seen[some], 0x20)  # a space before each text
    row = np.repeat(np.arange(rows), np.diff(seen) + (np.diff(seen) > 0))
    symbol = model.char[np.where(points == 0x20, _MARK, points)]
    symbol[points == _MARK] = -1
    first = np.searchsorted(row, np.arange(rows + 1))
    n = len(points)
    start = np.zeros(n, bool)
    if model.by_word and n:
        space = points == 0x20
        start[1:] = space[1:] & ~space[:-1]
    start[first[:-1][np.diff(first) > 0]] = True

    salt = mix(span_hashes(raw, off[:-1], off[1:]) ^ _U((seed * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
    place = np.arange(n) - first[row] if n else np.zeros(0, np.int64)
    bar = _U(int(rate * (1 << 53)))

    def candidates(sym: np.ndarray, nxt: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joined piece and agenda key (priority) of pairs whose left symbol stands at ``at``."""
        made = model.joined(sym, nxt)
        key = np.full(len(made), _NEVER, np.uint32)
        good = np.flatnonzero(made >= 0)
        if rate > 0:
            h = mix(salt[row[at[good]]] ^ ((place[at[good]].astype(_U) << _U(32)) + (sym[good].astype(_U) << _U(16)) + nxt[good].astype(_U)))
            good = good[(h >> _U(11)) >= bar]
        key[good] = model.priority[made[good]]
        return made, key

    # live symbols of unfinished words: symbol, place in the slice, word, and the pair with the next one
    at = np.arange(n, dtype=np.int32)
    word = np.cumsum(start, dtype=np.int32)
    made, key = np.zeros(n, np.int32), np.full(n, _NEVER, np.uint32)
    if n > 1:
        made[:-1], key[:-1] = candidates(symbol[:-1], symbol[1:], at[:-1])
        key[:-1][start[1:]] = _NEVER
    result = symbol.copy()
    alive = np.ones(n, bool)
    sym = symbol.copy()
    while len(at):
        begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.repeat(np.minimum.reduceat(key, begin), np.diff(np.append(begin, len(at))))
        done = least == _NEVER  # words without a candidate
        hits = np.flatnonzero((key == least) & ~done)
        w = word[hits]
        hits = hits[np.concatenate(([True], w[1:] != w[:-1]))] if len(hits) else hits  # the leftmost of a word
        result[at[done]] = sym[done]
        sym[hits] = made[hits]
        gone = hits + 1
        alive[at[gone]] = False
        keep = ~done
        keep[gone] = False
        moved = np.cumsum(keep, dtype=np.int32) - 1
        kept = np.flatnonzero(keep)
        at, word, sym, made, key = at[kept], word[kept], sym[kept], made[kept], key[kept]
        if not len(at):
            break
        h = moved[hits]
        key[h] = _NEVER
        last = len(at) - 1
        right = h[(h < last)]
        right = right[word[right] == word[right + 1]]
        left = h[h > 0] - 1
        left = left[word[left] == word[left + 1]]
        touched = np.concatenate((right, left))
        if len(touched):
            made[touched], key[touched] = candidates(sym[touched], sym[touched + 1], at[touched])
    result, owner, point = result[alive], row[alive], points[alive]
    # symbols without a piece of their own fall back to bytes
    bare = (result < 0) | (result >= model.size)
    if bare.any():
        width = np.where(bare, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
        spread = np.repeat(result, width)
        where = np.repeat(bare, width)
        text = "".join(map(chr, point[bare].tolist())).encode()
        spread[where] = model.byte_ids[np.frombuffer(text, np.uint8)]
        result, owner = spread, np.repeat(owner, width)
    return result.astype(np.int32), np.searchsorted(owner, np.arange(rows + 1))


def decode(model: Pieces, ids: list[int]) -> str:
    """The text of a list of ids, without the space that encoding puts before it."""
    return b"".join(map(model.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


def with_ids(docs: DataFrame, rate: float = 0.1, seed: int = 0, model_path: str = MODEL_PATH, column: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as an array<int> column."""
    if not 0 <= rate < 1:
        raise ValueError("rate must be at least 0 and below 1")
    docs = docs.drop(column)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            for part, raw, off in slices(batch, "text", 1 << 19):
                ids, bounds = encode(model, raw, off, rate, seed)
                missing = part.column(part.schema.get_field_index("text")).is_null()
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids), mask=missing)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, column])

    return docs.mapInArrow(run, fields)


def with_text(encoded: DataFrame, model_path: str = MODEL_PATH, column: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text of its ids; null ids give a null text."""
    encoded = encoded.drop(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", `{text}` string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(model_path)
        for frame in frames:
            frame[text] = [None if x is None else decode(model, x.tolist()) for x in frame[column]]
            yield frame

    return encoded.mapInPandas(run, fields)


def round_trip(docs: DataFrame, rate: float = 0.1, seed: int = 0, model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, n_ids, ids, lossless): the ids of each text, and whether their decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            for part, raw, off in slices(batch, "text", 1 << 19):
                ids, bounds = encode(model, raw, off, rate, seed)
                flat, whole, cut, b = ids.tolist(), raw.tobytes(), off.tolist(), bounds.tolist()
                same = [decode(model, flat[b[i] : b[i + 1]]).encode() == whole[cut[i] : cut[i + 1]] for i in range(part.num_rows)]
                missing = part.column(part.schema.get_field_index("text")).is_null()
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids), mask=missing)
                doc = part.column(part.schema.get_field_index("doc_id"))
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.diff(bounds), pa.int64()), lists, pa.array(same)], ["doc_id", "n_ids", "ids", "lossless"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_ids long, ids array<int>, lossless boolean")
