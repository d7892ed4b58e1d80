"""Repairs the structure of conversations with an error-correcting Earley parse.

A conversation is a sentence of roles: an optional system turn, then pairs of a
user and an assistant turn.  The grammar has productions for errors beside the
plain ones: a row may be deleted, get another role, or a turn may be inserted,
each at a cost.  A chart item keeps the least (cost, audit) of its derivations,
the audit being the initials of the edits; the completed chart gives the repair.

The grammar is linear to the left, so all its phrases start where the parse
does and a chart set has a bounded number of items.  Long conversations are
parsed in chunks of consecutive rows, in parallel: the chart of a chunk holds the
best derivation from each phrase that may precede it to each phrase that may end
it, and charts compose.  What meets in one place for a conversation is a chart
for each chunk.  Only the digest of the repaired text, which is sequential by
its definition, streams the rows of a conversation through one task, in order
and with bounded memory.

Two derivations of one item have edited the same rows.  Were one audit the
beginning of the other, the rest would be insertions that lead back to the same
phrase, at a cost; so of equally cheap audits none is the beginning of another,
and the least one stays the least whatever follows.

Cases: null ids, turns, roles and texts count as one space in the rules, so a
null text is blank; null turns come first; the rows of a null id are one
conversation.  Rows of one turn are ordered by a digest of role and text.  An
empty role has no initial and can't be kept.  An empty table gives no rows, and
a conversation whose rows are all lost gives zeros.  Columns beside the four are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narravane.functions.scratch import written
from narravane.llm.ordering import in_ranges

#: Rows of a chunk, a power of two.
CHUNK = 512
INITIALS = ("s", "u", "a", "o")
FAULTS = ("", "blank", "duplicate", "truncated")
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

# Phrases: B before any kept turn, S after a system turn, H with an open pair, P after whole pairs.  U and A are turns.
PHRASES = "BSHP"
GRAMMAR: dict[str, tuple[tuple[str, ...], ...]] = {
    "B": (("B", "delete"),),
    "S": (("B", "keep s"), ("S", "delete")),
    "H": (("B", "U"), ("S", "U"), ("P", "U"), ("H", "delete")),
    "P": (("H", "A"), ("P", "delete")),
    "U": (("keep u",), ("rerole u",), ("insert",)),
    "A": (("keep a",), ("rerole a",), ("insert",)),
}

Value = tuple[int, str]


def _scan(symbol: str, code: str) -> Value | None:
    """Cost and initial of applying an edit to a row, None where it can't be applied."""
    initial, fault = INITIALS[(ord(code) - 65) // 4], FAULTS[(ord(code) - 65) % 4]
    edit, _, role = symbol.partition(" ")
    if edit == "delete":
        return DELETE, "D"
    if fault in ("blank", "duplicate"):
        return None
    extra = TRUNCATED * (fault == "truncated")
    if edit == "keep":
        return (extra, "K") if initial == role else None
    return (REROLE + extra, "R") if initial != role else None


_SCANS = {(symbol, chr(65 + k)): _scan(symbol, chr(65 + k)) for rules in GRAMMAR.values() for rule in rules for symbol in rule if symbol not in GRAMMAR and symbol != "insert" for k in range(16)}

Item = tuple[str, tuple[str, ...], int, int]  # head, rule, dot, origin


class Chart:
    """The Earley sets of a row of codes, after a phrase ``before`` that ended where they start."""

    def __init__(self, codes: str, before: str = "B") -> None:
        self.sets: list[dict[Item, Value]] = [{} for _ in range(len(codes) + 1)]
        self.waiting: list[dict[str, list[Item]]] = [{} for _ in range(len(codes) + 1)]
        for head in PHRASES:
            for rule in GRAMMAR[head]:
                self._offer(0, (head, rule, 0, 0), (0, ""))
        self._offer(0, (before, (), 0, 0), (0, ""))
        for at in range(len(codes) + 1):
            self._close(at, codes[at] if at < len(codes) else None)

    def _offer(self, at: int, item: Item, value: Value, agenda: list[Item] | None = None) -> None:
        """Puts a derivation of ``item`` into a set, if it is its best one."""
        known = self.sets[at].get(item)
        if known is None or value < known:
            self.sets[at][item] = value
            if agenda is not None:
                agenda.append(item)

    def _close(self, at: int, code: str | None) -> None:
        """Predicts, scans and completes until no item of the set gets better."""
        here, waiting = self.sets[at], self.waiting[at]
        agenda = list(here)
        while agenda:
            item = agenda.pop()
            head, rule, dot, origin = item
            cost, audit = here[item]
            if dot == len(rule):
                for other in self.waiting[origin].get(head, ()):
                    c, a = self.sets[origin][other]
                    self._offer(at, (other[0], other[1], other[2] + 1, other[3]), (c + cost, a + audit), agenda)
                continue
            symbol, after = rule[dot], (head, rule, dot + 1, origin)
            if symbol == "insert":
                self._offer(at, after, (cost + INSERT, audit + "I"), agenda)
            elif symbol in GRAMMAR:
                line = waiting.setdefault(symbol, [])
                if item not in line:
                    line.append(item)
                if symbol not in PHRASES:  # phrases start at the beginning only
                    for choice in GRAMMAR[symbol]:
                        self._offer(at, (symbol, choice, 0, at), (0, ""), agenda)
                for other, (c, a) in list(here.items()):
                    if other[0] == symbol and other[3] == at and other[2] == len(other[1]):
                        self._offer(at, after, (cost + c, audit + a), agenda)
            elif code is not None and (step := _SCANS[symbol, code]):
                self._offer(at + 1, after, (cost + step[0], audit + step[1]))

    def ends(self) -> dict[str, Value]:
        """The best derivation of each phrase over all rows."""
        best: dict[str, Value] = {}
        for (head, rule, dot, origin), value in self.sets[-1].items():
            if head in PHRASES and dot == len(rule) and origin == 0 and (head not in best or value < best[head]):
                best[head] = value
        return best


@lru_cache(maxsize=1 << 14)
def chart_text(codes: str, first: bool) -> str:
    """The chart of a chunk as text: illegal neighbours, first and last initial, then (before, after, cost, audit) of each derivation."""
    initials = "".join(INITIALS[(ord(c) - 65) // 4] for c in codes)
    illegal = sum(pair not in _LEGAL for pair in zip(initials, initials[1:], strict=False))
    entries = [f"{q}{p}{cost}{audit}" for q in ("B" if first else PHRASES) for p, (cost, audit) in Chart(codes, q).ends().items()]
    return " ".join([f"{illegal}{initials[0]}{initials[-1]}", *entries])


_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_ENTRY = re.compile(r"([BSHP])([BSHP])([0-9]+)([DIKR]*)")


class Composed:
    """Charts of consecutive chunks, composed one after the other."""

    def __init__(self) -> None:
        self.best: dict[str, Value] = {"B": (0, "")}
        self.illegal, self.last = 0, None

    def add(self, text: str) -> None:
        head, *entries = text.split(" ")
        self.illegal += int(head[:-2]) + (self.last is not None and (self.last, head[-2]) not in _LEGAL)
        self.last = head[-1]
        best: dict[str, Value] = {}
        for before, after, cost, audit in (_ENTRY.fullmatch(e).groups() for e in entries):
            if before in self.best:
                c, a = self.best[before]
                value = (c + int(cost), a + audit)
                if after not in best or value < best[after]:
                    best[after] = value
        self.best = best

    def repair(self) -> Value:
        """Cost and audit of the repair: nothing, or whole pairs."""
        return min(self.best[p] for p in "BP" if p in self.best)


class Digest:
    """The SHA-256 of a repaired conversation, from its audit and its rows in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.turns, self.sha = audit, 0, 0, hashlib.sha256()
        self.odd = (len(audit) - audit.count("D")) % 2  # a system turn leads

    def _add(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.turns else ''}{role}:{text}".encode())
        self.turns += 1

    def _due(self) -> str:
        return "assistant" if (self.turns - self.odd) % 2 else "user"

    def _insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._add(self._due(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._add(self._due() if edit == "R" else role, text)

    def hexdigest(self) -> str:
        self._insertions()
        return self.sha.hexdigest()


def _charts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [chart_text(c, f) for c, f in zip(batch["codes"].to_pylist(), batch["first"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["chunk"], pa.array(texts, pa.string())], ["conv_id", "chunk", "chart"])


_REPAIRED = "conv_id long, illegal long, cost long, audit string, repaired_sha256 string"


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from its charts and then its rows, in order."""
    nothing = object()
    now, charts, digest = nothing, None, None

    def result() -> tuple:
        cost, audit = charts.repair()
        return now, charts.illegal, cost, audit, (digest or Digest(audit)).hexdigest()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _REPAIRED.split(", ")])

    for batch in batches:
        done = []
        for conv_id, chart, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "chart", "role", "text")), strict=True):
            if now is nothing or conv_id != now:
                if now is not nothing:
                    done.append(result())
                now, charts, digest = conv_id, Composed(), None
            if chart is not None:
                charts.add(chart)
                continue
            digest = digest or Digest(charts.repair()[1])
            digest.row(role, text)
        yield out(done)
    if now is not nothing:
        yield out([result()])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the checksum of id and turn chooses."""
    space = F.lit(" ")
    named = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.encode(F.concat(named("conv_id"), F.lit(":"), named("turn")), "UTF-8")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), named("role").alias("role"), named("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _same() -> Column:
    """A digest that equal roles and texts share."""
    return F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256); see the contract of the query."""
    rows = damaged(conversations).withColumn("same", _same())
    initial = F.substring("role", 1, 1)
    place_of = F.lit(3)
    for i, letter in enumerate(INITIALS[:3]):
        place_of = F.when(initial == letter, i).otherwise(place_of)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    # texts stay behind from here; the order of rows needs their digests only
    small = in_ranges(rows.select("conv_id", "turn", "same", place_of.alias("initial"), F.when(blank, 1).when(cut, 3).otherwise(0).alias("fault")), ["conv_id", "turn", "same"])
    firsts = small.groupBy("conv_id", "same").agg(F.min("_place").alias("_place")).select("_place", F.lit(True).alias("new"))
    known = small.join(firsts, "_place", "left").withColumn("fault", F.when((F.col("fault") != 1) & F.col("new").isNull(), 2).otherwise(F.col("fault")))
    code = F.char(F.lit(65) + 4 * F.col("initial") + F.col("fault"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", code.alias("code")))), lambda x: x["code"]), "")
    counts = [F.count_if(F.col("fault") == i).alias(name) for i, name in enumerate(FAULTS) if name]
    # a chunk whose first row isn't at a multiple of its size starts a conversation
    chunks = known.groupBy("conv_id", F.shiftright("_place", CHUNK.bit_length() - 1).alias("chunk")).agg(ordered.alias("codes"), (F.min("_place") % CHUNK != 0).alias("first"), *counts)
    chunks = written(chunks)
    charts = chunks.select("conv_id", "chunk", "codes", "first").mapInArrow(_charts, "conv_id long, chunk long, chart string")

    none = lambda kind: F.lit(None).cast(kind)
    stream = charts.select("conv_id", "chunk", none("long").alias("turn"), none("string").alias("same"), "chart", none("string").alias("role"), none("string").alias("text"))
    stream = stream.unionByName(rows.select("conv_id", F.lit((1 << 63) - 1).alias("chunk"), "turn", "same", none("string").alias("chart"), "role", "text"))
    ended = stream.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "turn", "same").mapInArrow(_repairs, _REPAIRED)

    turns = small.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    faults = chunks.groupBy("conv_id").agg(*[F.sum(name).alias(name) for name in FAULTS if name])
    parts = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (turns, faults, ended):
        parts = parts.unionByName(part, allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    texts = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return parts.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], *[F.coalesce(F.max(c), F.lit(v)).alias(c) for c, v in texts.items()])

