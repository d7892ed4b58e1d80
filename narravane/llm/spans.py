"""Spans of text that finders report: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]


def ordered(spans: Iterable[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def outside(spans: Iterable[Span], taken: Iterable[Span]) -> list[Span]:
    """The spans that overlap none of ``taken``."""
    starts, reach, far = [], [], 0
    for _, start, end in sorted(taken, key=lambda x: x[1]):
        far = max(far, end)
        starts.append(start)
        reach.append(far)
    # those that start before the end of a span: none may reach beyond its start
    return [x for x in spans if not (k := bisect_left(starts, x[2])) or reach[k - 1] <= x[1]]


def replaced(text: str, spans: Iterable[Span], mark: Callable[[str], str]) -> str:
    """``text`` with each group of overlapping spans replaced by the mark of its first kind."""
    out, at, reach = [], 0, -1
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= reach:
            out += [text[at:start], mark(kind)]
            at = reach = end
        elif end > reach:
            at = reach = end
    return "".join(out) + text[at:]


def report(docs: DataFrame, finder: Callable[[], Callable[[str], tuple[list[Span], list[Span]]]], base: tuple[str, ...], more: tuple[str, ...]) -> DataFrame:
    """Counts and digests of the spans in each text; a null text counts as empty.

    ``finder`` makes, once a task, a function from a text to its base spans and added spans.
    ``more``: kinds of added spans that are no base kinds.
    """
    kinds = (*base, *more)
    counts = [f"n_{k}" for k in kinds] if more else [f"n_{k}" for k in base] + ["n_added"]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = finder()
        nothing = hashlib.sha256(b"").hexdigest()
        for frame in frames:
            rows = []
            for text in frame["text"].tolist():
                own, added = find(text) if text else ([], [])
                if not own and not added:
                    rows.append([0] * len(counts) + [nothing, ""])
                    continue
                own = ordered(own, kinds)
                n = [sum(s[0] == k for s in own) for k in base]
                n += [sum(s[0] == k for s in added) for k in more] if more else [len(added)]
                rows.append([*n, hashlib.sha256(joined(own).encode()).hexdigest(), joined(ordered([*own, *added], kinds))])
            out = pd.DataFrame(rows, columns=[*counts, "base_sha256", "spans"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)


def redacted(docs: DataFrame, finder: Callable[[], Callable[[str], tuple[list[Span], list[Span]]]], mark: Callable[[str], str]) -> DataFrame:
    """``docs`` with the found spans of ``text`` replaced; ``n_chars``, where there is one, follows the text."""
    schema = docs.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = finder()
        for frame in frames:
            texts = frame["text"].tolist()
            new = [replaced(t, [s for part in find(t) for s in part], mark) if t else t for t in texts]
            yield frame.assign(text=new)

    out = docs.mapInPandas(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)).select(docs.columns)
    return out
