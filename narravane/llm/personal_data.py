"""Personal data: fixed patterns, and a semi-Markov conditional random field for the forms they miss.

The field scores whole candidate segments (their digits, groups, separators,
check digits, and the words around them) and a dynamic programme over bounded
segments chooses boundaries and types together.  It finds telephone numbers
without a leading plus sign, spelled-out mail addresses, card numbers set in
unusual groups and the like.  Spans of the fixed patterns always stay; the
field adds spans that overlap none of them.

Only windows around digits, at signs and spelled-out at signs are decoded, so
plain prose costs one scan.  The model is trained on generated sentences, whose
number and seed are parameters; no corpus row is needed.

Cases: null and empty texts have no spans; repeated rows get equal results;
very long texts are scanned whole; other input columns are ignored (report) or
kept (redaction).
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache, partial

from pyspark.sql import DataFrame

from narravane.llm.spans import Span, outside, redacted, report

KINDS = ("email", "ip", "card", "phone")
#: Tokens of the longest segment.
LONGEST = 17
#: Characters of context on each side of a trigger.
REACH = 48
#: Generated training sentences and passes over them.
TRAIN_SENTENCES, PASSES = 700, 6

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping for each kind, without those that fail their test."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() >= 12 else ""
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- segments and their features ---

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[ \t]+|.", re.S)
_TRIGGER = re.compile(r"[0-9]+|@|[\[({]\s?at\s?[\])}]|\bat\b(?=.{2,40}\bdot\b)", re.I)
_AT = re.compile(r"[\[({]\s?at\s?[\])}]|\bat\b", re.I)
_NUMERIC = set("-.()+/")
#: Fixed cue words by the kind that they announce.
CUES = {
    "phone": "phone telephone tel call fax mobile cell whatsapp sms ring dial hotline contact",
    "card": "card visa mastercard amex credit debit payment pan cc",
    "ip": "ip address host server addr ping dns gateway",
    "email": "mail email e-mail write contact send address reach",
    "not": "order invoice isbn version page ref reference date year id serial sku chapter section part number item row build total",
}
_CUE = {word: kind for kind, words in CUES.items() for word in words.split()}


class Window:
    """Tokens of a stretch of text and the candidate segments in it."""

    def __init__(self, text: str, low: int, high: int) -> None:
        self.spans = [m.span() for m in _TOKEN.finditer(text, low, high)]
        self.tokens = [text[s:e] for s, e in self.spans]
        self.text = text

    def candidates(self) -> list[tuple[int, int, str, list[str]]]:
        """(first token, end token, kind, features) of each segment that could be an entity."""
        out, tokens, n = [], self.tokens, len(self.tokens)
        for i in range(n):
            first = tokens[i]
            if first[0].isdigit() or first in "+(":
                out += self._numeric(i)
            if first[0].isalnum() and (i == 0 or not tokens[i - 1][0].isalnum()):
                out += self._mail(i)
        return out

    def _context(self, i: int, j: int) -> list[str]:
        words = [w for w in re.findall(r"[^\W\d_]+", self.text[max(0, self.spans[i][0] - 40) : self.spans[i][0]].lower())[-3:]]
        cues = {_CUE[w] for w in words if w in _CUE}
        left = self.tokens[i - 1] if i else " "
        right = self.tokens[j] if j < len(self.tokens) else " "
        return [*(f"cue={c}" for c in cues), *(["no cue"] if not cues else []), f"left={_shape(left)}", f"right={_shape(right)}"]

    def _numeric(self, i: int):
        tokens, n = self.tokens, len(self.tokens)
        groups: list[str] = []
        marks = ""
        for j in range(i, min(n, i + LONGEST)):
            t = tokens[j]
            if t[0].isdigit():
                groups.append(t)
                digits = "".join(groups)
                if len(digits) > 19:
                    return
                if len(digits) >= 7 or len(groups) == 4:
                    follows = j + 1 < n and tokens[j + 1][0].isdigit()
                    f = self._context(i, j + 1) if not follows else []
                    shape = "-".join(str(len(g)) for g in groups) if len(groups) <= 5 else "many"
                    common = [f"shape={shape}", f"digits={len(digits)}", f"marks={''.join(sorted(set(marks)))}", *f]
                    pure = marks == "..." and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
                    if len(groups) == 4:
                        yield i, j + 1, "ip", [*common, f"octets={pure}"]
                    if 7 <= len(digits) <= 15:
                        yield i, j + 1, "phone", [*common, f"first={tokens[i][0] if tokens[i] in '+(' else 'digit'}", f"zero={digits[0] == '0'}"]
                    if 12 <= len(digits) <= 19:
                        yield i, j + 1, "card", [*common, f"luhn={luhn(digits)}", f"issuer={digits[0] in '3456'}"]
            elif t in _NUMERIC or (t[0] in " \t" and len(t) <= 2):
                marks += t[0]
            else:
                return

    def _mail(self, i: int):
        tokens, n = self.tokens, len(self.tokens)
        stop = min(n, i + LONGEST)
        begin = self.spans[i][0]
        for j in range(i + 2, stop):
            if not tokens[j][0].isalpha() or len(tokens[j]) < 2:
                continue
            part = self.text[begin : self.spans[j][1]]
            at = "@" if "@" in part else None
            if at is None:
                m = _AT.search(part)
                if not m or m.start() == 0:
                    continue
                at = m[0]
            local, _, domain = part.partition(at)
            plain = not re.search(r"\s", local.strip()) or bool(re.search(r"\bdot\b", local, re.I))
            host = re.sub(r"\s*[\[({]?\s?\bdot\b\s?[\])}]?\s*", ".", domain.strip(), flags=re.I)
            whole = bool(re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", host))
            if not whole and " " in host:
                return
            ends = j + 1 == n or tokens[j + 1] not in ".-" or j + 2 >= n or not tokens[j + 2][0].isalnum()
            last = host.rpartition(".")[2]
            yield (
                i, j + 1, "email",
                [f"at={'sign' if at == '@' else 'bracket' if at[0] in '[({' else 'word'}", f"local={plain}", f"host={whole}", f"ends={ends}",
                 f"tld={2 <= len(last) <= 6}", f"dotted={'dot' in domain.lower()}", *self._context(i, j + 1)],
            )


def _shape(token: str) -> str:
    c = token[0]
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "#$@%.,:-/" else "mark"


class SegmentField:
    """A semi-Markov conditional random field: weights of (kind, feature); other tokens score 0."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = weights or {}

    def scored(self, window: Window) -> list[tuple[int, int, str, list[str], float]]:
        w = self.weights
        return [(i, j, k, f, w.get(k, 0.0) + sum(w.get(f"{k}|{x}", 0.0) for x in f)) for i, j, k, f in window.candidates()]

    def decode(self, window: Window) -> list[tuple[int, int, str]]:
        """The best segmentation's entities."""
        n = len(window.tokens)
        ending: dict[int, list] = {}
        for c in self.scored(window):
            if c[4] > 0:
                ending.setdefault(c[1], []).append(c)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, _, kind, _, score in ending.get(j, ()):
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, kind)
        out, j = [], n
        while j:
            if back[j]:
                out.append((back[j][0], j, back[j][1]))
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def marginals(self, window: Window) -> tuple[list[tuple[int, int, str, list[str], float]], float]:
        """Probability of each candidate segment, and the log of the partition function."""
        n, cands = len(window.tokens), self.scored(window)
        ending, starting = {}, {}
        for c in cands:
            ending.setdefault(c[1], []).append(c)
            starting.setdefault(c[0], []).append(c)
        a, b = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            a[j] = _logsum([a[j - 1], *(a[c[0]] + c[4] for c in ending.get(j, ()))])
        for i in range(n - 1, -1, -1):
            b[i] = _logsum([b[i + 1], *(b[c[1]] + c[4] for c in starting.get(i, ()))])
        return [(*c[:4], math.exp(a[c[0]] + c[4] + b[c[1]] - a[n])) for c in cands], a[n]

    def fit(self, sentences: list[tuple[str, list[Span]]], passes: int = PASSES, rate: float = 0.5, shrink: float = 1e-4) -> SegmentField:
        """Maximum conditional likelihood by AdaGrad, one sentence at a time."""
        total: dict[str, float] = {}
        for _ in range(passes):
            for text, gold in sentences:
                grad: dict[str, float] = {}
                for low, high in windows(text):
                    window = Window(text, low, high)
                    truth = set(gold)
                    for i, j, kind, features, p in self.marginals(window)[0]:
                        delta = ((kind, window.spans[i][0], window.spans[j - 1][1]) in truth) - p
                        if abs(delta) > 1e-4:
                            for name in (kind, *(f"{kind}|{x}" for x in features)):
                                grad[name] = grad.get(name, 0.0) + delta
                for name, g in grad.items():
                    g -= shrink * self.weights.get(name, 0.0)
                    total[name] = total.get(name, 0.0) + g * g
                    self.weights[name] = self.weights.get(name, 0.0) + rate * g / math.sqrt(total[name] + 1e-6)
        return self


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around what could be part of an entity; they end at line breaks."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        if m[0].isdigit() and m.end() - m.start() == 1 and not _near_digit(text, m.start()):
            continue
        low = max(0, m.start() - REACH, text.rfind("\n", 0, m.start()) + 1)
        while 0 < low < m.start() and text[low - 1].isalnum() and text[low].isalnum():
            low += 1
        high = text.find("\n", m.end(), m.end() + REACH)
        high = high if high >= 0 else min(len(text), m.end() + REACH)
        while m.end() < high < len(text) and text[high - 1].isalnum() and text[high].isalnum():
            high -= 1
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _near_digit(text: str, at: int) -> bool:
    """Whether a single digit has others within a few characters, or stands in a word with an at sign."""
    around = text[max(0, at - 4) : at] + text[at + 1 : at + 5]
    return any(c in "0123456789@" for c in around)


# --- training sentences ---


def training_sentences(count: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Generated sentences with entities of each kind and look-alikes of none."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    syllables = "ba de ki lo mu ran tes vol an er in st the and of".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    sep = lambda: rng.choice(" -.")

    def card(valid: bool) -> str:
        while True:
            x = rng.choice("3456") + d(15)
            if luhn(x) == valid:
                return x

    def grouped(x: str, sizes: tuple[int, ...], s: str) -> str:
        out, at = [], 0
        for k in sizes:
            out.append(x[at : at + k])
            at += k
        return s.join(out)

    def phone() -> str:
        s, a, b, c = sep(), str(rng.randrange(2, 10)) + d(2), d(3), d(4)
        return rng.choice([
            f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}{s}{b}{s}{c}", f"1{s}{a}{s}{b}{s}{c}", f"+1 ({a}) {b}-{c}", f"+{d(2)} {a} {d(7)}",
            f"00{rng.randrange(30, 50)} {d(rng.choice([2, 3]))} {d(7)}", f"0{d(2)} {d(7)}", f"0{d(3)} {d(7)}", f"0{d(2)}/{d(8)}", f"0{d(4)}-{d(6)}", f"+{rng.randrange(30, 50)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"({a}){b}-{c}",
        ])

    def mail() -> str:
        local, host, tld = rng.choice([word(), f"{word()}.{word()}", word() + d(2)]), rng.choice([word(), "mail" + d(1), "example"]), rng.choice(["com", "org", "net", "de", "io"])
        spoken = local.replace(".", " dot ")
        return rng.choice([
            f"{local}@{host}.{tld}", f"{local} (at) {host}.{tld}", f"{local} [at] {host}.{tld}", f"{local}[at]{host}[dot]{tld}", f"{local} (at) {host} (dot) {tld}",
            f"{spoken} at {host} dot {tld}", f"{local} @ {host}.{tld}", f"{local} @ {host} . {tld}" if rng.random() < 0.2 else f"{local}(at){host}.{tld}",
        ])

    def positive() -> tuple[str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            return kind, mail()
        if kind == "ip":
            return kind, ".".join(str(rng.randrange(256)) for _ in range(4))
        if kind == "phone":
            return kind, phone()
        x = card(True)
        return kind, rng.choice([x, grouped(x, (4, 4, 4, 4), sep()), grouped(x, (4, 4, 4, 4), "  "), grouped(x, (4, 6, 5), " ") if rng.random() < 0.3 else grouped(x, (4, 4, 4, 4), "/")])

    def negative() -> str:
        return rng.choice([
            f"{rng.choice('ADFGNS')}{rng.choice('EBTLR')}{d(2)} " + grouped(d(18), (4, 4, 4, 4, 2), " "), f"{rng.choice('ADFGNS')}{rng.choice('EBTLR')}{d(20)}", f"+{d(rng.choice([4, 5, 6, 7]))}", f"+{d(1)}.{d(2)}%",
            f"{rng.randrange(1900, 2100)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}", f"{rng.randrange(10, 29)}.{rng.randrange(10, 13)}.{rng.randrange(1900, 2100)}", f"{rng.randrange(1900, 2030)}", f"{d(2)}:{d(2)}:{d(2)}",
            f"{d(2)}.{d(2)}%", f"${d(3)},{d(3)}.{d(2)}", f"{d(1)}.{d(1)}.{d(2)}.{d(4)}", f"#{d(8)}", d(rng.choice([5, 6, 7, 8, 9, 10, 11, 12])), card(False), grouped(card(False), (4, 4, 4, 4), sep()),
            f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"{d(3)} {d(3)}", f"{d(4)} {d(4)}", f"{d(2)}x{d(2)}", f"{word()} at {word()}", f"@{word()}", f"{word()}{d(3)}", f"{d(4)}-{d(4)} {word()}", f"{d(3)},{d(3)},{d(3)}", f"{word()} at {word()} dot", f"{d(1)} {d(1)} {d(2)} {d(2)} {d(1)} {d(3)}",
        ])

    cues = {k: v.split() for k, v in CUES.items()}
    out = []
    for _ in range(count):
        text, gold = " ".join(word() for _ in range(rng.randrange(0, 4))), []
        for _ in range(rng.randrange(1, 3)):
            if rng.random() < 0.5:
                kind, value = positive()
                cue = rng.choice(cues[kind]) if rng.random() < 0.4 else ""
            else:
                kind, value = "", negative()
                cue = rng.choice(cues["not"]) if rng.random() < 0.4 else ""
            lead = text + (" " if text else "") + (cue + rng.choice([" ", ": ", " no. "]) if cue else "")
            if kind:
                gold.append((kind, len(lead), len(lead) + len(value)))
            text = lead + value + rng.choice(["", ".", ",", " " + word(), " " + word() + "."])
        out.append((text, gold))
    return out


@lru_cache(maxsize=2)
def trained(sentences: int = TRAIN_SENTENCES, seed: int = 6) -> SegmentField:
    return SegmentField().fit(training_sentences(sentences, seed))


def finder(weights: dict[str, float]):
    """A function from a text to its base spans and its added spans."""
    field = SegmentField(weights)

    def find(text: str) -> tuple[list[Span], list[Span]]:
        base, added = base_spans(text), []
        for low, high in windows(text):
            window = Window(text, low, high)
            added += [(kind, window.spans[i][0], window.spans[j - 1][1]) for i, j, kind in field.decode(window)]
        return base, outside(added, base)

    return find


def personal_report(docs: DataFrame, model: SegmentField | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans) for each row of ``docs``."""
    return report(docs, partial(finder, (model or trained()).weights), KINDS, ())


def without_personal_data(docs: DataFrame, model: SegmentField | None = None) -> DataFrame:
    """``docs`` with each entity in ``text`` replaced by its kind in brackets."""
    return redacted(docs, partial(finder, (model or trained()).weights), lambda kind: f"[{kind.upper()}]")
