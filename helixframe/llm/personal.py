"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns (e-mail, ip, card, phone; leftmost and non-overlapping per kind, failing
matches dropped) give the base spans. A semi-Markov field then reads the islands of text
that can hold personal data: maximal stretches of digits and their separators, and
addresses written around an at-sign or the words at and dot. A segment is either one token
outside or a whole candidate span with a kind, of at most ``MAX_TOKENS`` tokens; its score
is a weight vector times features of the whole span (digit groups, separators, checksum,
octets, cue words before it, neighbours). Dynamic programming over segment ends picks
boundaries and kinds jointly. Its spans are added where they touch no base span.

Candidates lie inside one island and islands don't touch, so decoding islands one by one
gives the same answer as decoding the whole text, in time linear in its length.

The weights are the maximum-likelihood fit (gradient ascent on the exact segment marginals)
to seeded sentences made here, with decoys: dates, versions, amounts, hexadecimal keys,
numbers whose checksum fails. Null and empty texts have no spans; repeated rows give equal
results; an empty table an empty one; columns beside key and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 40
#: Signs before a span that its features read.
BEFORE = 30

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # a local part holds no at-sign, so each one has at most one match
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(n := x.lstrip("0")) <= 3 and int(n or "0") <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_AT = r"(?:@|\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s|\s?[\[({]\.[\])}]\s?)"
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}", re.I)
_ADDRESS_SIGN = re.compile(_AT, re.I)  # a part of every match of _ADDRESS
_TOP = re.compile(r"[A-Za-z]{2,}|xn--[A-Za-z0-9-]+", re.I)
_NUMBERS = re.compile(r"(?:\+|\((?=[0-9]))?[0-9](?:[ ().\-/\[\]‐-―]{0,3}[0-9])+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_CUES = {
    "phone": re.compile(r"(?:tel|phone|call|mobile|mob|fax|cell|dial|whatsapp|handy|telefon|téléphone|teléfono)\W{0,3}(?:\w{1,6}\W{1,2}){0,2}$", re.I),
    "email": re.compile(r"(?:mail|contact|write|reach|courriel|correo)\W{0,3}(?:\w{1,6}\W{1,2}){0,2}$", re.I),
    "card": re.compile(r"(?:card|visa|mastercard|credit|karte|carte|tarjeta)\W{0,3}(?:\w{1,6}\W{1,2}){0,2}$", re.I),
    "ip": re.compile(r"(?:ip|host|server|address|from|ping)\W{0,3}(?:\w{1,6}\W{1,2}){0,2}$", re.I),
    "decoy": re.compile(r"(?:order|invoice|version|id|no|nr|ref|isbn|page|token|since|year|total|§)\W{0,3}(?:\w{1,6}\W{1,2}){0,1}$", re.I),
}


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold a candidate, apart from each other and in order."""
    found = []
    if _DIGIT.search(text):
        found = [(m.start(), m.end()) for m in _NUMBERS.finditer(text) if m.end() - m.start() >= 7]
    if _ADDRESS_SIGN.search(text):
        found += [(m.start(), m.end()) for m in _ADDRESS.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Taken:
    """Stretches of a text that base spans hold, merged and in order."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in spans:  # by start
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        """Whether any of them shares a sign with [a, b)."""
        k = bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b


def candidates(text: str, a: int, b: int, taken: Taken | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, tuple[str, ...]]]]:
    """Tokens of the island, and its candidate segments that touch nothing taken: first token, end token, kind, features."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
    segments = []
    number = [text[s] in "0123456789" for s, _ in tokens]
    out_left = lambda s: s == 0 or not (text[s - 1].isalnum() or text[s - 1] in "_@")
    out_right = lambda e: e == len(text) or not (text[e].isalnum() or text[e] in "_@")
    for i, (s, _) in enumerate(tokens):
        c = text[s]
        if c in "(+" or number[i]:
            if not out_left(s) or (c not in "(+" and s and text[s - 1] == "+"):
                continue
            digits = groups = 0
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                if number[j]:
                    digits += tokens[j][1] - tokens[j][0]
                    groups += 1
                    if digits > 19:
                        break
                    if digits >= 4 and out_right(tokens[j][1]):
                        e = tokens[j][1]
                        if 7 <= digits <= 15:
                            segments.append((i, j + 1, "phone"))
                        if 12 <= digits <= 19:
                            segments.append((i, j + 1, "card"))
                        if groups == 4 and c not in "(+":
                            segments.append((i, j + 1, "ip"))
                elif text[tokens[j][0]].isalpha():
                    break
    first, last = {t[0]: k for k, t in enumerate(tokens)}, {t[1]: k for k, t in enumerate(tokens)}
    for m in _ADDRESS.finditer(text, a, b):
        i, j = first.get(m.start()), last.get(m.end())
        if i is not None and j is not None and j - i < MAX_TOKENS:
            segments.append((i, j + 1, "email"))
    free = [x for x in segments if not (taken and taken.touches(tokens[x[0]][0], tokens[x[1] - 1][1]))]
    return tokens, [(i, j, kind, features(text, tokens[i][0], tokens[j - 1][1], kind)) for i, j, kind in free]


def features(text: str, s: int, e: int, kind: str) -> tuple[str, ...]:
    """Names of the features of the whole span, all of the kind."""
    return _features(text[max(0, s - BEFORE) : s], text[s:e], text[e : e + 2], kind)


@lru_cache(maxsize=1 << 16)
def _features(before: str, span: str, after: str, kind: str) -> tuple[str, ...]:
    """The same by what they depend on; a text dense in candidates repeats itself."""
    out = ["bias"]
    if kind == "email":
        out.append("at sign" if "@" in span else "bracketed at" if re.search(r"[\[({<]\s?at", span, re.I) else "word at")
        tail = re.split(r"[^A-Za-z0-9-]+", span)[-1]
        out.append("tail of letters" if tail.isalpha() and 2 <= len(tail) <= 6 else "odd tail")
        if out[1] == "word at":  # as prose has it: at 4.50, at U.S. ports, at home.Then
            if not _TOP.fullmatch(tail):
                out.append("word at, tail no name")
            elif tail.istitle():
                out.append("word at, tail begins a sentence")
        if " " in re.sub(r"(?i)\s?(?:[\[({<]\s?)?\b(?:at|dot)\b(?:\s?[\])}>])?\s?", "", span):
            out.append("blank inside")
    else:
        digits, groups = _only_digits(span), re.findall("[0-9]+", span)
        seps = re.sub("[0-9]", "", span)
        out.append("groups " + "-".join(str(len(g)) for g in groups) if len(groups) <= 6 else "many groups")
        out.append(f"{len(digits)} digits")
        out.append("separators " + ("none" if not seps else "mixed" if len(set(seps) - set("()+ ")) > 1 else "".join(sorted(set(seps)))))
        if kind == "card":
            out.append("checksum holds" if luhn(digits) else "checksum fails")
        if kind == "ip":
            out.append("octets" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "no octets")
            out.append("dotted" if re.fullmatch(r"\d+(?:(?:\.|\[\.\]|\(\.\))\d+){3}", span) else "not dotted")
        if span[0] == "+":
            out.append("plus")
        if "(" in span:
            out.append("brackets match" if re.match(r"\+?[0-9 ]{0,4}\(\d{2,5}\)", span) and span.count("(") == 1 else "brackets odd")
        if re.search("[0-9] [0-9]", span) and re.search("[-./]", span):
            out.append("blank and other separators")
        if before[-1:] and before[-1] in ".-/+[" or len(after) == 2 and after[0] in "-/." and after[1].isdigit():
            out.append("goes on outside")
    for name, cue in _CUES.items():
        if cue.search(before):
            out.append(f"cue {name}")
    return tuple(f"{kind}: {x}" for x in out)


class Field:
    """Weights, and exact inference over the segments of an island."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def _ends(self, n: int, segments: list, scores: list[float]) -> list[list[tuple[int, int, float]]]:
        """For each end: (start, segment or -1, score); outside tokens score 0."""
        ends: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            ends[j].append((j - 1, -1, 0.0))
        for k, (i, j, _, _) in enumerate(segments):
            ends[j].append((i, k, scores[k]))
        return ends

    def score(self, names: tuple[str, ...]) -> float:
        return sum(self.weights.get(x, 0.0) for x in names)

    def decode(self, n: int, segments: list) -> list[int]:
        """Indices of the segments of the best segmentation, in order."""
        scores = [self.score(s[3]) for s in segments]
        if not any(x > 0 for x in scores):
            return []
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        for arcs in self._ends(n, segments, scores)[1:]:
            best.append(max(((best[i][0] + x, i, k) for i, k, x in arcs), key=lambda b: (b[0], -b[1])))
        out, j = [], n
        while j:
            _, i, k = best[j]
            if k >= 0:
                out.append(k)
            j = i
        return out[::-1]

    def marginals(self, n: int, segments: list) -> list[float]:
        """Probability of each segment."""
        scores = [self.score(s[3]) for s in segments]
        ends = self._ends(n, segments, scores)
        plus = lambda v: (m := max(v)) + math.log(sum(math.exp(x - m) for x in v))
        forward = [0.0]
        for arcs in ends[1:]:
            forward.append(plus([forward[i] + x for i, _, x in arcs]))
        into: list[list[float]] = [[] for _ in range(n + 1)]
        backward = [0.0] * (n + 1)
        for j in range(n, 0, -1):
            if j < n:
                backward[j] = plus(into[j])
            for i, _, x in ends[j]:
                into[i].append(backward[j] + x)
        return [math.exp(forward[i] + s + backward[j] - forward[n]) for (i, j, _, _), s in zip(segments, scores)]

    def fit(self, examples: list, rounds: int = 40, rate: float = 0.5, shrink: float = 0.002) -> Field:
        """AdaGrad on the penalised likelihood. ``examples``: (tokens, segments, indices of true segments)."""
        seen: dict[str, float] = defaultdict(lambda: 1e-8)
        w: dict[str, float] = defaultdict(float)
        self.weights = w
        for _ in range(rounds):
            for n, segments, true in examples:
                g: dict[str, float] = defaultdict(float)
                for k, p in enumerate(self.marginals(n, segments)):
                    d = (k in true) - p
                    if abs(d) > 1e-6:
                        for x in segments[k][3]:
                            g[x] += d
                for x, d in g.items():
                    d -= shrink * w[x]
                    seen[x] += d * d
                    w[x] += rate * d / math.sqrt(seen[x])
        self.weights = dict(w)
        return self


def examples(count: int = 900, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Seeded sentences with their true spans, decoys among them."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 9)))

    def card(ok: bool = True) -> str:
        while True:
            body = d(r.choice([15, 15, 15, 14, 12]))
            full = next(body + c for c in "0123456789" if luhn(body + c) == ok)
            if full[0] != "0":
                return full

    def grouped(x: str, sep: str) -> str:
        return sep.join(x[k : k + 4] for k in range(0, len(x), 4))

    octets = lambda: [str(r.randint(0, 255)) for _ in range(4)]
    true = {
        "phone": [
            lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}",
            lambda: f"+{d(2)} {d(2)} {d(4)} {d(4)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"+{r.randint(1, 99)}{d(10)}", lambda: f"0{d(3)}/{d(6)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
        ],
        "card": [lambda: card(), lambda: grouped(card(), " "), lambda: grouped(card(), "-"), lambda: grouped(card(), "."), lambda: [card(), card()]],
        "ip": [lambda: ".".join(octets()), lambda: "[.]".join(octets())],
        "email": [
            lambda: f"{word()}.{word()}@{word()}.com", lambda: f"{word()} at {word()} dot com", lambda: f"{word()}{d(2)} (at) {word()} (dot) org",
            lambda: f"{word()}[at]{word()}.net", lambda: f"{word()} [at] {word()} [dot] {word()} [dot] de", lambda: f"{word()}@{word()} dot io",
        ],
    }
    decoys = [
        lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1950, 2030)}", lambda: f"{r.randint(1, 9)}.{d(1)}.{d(2)}",
        lambda: f"{d(1)} {d(3)} {d(3)}", lambda: card(False), lambda: grouped(card(False), " "), lambda: f"{d(8)}", lambda: f"{d(7)}", lambda: f"{d(10)}", lambda: f"{d(13)}", lambda: f"{r.randint(1900, 2020)}-{r.randint(1900, 2020)}",
        lambda: f"{r.randint(300, 999)}.{d(3)}.{d(3)}.{d(3)}", lambda: " ".join(d(2) for _ in range(6)), lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: f"{word()} at {word()}, dot {word()}", lambda: f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}", lambda: f"{d(1)}, {d(1)}, {d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(3)}-{d(4)}-{d(5)}-{d(3)}",
    ]
    cues = {"phone": ["tel: ", "call me on ", "phone "], "card": ["card ", "visa: "], "ip": ["host ", "from "], "email": ["mail ", "contact: "]}
    out = []
    for _ in range(count):
        text, spans = word(), []
        for _ in range(r.randint(1, 3)):
            text += " " + " ".join(word() for _ in range(r.randint(0, 4))) + " "
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                if r.random() < 0.4:
                    text += r.choice(cues[kind])
                made = r.choice(true[kind])()  # two cards side by side are a list
                parts = [made] if isinstance(made, str) else made
                for k, part in enumerate(parts):
                    text += " " * (k > 0)
                    spans.append((kind, len(text), len(text) + len(part)))
                    text += part
            else:
                if r.random() < 0.3:
                    text += r.choice(["order ", "version ", "ref ", "token = ", "since "])
                text += r.choice(decoys)()
            text += r.choice([" ", ". ", ", ", "!! "])
        out.append((text + word(), spans))
    return out


def prose(count: int = 120, seed: int = 12) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Seeded sentences with the word "at" before something with a point in it: addresses, and what is none."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 9)))
    number = lambda: str(r.randint(0, 99))
    none = [lambda: f"{number()}.{number()}", lambda: f"{number()}.{number()}{r.choice(['am', 'pm', 'h'])}", lambda: f"{r.choice('ABCDU')}.{r.choice('ABCDS')}", lambda: f"{word()}.{word().title()}"]
    true = [lambda: f"{word()}.{r.choice(['com', 'org', 'net', 'de'])}", lambda: f"{word()}[.]{r.choice(['com', 'org', 'info'])}"]
    for k in range(count):
        head, name = f"{word()} {word()} ", word()
        span = f"{name} at {r.choice(true if k % 2 else none)()}"
        out.append((f"{head}{span} {word()}", [("email", len(head), len(head) + len(span))] if k % 2 else []))
    return out


@lru_cache(maxsize=2)
def trained(count: int = 900, seed: int = 11) -> Field:
    data = []
    for text, spans in examples(count, seed) + prose():
        for a, b in islands(text):
            tokens, segments = candidates(text, a, b)
            if segments:
                at = {(tokens[i][0], tokens[j - 1][1], kind): k for k, (i, j, kind, _) in enumerate(segments)}
                true = {at[s, e, kind] for kind, s, e in spans if (s, e, kind) in at}
                data.append((len(tokens), segments, true))
    return Field().fit(data)


def find(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, each by start, then kind."""
    base = base_spans(text)
    taken, added = Taken(base), []
    for a, b in islands(text):
        tokens, segments = candidates(text, a, b, taken)  # base spans stand; the field segments what they leave
        if segments:
            for k in field.decode(len(tokens), segments):
                i, j, kind, _ = segments[k]
                added.append((kind, tokens[i][0], tokens[j - 1][1]))
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]))) if added else base


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal(df: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    weights = (field or trained()).weights

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        f = Field(weights)
        both = [find(t, f) for t in texts]
        made = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in both] for k in KINDS}
        made["base_sha256"] = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in both]
        made["spans"] = [_joined(x) for _, x in both]
        return made

    schema = f"`{key}` {dict(df.dtypes)[key]}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_texts(df.select(key, text), work, schema, text)


def mask_personal(df: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """All columns, with every span in ``text`` replaced; null texts stay null. ``n_chars`` follows, where there is one."""
    weights = (field or trained()).weights

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        f = Field(weights)
        null = batch.column(text).is_null().to_pylist()
        return {text: [None if n else masked(t, find(t, f)[1]) for t, n in zip(texts, null)]}

    out = map_texts(df, work, df.schema, text)
    return out.withColumn("n_chars", F.length(text).cast(out.schema["n_chars"].dataType)) if "n_chars" in df.columns else out


def op4_semi_markov_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"))
