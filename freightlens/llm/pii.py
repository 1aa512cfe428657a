"""Personal data: exact base patterns, and a semi-Markov conditional random field beside them.

The field scores whole candidate segments, not single tokens: digit counts,
check sums, shapes, octets and cue words belong to a span as a whole. Dynamic
programming over the tokens of a zone then chooses boundaries and kinds
together; a segment has at most ``LONGEST`` tokens. Every entity has an at-sign
(plain or spelled out), at least seven digits in at most ``MOST_GROUPS`` numbers, or is four numbers joined by dots
(plain, bracketed or spaced), of any number of digits; zones without these hold
none and only the others are decoded. The field is trained here, by
conditional likelihood, on written-out examples of every kind, of spellings
that the base patterns miss and of numbers that are no personal data.

The base spans always stay. Spans of the field are added where they overlap no
base span.
"""

from __future__ import annotations

import math
import random
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
LONGEST = 24
#: Numbers in a segment of digits at most: a phone number of country, area and four pairs has six.
MOST_GROUPS = 6
EXAMPLES = 1000
ROUNDS = 12

# Fixed patterns of the contract. The address's name is sought leftwards from each at-sign, and an ip only where its
# first number begins: both give the same leftmost matches, in time linear in the longest of texts.
EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]")
_NUMBER = re.compile("[0-9]+")
_NUMBER_BEFORE = re.compile(r"[0-9]([\s,;|/.-]{1,3})$")
_NUMBER_AFTER = re.compile(r"([\s,;|/.-]{1,3})[0-9]")
_BETWEEN = re.compile(r"(?<=[0-9])[^0-9]+(?=[0-9])")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.S)
_DIGITS_ZONE = re.compile(r"\+?[(\[]?[0-9](?:[ ().\[\]-]{0,3}[0-9]){6,}")
_DOTTED_ZONE = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\]| \. )[0-9]{1,3}){3,}(?![0-9])")
_AFTER_AT = re.compile(r"@[^\s@]*")
_NAME = re.compile(r"[\w.%+-]")
# what may stand from a spelled at-sign on: a bracketed one, or a bare one whose dots are spelled: " at " and "." alone are
# prose. The name before it is sought leftwards from the sign. Labels of a host have at most 63 characters by its standard.
_SPELLED_HOST = re.compile(
    r"(?:(?:\(at\)|\[at\]) ?[\w-]{1,63} ?(?:\(dot\)|\[dot\]| dot |\.) ?[\w-]{1,63}| at ?[\w-]{1,63}(?: ?\. ?[\w-]{1,63})* ?(?:\(dot\)|\[dot\]| dot ) ?[\w-]{1,63})"
    r"(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[\w-]{1,63})*"
)
_SPELLED_SIGNS = ("(at)", "[at]", "(dot)", "[dot]", " dot ")
_SPELLED_AT = re.compile(r"\(at\)|\[at\]| at ")
_SPELLED_DOT = re.compile(r" ?[\[(]?dot\b")
_OCTETS = re.compile(r"([0-9]{1,3})(?:\.|\[\.\]| \. )([0-9]{1,3})(?:\.|\[\.\]| \. )([0-9]{1,3})(?:\.|\[\.\]| \. )([0-9]{1,3})")
_LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
# Fixed words that stand before entities.
CUES = {
    "email": ("email", "mail", "write", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "paid"),
    "phone": ("call", "tel", "phone", "fax", "mobile"),
}
_CUE = {word: kind for kind, words in CUES.items() for word in words}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def email_spans(text: str) -> list[Span]:
    """Leftmost addresses that don't overlap."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in EMAIL_NAME:
            begin -= 1
        host = EMAIL_HOST.match(text, at) if begin < at else None
        if host:
            last = host.end()
            out.append(("email", begin, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then by start; code points, end exclusive."""
    out: list[Span] = []
    if "@" in text:
        out += email_spans(text)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches of the text that can hold an entity, in order and disjoint."""
    found = []
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin and not text[begin - 1].isspace() and text[begin - 1] != "@":
            begin -= 1
        found.append((begin, _AFTER_AT.match(text, at).end()))
        at = text.find("@", at + 1)
    if any(sign in text for sign in _SPELLED_SIGNS):
        for sign in _SPELLED_AT.finditer(text):
            host = _SPELLED_HOST.match(text, sign.start())
            begin = name = sign.start() - (text[sign.start() - 1 : sign.start()] == " ") if host else 0
            while begin and _NAME.match(text, begin - 1):
                begin -= 1
            if begin < name:
                found.append((begin, host.end()))
    if _DIGIT.search(text):
        found += [m.span() for m in _DIGITS_ZONE.finditer(text)]
        if "." in text:
            found += [m.span() for m in _DOTTED_ZONE.finditer(text)]
    out: list[list[int]] = []
    for s, e in sorted(found):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def segment_features(text: str, start: int, end: int) -> list[str]:
    """Features of the whole span text[start:end]."""
    span = text[start:end]
    digits = "".join(_DIGIT.findall(span))
    shape = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", "9", span))[:24]
    found = ["bias", f"digits={min(len(digits), 20)}", f"shape={shape}"]
    if 16 <= len(digits) <= 19:
        found.append("luhn" if luhn(digits) else "no luhn")
    if (m := _OCTETS.fullmatch(span)) is not None:
        found.append("octets" if all(int(p) <= 255 for p in m.groups()) else "no octets")
    if "@" in span:
        found.append("at" if span.count("@") == 1 else "ats")
    elif _SPELLED_AT.search(span):
        found.append("spelled at")
    if re.search(r"(?:\.|dot[)\] ] ?)[^\W\d_]{2,}$", span):
        found.append("top domain")
    if span[0] == "+":
        found.append("plus")
    if _LOCAL_PHONE.fullmatch(span):
        found.append("local phone")
    if not (span[0].isalnum() or span[0] in "+(") or not span[-1].isalnum():
        found.append("odd edge")
    if text[start - 1 : start].isalnum() or text[start - 1 : start] in ("+", "@") or (text[start - 1 : start] in (".", "_", "%", "-") and text[start - 2 : start - 1].isalnum()):
        found.append("cut left")
    if text[end : end + 1].isalnum() or text[end : end + 1] == "@" or (text[end : end + 1] in (".", "-", "[") and text[end + 1 : end + 2].isalnum()):
        found.append("cut right")
    if _SPELLED_DOT.match(text, end):
        found.append("goes on")
    if digits and "@" not in span:
        groups = [len(g) for g in _NUMBER.findall(span)]
        found.append("groups=" + "-".join(map(str, groups)))
        if len(groups) > 2 and max(groups) < 3:
            found.append("short groups")
        before, after = _NUMBER_BEFORE.search(text[max(0, start - 4) : start]), _NUMBER_AFTER.match(text, end)
        found += ["number before"] * bool(before) + ["number after"] * bool(after)
        inner = _BETWEEN.findall(span)
        if (before and before[1] in inner) or (after and after[1] in inner):  # one of a row of numbers
            found += ["in a row", "in a row, " + ("luhn" if "luhn" in found else f"digits={min(len(digits), 20)}")]
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 16) : start].lower())
    if before and before[-1] in _CUE:
        found.append("cue=" + _CUE[before[-1]])
    return found


class Zone:
    """Token edges of a stretch of text, and running counts over its tokens that tell candidate segments."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text = text
        self.edges = array("q", [start, *(m.end() for m in _TOKEN.finditer(text, start, end))])
        self.digits, self.groups, self.at, self.dots = (array("q", [0]) for _ in range(4))
        self.joint: list[str] = [""] * len(self.edges)  # of a number's first edge and of the edge after a number: what joins it to its neighbour
        last = -1
        for k, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            number = text[a].isascii() and text[a].isdigit()
            self.digits.append(self.digits[-1] + (b - a) * number)
            self.groups.append(self.groups[-1] + number)
            self.at.append(self.at[-1] + (text[a:b] in ("@", "at")))
            self.dots.append(self.dots[-1] + (text[a] == "."))
            if number:
                if last >= 0 and a - self.edges[last] <= 3:
                    self.joint[last] = self.joint[k] = text[self.edges[last] : a]
                last = k + 1

    def ending(self, j: int) -> Iterator[int]:
        """First tokens of the candidate segments that end before token j: one at-sign, 7 to 19 digits in at most ``MOST_GROUPS`` numbers, or fewer digits with three dots."""
        text, edges = self.text, self.edges
        if text[edges[j] - 1].isspace():
            return
        for i in range(max(0, j - LONGEST), j):
            if text[edges[i]].isspace():
                continue
            digits = self.digits[j] - self.digits[i]
            # the middle of a row of numbers that are all joined alike is no candidate
            if (joint := self.joint[i]) and joint == self.joint[j] and joint in self.joint[i + 1 : j]:
                continue
            if self.at[j] - self.at[i] == 1 or (7 <= digits <= 19 and self.groups[j] - self.groups[i] <= MOST_GROUPS) or (4 <= digits < 7 and self.dots[j] - self.dots[i] == 3):
                yield i


def segments(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """Token edges of a zone and its candidate segments (first token, one past the last, features)."""
    zone = Zone(text, start, end)
    edges = list(zone.edges)
    return edges, [(i, j, segment_features(text, edges[i], edges[j])) for j in range(1, len(edges)) for i in zone.ending(j)]


def decode(weights: dict[str, list[float]], text: str, start: int, end: int) -> list[Span]:
    """The best segmentation of a zone; tokens outside segments score zero.

    A candidate is scored when the program comes to its end, and forgotten; of each token the best segment that ends there is kept.
    """
    zone = Zone(text, start, end)
    edges = zone.edges
    best, begin, label = array("d", [0.0]), array("q", [0]), array("b", [-1])
    for j in range(1, len(edges)):
        top = (best[j - 1], j - 1, -1)
        for i in zone.ending(j):
            score = [sum(c) for c in zip(*(weights[n] for n in segment_features(text, edges[i], edges[j]) if n in weights), strict=True)]
            if score and best[i] + (most := max(score)) > top[0]:
                top = (best[i] + most, i, score.index(most))
        best.append(top[0])
        begin.append(top[1])
        label.append(top[2])
    out, j = [], len(edges) - 1
    while j:
        i, kind = begin[j], label[j]
        if kind >= 0:
            out.append((KINDS[kind], edges[i], edges[j]))
        j = i
    return out[::-1]


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Written-out training texts with their spans."""
    r = random.Random(seed)

    def number(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def word() -> str:
        return "".join(r.choice("aeionrtslh") for _ in range(r.randint(2, 8)))

    def card_number() -> str:
        head = "4" + number(14)
        return next(head + d for d in "0123456789" if luhn(head + d))

    def email() -> str:
        user = word() + r.choice(["", "." + word(), "." + number(2), "_" + word()])
        host = word() + r.choice(["", number(1)]) + r.choice(["", "." + word()])
        top = r.choice(["com", "org", "net", "de", "fr", "es"])
        return r.choice([f"{user}@{host}.{top}"] * 4 + [f"{user} [at] {host} [dot] {top}", f"{user} (at) {host} (dot) {top}", f"{user} at {host} dot {top}", f"{user} (at) {host}.{top}"])

    def ip() -> str:
        return r.choice([".", ".", ".", "[.]"]).join(str(r.randint(1, 255)) for _ in range(4))

    def card() -> str:
        c = card_number()
        return r.choice([c, c, r.choice(" -.").join(c[i : i + 4] for i in range(0, 16, 4))])

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}"])

    def numbers() -> str:
        sizes = r.choice([(1, 1), (2, 2), (1, 2), (1, 3), (2, 3), (3, 3), (1, 4), (4, 4), (4, 4), (2, 5), (3, 5)])
        return r.choice([" ", " ", " ", ", ", "-", " - ", "; ", " | ", "  "]).join(number(r.randint(*sizes)) for _ in range(r.choice([3, 4, 5, 6, 7, 8, 10, 12, 20])))

    def other() -> str:
        if r.random() < 0.4:
            return numbers()
        long = number(16)
        return r.choice([
            long if not luhn(long) else long[:-1] + str((int(long[-1]) + 1) % 10), number(r.randint(7, 12)), number(r.randint(20, 24)),
            f"20{number(2)}-0{r.randint(1, 9)}-1{number(1)}", f"{number(1)}.{number(1)}.{number(2)}.{number(3)}.{number(2)}",
            ".".join(str(r.randint(256, 999)) for _ in range(4)), f"{number(1)} {number(3)} {number(3)}", f"{number(3)}.{number(3)}.{number(3)}",
            f"@{word()}", f"{word()}@{word()}", f"{number(4)}-{number(4)}", f"{number(3)} {number(4)}", f"({number(2)}) {number(6)}",
            f"{number(2)} {number(2)} {number(4)} {number(5)}", "-".join(number(4) for _ in range(3)),
        ])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = word() + " ", []
        for _ in range(r.randint(1, 2)):
            kind = r.choice([*KINDS, "", "", ""])
            item = makers[kind]() if kind else other()
            if r.random() < 0.25:
                text += r.choice(CUES[kind or r.choice(KINDS)]) + r.choice([" ", ": "])
            if kind:
                spans.append((kind, len(text), len(text) + len(item)))
            text += item + r.choice([" ", ", ", ". ", " | ", "!! ", "\n"]) + word() + " "
        out.append((text, spans))
    return out


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


@lru_cache(maxsize=2)
def train(n: int = EXAMPLES, rounds: int = ROUNDS, rate: float = 0.4, ridge: float = 1e-3) -> dict[str, list[float]]:
    """Weights by feature, one for each kind: stochastic ascent of the conditional likelihood."""
    zoned = []
    for text, spans in examples(n):
        for s, e in zones(text):
            edges, candidates = segments(text, s, e)
            gold = {(edges.index(a), edges.index(b)): KINDS.index(kind) for kind, a, b in spans if a in edges and b in edges}
            zoned.append((len(edges), candidates, gold))
    weights = {name: [0.0] * len(KINDS) for _, candidates, _ in zoned for _, _, names in candidates for name in names}
    squares = {name: [1e-2] * len(KINDS) for name in weights}
    order = random.Random(1)
    for _ in range(rounds):
        order.shuffle(zoned)
        for n_edges, candidates, gold in zoned:
            scores = [[sum(weights[f][k] for f in names) for k in range(len(KINDS))] for _, _, names in candidates]
            ends: dict[int, list[int]] = {}
            begins: dict[int, list[int]] = {}
            for c, (i, j, _) in enumerate(candidates):
                ends.setdefault(j, []).append(c)
                begins.setdefault(i, []).append(c)
            alpha, beta = [0.0] * n_edges, [0.0] * n_edges
            for j in range(1, n_edges):
                alpha[j] = _log_sum([alpha[j - 1]] + [alpha[candidates[c][0]] + v for c in ends.get(j, ()) for v in scores[c]])
            for i in range(n_edges - 2, -1, -1):
                beta[i] = _log_sum([beta[i + 1]] + [beta[candidates[c][1]] + v for c in begins.get(i, ()) for v in scores[c]])
            for c, (i, j, names) in enumerate(candidates):
                for k in range(len(KINDS)):
                    slope = (gold.get((i, j)) == k) - math.exp(alpha[i] + scores[c][k] + beta[j] - alpha[-1])
                    if abs(slope) > 1e-4:
                        for f in names:
                            g = slope - ridge * weights[f][k]
                            squares[f][k] += g * g
                            weights[f][k] += rate * g / math.sqrt(squares[f][k])
    return weights


def find(text: str, weights: dict[str, list[float]]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans (base and added), each by kind as listed, then by start."""
    base = base_spans(text)
    starts, ends = [], []  # what base spans cover, as disjoint stretches
    for s, e in sorted((s, e) for _, s, e in base):
        if starts and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    added = []
    for s, e in zones(text):
        for span in decode(weights, text, s, e):
            at = bisect_left(starts, span[2]) - 1
            if at < 0 or ends[at] <= span[1]:
                added.append(span)
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def written(spans: list[Span]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame) -> DataFrame:
    """Personal data of every row of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id``, the counts ``n_email``, ``n_ip``, ``n_card`` and
    ``n_phone`` of base spans, ``base`` and ``spans`` (written out by kind, then
    start; code points, end exclusive) and ``n_added``. Null and empty texts have none.
    Repeated rows and null ids are kept; other columns are ignored; an empty
    table gives no rows.
    """
    weights = train()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list] = [[] for _ in range(7)]
            for text in batch.column(1):
                base, spans = find(text.as_py() or "", weights)
                kinds = [k for k, _, _ in base]
                for column, value in zip(counts, [*(kinds.count(k) for k in KINDS), written(base), written(spans), len(spans) - len(base)], strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(counts, types, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, schema)


def masked(text: str, weights: dict[str, list[float]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    _, spans = find(text, weights)
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars`` (if there) recounted.

    All rows and columns stay; a null text stays null.
    """
    weights = train()

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else masked(t, weights))

    out = docs.withColumn("text", mask(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: personal data of every document; counts are of base spans."""
    found = detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_added")
