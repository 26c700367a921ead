"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Where a span may be that the base patterns do not see: runs of digits and what is written between them, and an "at".
NUMBER = re.compile(r"[0-9](?:[0-9 ()\[\]._/-]*[0-9])?")
AT = re.compile(r"(?i:\bat\b|[\[({<] ?(?:at|@) ?[\])}>])")
DOT = re.compile(r"(?i:\bdot\b)")
DOT_OR_MARK = re.compile(r"(?i:\bdot\b|\.)")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
#: Tokens of the longest entity, which bounds the dynamic programming, and most digits and groups of digits of one.
LONGEST, DIGITS, GROUPS = 18, 19, 8
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's pattern that hold what it asks, in order."""
    out: list[Span] = []
    if "@" in text:
        out += [(m.start(), m.end(), "email") for m in _emails(text)]
    if _DIGIT.search(text):
        out += [(a, b, "ip") for a, b in _ips(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text[a:b].split("."))]
        out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """What IP.finditer gives: each four groups in turn of a longest chain of groups, found in one pass."""
    for m in _CHAIN.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[k : k + 4])) + 3
            yield at, end
            at = end + 1


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[re.Match]:
    """What EMAIL.finditer gives, tried only where an @ follows local characters."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m
            free = m.end()
        at = text.find("@", max(at + 1, free))


@dataclass
class Token:
    text: str
    start: int
    end: int


def tokens(text: str, start: int, end: int) -> list[Token]:
    return [Token(m[0], m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]


def is_digits(token: str) -> bool:
    """0 to 9 alone; characters such as superscripts count as digits for str.isdigit too, but are none here."""
    return token.isascii() and token.isdigit()


def shape(token: str) -> str:
    low = token.lower()
    return low if low in ("at", "dot") else "D" if is_digits(token) else "W" if token.isalpha() else token


def allowed(kind: str, toks: list[Token]) -> bool:
    """What a span of the kind has to hold, whatever the features say."""
    groups = [t.text for t in toks if is_digits(t.text)]
    words = any(t.text.isalpha() for t in toks)
    if kind == "email":
        s = [shape(t.text) for t in toks]
        at = next((i for i, x in enumerate(s) if x in ("at", "@")), 0)
        closed = 0 < at < len(s) - 1 and s[at - 1] in "[({<" and s[at + 1] in "])}>"
        dots = ("dot", ".") if closed else ("dot",)
        return 0 < at and any(x in dots for x in s[at + 2 : -1]) and s[0] in "WD" and s[-1] == "W"
    if words or not groups or len(groups) > GROUPS:
        return False
    n = sum(map(len, groups))
    if kind == "ip":
        return len(groups) == 4 and len(toks) >= 7 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if kind == "card":
        return 13 <= n <= DIGITS and luhn("".join(groups))
    return 7 <= n <= 15 and 1 < len(groups) <= 6


def segment_features(toks: list[Token], i: int, j: int) -> list[str]:
    """Features of tokens i to j as one span, whatever its kind."""
    part = toks[i:j]
    groups = [str(len(t.text)) for t in part if is_digits(t.text)]
    gaps = {"_" if b.start > a.end else "" for a, b in zip(part, part[1:], strict=False)}
    marks = {t.text for t in part if not t.text.isalnum()}
    digits = sum(map(int, groups))
    out = ["bias", f"digits={digits}", f"groups={'-'.join(groups[:6])}", f"marks={''.join(sorted(marks))}{''.join(sorted(gaps))}", f"n={len(part)}", "shape=" + "".join(shape(t.text) for t in part[:9])]
    before, after = [t.text.lower() for t in toks[max(0, i - 2) : i]], toks[j].text.lower() if j < len(toks) else "$"
    out += [f"prev={x}" for x in before if x.isalpha()] + [f"left={before[-1] if before and not before[-1].isalnum() else 'W' if before else '^'}", f"right={after if not after.isalnum() else 'W'}"]
    if i and toks[i - 1].end == part[0].start:
        out.append("glued-left")
    if j < len(toks) and toks[j].start == part[-1].end and toks[j].text.isalnum():
        out.append("glued-right")
    if len(groups) == 4 and all(len(t.text) <= 3 and int(t.text) <= 255 for t in part if is_digits(t.text)):
        out.append("octets")
    return out


def segments(toks: list[Token]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(i, j, kinds) of the spans that may be an entity, at most LONGEST tokens long.

    A span of digits ends where it would hold a word, or more digits or groups than any kind has.
    """
    n, out = len(toks), []
    shapes = [shape(t.text) for t in toks]
    for i in range(n):
        if shapes[i] not in ("W", "D", "("):
            continue
        digits = groups = 0
        number, mail = True, False
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            x = shapes[j - 1]
            if x == "D":
                digits, groups = digits + len(toks[j - 1].text), groups + 1
                number = number and digits <= DIGITS and groups <= GROUPS
            elif x in ("W", "at", "dot"):
                number = False
            mail = mail or x in ("at", "@")
            if j < i + 2 or (not mail and digits < 7 and groups != 4) or x not in ("W", "D") or not (number or mail):
                if not (number or mail) and "at" not in shapes[j : i + LONGEST] and "@" not in shapes[j : i + LONGEST]:
                    break
                continue
            kinds = tuple(k + 1 for k, kind in enumerate(KINDS) if (mail if kind == "email" else number) and allowed(kind, toks[i:j]))
            if kinds:
                out.append((i, j, kinds))
    return out


class SemiMarkovCRF:
    """Scores of labelled segmentations: a weight for each feature and kind, and one for each pair of neighbours.

    Kind 0 is outside and spans one token. Decoding and the sums for training go over all segmentations whose
    entities are at most LONGEST tokens long, so boundaries and kinds are chosen together.
    """

    def __init__(self):
        self.names: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS) + 1))
        self.moves = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def lattice(self, toks: list[Token], learn: bool = False, taken: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int, tuple[int, ...], np.ndarray]]:
        """All spans and their features; no entity touches what is ``taken``."""
        out = []
        plain = [(i, i + 1, (0,)) for i in range(len(toks))]
        blocked = np.zeros(len(toks) + 1, np.int64)
        starts, ends = [t.start for t in toks], [t.end for t in toks]
        for a, b in taken:
            blocked[bisect_right(ends, a) + 1 : bisect_left(starts, b) + 1] = 1
        blocked = np.cumsum(blocked).tolist()
        for i, j, kinds in plain + segments(toks):
            if kinds != (0,) and blocked[j] > blocked[i]:
                continue
            names = segment_features(toks, i, j) if kinds != (0,) else ["out", "out=" + shape(toks[i].text)]
            if learn:
                for x in names:
                    self.names.setdefault(x, len(self.names))
            out.append((i, j, kinds, np.array([self.names[x] for x in names if x in self.names], np.int64)))
        return sorted(out, key=lambda s: (s[1], s[0]))

    def scores(self, lattice: list) -> list[np.ndarray]:
        return [self.weights[f].sum(axis=0) for _, _, _, f in lattice]

    def decode(self, toks: list[Token], taken: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int, int]]:
        """(i, j, kind) of the entities of the best segmentation."""
        n, labels = len(toks), len(KINDS) + 1
        best = np.full((n + 1, labels), -np.inf)
        best[0, 0] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        lattice = self.lattice(toks, taken=taken)
        for (i, j, kinds, _), score in zip(lattice, self.scores(lattice), strict=True):
            for y in kinds:
                come = best[i] + self.moves[:, y]
                p = int(come.argmax())
                if come[p] + score[y] > best[j, y]:
                    best[j, y] = come[p] + score[y]
                    back[j, y] = (i, p)
        out, at = [], (n, int(best[n].argmax()))
        while at[0] > 0:
            i, p = back[at]
            if at[1]:
                out.append((i, at[0], at[1]))
            at = (i, p)
        return out[::-1]

    def fit(self, examples: list[tuple[list[Token], dict[tuple[int, int], int]]], epochs: int = 5, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> SemiMarkovCRF:
        """Stochastic gradient ascent of the log-likelihood; the sums are by the forward and backward recursions."""
        labels = len(KINDS) + 1
        made = [(self.lattice(toks, True), len(toks), gold) for toks, gold in examples]
        self.weights = np.zeros((len(self.names), labels))
        rng = np.random.default_rng(seed)
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for e in rng.permutation(len(made)):
                lattice, n, gold = made[e]
                score = self.scores(lattice)
                ahead, behind = np.full((n + 1, labels), -np.inf), np.full((n + 1, labels), -np.inf)
                ahead[0, 0], behind[n] = 0.0, 0.0
                for (i, j, kinds, _), s in zip(lattice, score, strict=True):
                    for y in kinds:
                        ahead[j, y] = np.logaddexp(ahead[j, y], np.logaddexp.reduce(ahead[i] + self.moves[:, y]) + s[y])
                for (i, j, kinds, _), s in zip(reversed(lattice), reversed(score), strict=True):
                    for y in kinds:
                        behind[i] = np.logaddexp(behind[i], self.moves[:, y] + s[y] + behind[j, y])
                total = np.logaddexp.reduce(ahead[n])
                inside = {k for a, b in gold for k in range(a, b)}
                label_at = {b: y for (_, b), y in gold.items()}
                push = np.zeros_like(self.moves)
                for (i, j, kinds, f), s in zip(lattice, score, strict=True):
                    for y in kinds:
                        pair = np.exp(ahead[i] + self.moves[:, y] + s[y] + behind[j, y] - total)
                        true = gold.get((i, j), -1) == y if y else i not in inside
                        self.weights[f, y] += step * (float(true) - pair.sum())
                        push[:, y] -= pair
                        if true:
                            push[label_at.get(i, 0), y] += 1
                self.moves += step * push
                self.weights *= 1 - step * decay
        return self


def examples(n: int = 1200, seed: int = 17) -> list[tuple[list[Token], dict[tuple[int, int], int]]]:
    """Made-up labelled texts: personal data as people write it to be overlooked, and numbers that are none."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9)))
    num = lambda k: "".join(rng.choice(list("0123456789"), k))
    one = lambda *x: x[rng.integers(len(x))]

    def card() -> str:
        head = one("4", "5", "37", "6011") + num(11)
        digits = next(head + str(c) for c in range(10) if luhn(head + str(c)))
        return one(".", "/", "_", " . ").join(digits[k : k + 4] for k in range(0, len(digits), 4))

    def email() -> str:
        at, dot = one((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), (" at ", " dot "), (" at ", " dot "), ("(at)", "(dot)"), ("[@]", "[.]"), (" AT ", " DOT "), ("[at]", "."))
        return f"{word()}{one('', '.' + word(), num(2))}{at}{word()}{dot}{one('com', 'org', 'net', 'de', 'co' + dot + 'uk')}"

    def ip() -> str:
        return one("[.]", " . ", "(.)", "[.]").join(str(rng.integers(1, 256)) for _ in range(4))

    def phone() -> str:
        return one(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)}/{num(7)}", f"00{num(2)} {num(3)} {num(7)}", f"1-{num(3)}-{num(3)}-{num(4)}")

    lead = {"email": ("mail", "write to", "contact", "e-mail:", ""), "ip": ("from", "server", "host", "ip", ""), "card": ("card", "visa", "charged to", "card:", ""), "phone": ("call", "tel", "phone:", "fax", "ring", "")}
    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    none = (
        lambda: f"on {num(4)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}", lambda: f"version {num(1)}.{num(2)}.{num(1)}.{num(3)}-{num(4)}", lambda: f"order {num(8)}", lambda: f"total {num(1)},{num(3)},{num(3)}.{num(2)}",
        lambda: f"isbn 978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"pages {num(3)}-{num(3)} of {num(4)}", lambda: f"he looked at the {word()} dot on it", lambda: f"id {num(12)}", lambda: f"{num(4)}/{num(4)} and {num(3)}/{num(3)}",
        lambda: f"on 20{num(2)}.{num(2)}.{num(2)}.{num(4)}", lambda: f"{num(2)}.{num(2)}.20{num(2)} {num(2)}.{num(2)}", lambda: f"20{num(2)}/{num(2)}/{num(2)}-{num(4)}", lambda: f"we met at the {word()} and a dot was there", lambda: f"look at {word()} {word()} , not at the dot in {word()}",
        lambda: f"rows {num(1)} {num(1)} {num(1)} {num(1)} {num(1)} {num(1)}", lambda: f"{num(3)}.{num(3)}.{num(3)} euro", lambda: f"{one('version', 'v', 'build', 'rev')} {num(1)}.{num(1)}.{num(1)}.{num(4)}-{num(4)}", lambda: f"{one('isbn', 'ISBN', 'issn')} {one('978-', '979-', '')}{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"release {num(1)}.{num(1)}.{num(2)}.{num(1)}", lambda: f"from {num(4)}-{num(4)} to {num(4)}-{num(4)}", lambda: f"token {num(6)} {word()} {num(9)}", lambda: f"sizes {num(2)} {num(2)} {num(3)} {num(2)}", lambda: f"section {num(1)}.{num(1)}.{num(1)} {num(4)}",
    )
    out = []
    for k in range(n):
        text, gold = one("", f"{word()} ", f"{word()} {word()} "), []
        for _ in range(rng.integers(1, 3)):
            if rng.random() < 0.5:
                text += one(*none)() + f" {word()}{one('', ',', '.')} "
                continue
            kind = KINDS[rng.integers(len(KINDS))]
            text += (one(*lead[kind]) + " ").lstrip()
            span = make[kind]()
            gold.append((len(text), len(text) + len(span), KINDS.index(kind) + 1))
            text += span + one("", f" {word()} ", f", {word()} ", f". {word()} ")
            if text[-1] != " ":
                break
        toks = tokens(text, 0, len(text))
        starts, ends = {t.start: i for i, t in enumerate(toks)}, {t.end: i + 1 for i, t in enumerate(toks)}
        spans = {(starts[a], ends[b]): y for a, b, y in gold}
        if all(y in dict(((i, j), kinds) for i, j, kinds in segments(toks)).get(s, ()) for s, y in spans.items()):
            out.append((toks, spans))
    return out


@functools.cache
def trained(n: int = 1200) -> SemiMarkovCRF:
    """The field fitted on at most ``n`` made-up texts."""
    return SemiMarkovCRF().fit(examples(n))


def areas(toks: list[Token], text: str, taken: Sequence[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of tokens to decode: LONGEST on either side of where a span may be, those that overlap as one.

    That is a run of seven digits or four groups at least that base spans do not cover whole, and an "at" with a "dot"
    among the tokens after it.
    """
    starts = [t.start for t in toks]
    cues = []
    for m in NUMBER.finditer(text):
        k = max(0, bisect_left(taken, (m.start(),)) - 1)
        covered = any(a <= m.start() and m.end() <= b for a, b in taken[k : k + 2])
        if not covered and (sum(c.isdigit() for c in m[0]) >= 7 or len(re.findall("[0-9]+", m[0])) >= 4):
            cues.append((bisect_left(starts, m.start()), bisect_left(starts, m.end())))
    for m in AT.finditer(text):
        i = bisect_left(starts, m.start())
        last = toks[min(len(toks), i + LONGEST) - 1].end
        if (DOT if m[0].isalpha() else DOT_OR_MARK).search(text, m.end(), last):
            cues.append((i, i + 1))
    begin = end = 0
    for i, j in sorted(cues):
        i, j = max(0, i - LONGEST), min(len(toks), j + LONGEST)
        if end and i <= end:
            end = max(end, j)
            continue
        if end:
            yield begin, end
        begin, end = i, j
    if end:
        yield begin, end


def clusters(toks: list[Token]) -> Iterator[tuple[int, int]]:
    """Where spans that may be entities overlap, with two tokens on either side; all other tokens are outside for sure."""
    begin = end = -1
    for i, j, _ in segments(toks):
        i, j = max(0, i - 2), min(len(toks), j + 2)
        if i < end:
            end = max(end, j)
            continue
        if end > 0:
            yield begin, end
        begin, end = i, j
    if end > 0:
        yield begin, end


def added_spans(text: str, base: list[Span], model: SemiMarkovCRF) -> list[Span]:
    """Spans that the field finds in ``areas`` and that touch no base span."""
    if not (NUMBER.search(text) or AT.search(text)):
        return []
    taken = sorted((a, b) for a, b, _ in base)
    toks = tokens(text, 0, len(text))
    out: list[Span] = []
    for i0, j0 in areas(toks, text, taken):
        for lo, hi in clusters(toks[i0:j0]):
            part = toks[i0 + lo : i0 + hi]
            near = taken[bisect_left(taken, (part[0].start,)) - 1 if taken and taken[0][0] < part[0].start else 0 : bisect_left(taken, (part[-1].end,))]
            for i, j, y in model.decode(part, near):
                start, end = part[i].start, part[j - 1].end
                if not (out and start < out[-1][1]):
                    out.append((start, end, KINDS[y - 1]))
    return out


def span_batches(model: SemiMarkovCRF):
    """mapInArrow function: (id, text) to (id, spans)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = added_spans(text, base, model) if text else []
                found = [(*s, True) for s in base] + [(*s, False) for s in more]
                found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append([{"kind": k, "start": a, "end": b, "base": x} for a, b, k, x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "spans"])

    return run


def find(docs: DataFrame, model: SemiMarkovCRF | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): personal data in every whole text, as kind, start, end (code points, end exclusive) and base.

    Base spans are the exact patterns' matches. The field adds spans of the same kinds as people write them to be
    overlooked; those never overlap a base span, have at most LONGEST tokens, and stand where ``areas`` says: numbers
    of seven digits or four groups, and an "at" with a "dot" after it. Spans are sorted by start, then kind as in KINDS.
    Null and empty texts have none. A row for each input row; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(span_batches(model or trained()), f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>").withColumnRenamed("id", id_col)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in ``documents``: numbers and digest of the base spans, and all spans."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
