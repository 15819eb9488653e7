"""Operator 11, personal data: a semi-Markov conditional random field over candidate regions, beside fixed base patterns.

The base patterns are searched in every whole text; what they find stays. The method adds spans: a text's regions (digit
groups with few separators between them, and surroundings of an @ or of what stands for one) are cut into atoms (digit
runs, letter runs, single characters). A segmentation gives every atom to O or to an entity of bounded length; entities are
scored as whole spans (digits, grouping, checksum, parts, neighbours, cue words), and dynamic programming chooses
boundaries and types of a region at once. Atoms of base spans are closed to it.

The weights are trained by conditional likelihood (forward-backward over segments) on base spans of a bounded sample of
the corpus, on spans drawn by rule, and on rewritten forms of both (other separators, spelled-out signs, several entities
in a row), against numbers that are none: failing checksums, dates, versions, tables. No labels are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents of the fitting sample, and windows of each kind that are taken from them, at most.
SAMPLE_DOCS, SAMPLE_WINDOWS = 20_000, 250
#: Bounds of an added entity: atoms, characters, characters of a local part, digit groups (one less without a plus).
MOST_ATOMS, MOST_CHARS, REACH, MOST_GROUPS = 24, 64, 64, 6
EPOCHS, RATE, RIDGE = 12, 0.25, 1e-4

# --- base patterns

_DIGITS = re.compile("[0-9]+")
_LOCAL = re.compile("[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that fails from the start of a digit run fails from within it too, so that runs are entered at their start only
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """By their @ signs, in time linear in the text: the local part is what stands before, back to the last match."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield "email", start, found.end()
        done = at = found.end() if found else at + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the base patterns, by kind and start."""
    out = list(_emails(text))
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_fits(p) for p in m[0].split("."))]
        for kind, pattern, low, high in (("card", _CARD, 16, 19), ("phone", _PHONE, 8, 15)):
            for m in pattern.finditer(text):
                digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 4096 else "0" * 4096
                if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                    out.append((kind, *m.span()))
    return out


# --- regions and candidates

_SEPARATORS = re.compile(r"[\x20().+/-]{0,3}\Z")
_MARK = re.compile(r" ?@ ?| ?(?:\[ ?at ?\]|\( ?at ?\)|(?<= )at(?= )) ?", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?\. ?| ?\[ ?dot ?\] ?| ?\( ?dot ?\) ?| dot )[A-Za-z0-9-]{1,63}){1,8}", re.I)
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
_WORD = re.compile(r"[A-Za-z]+(?=[^A-Za-z0-9]{0,3}\Z)")
CUES = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "host", "server", "address", "addr", "from"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "pan"},
    "phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "cell"},
}


def regions(text: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, email candidates): stretches of the text in which entities are looked for, in order and disjoint."""
    found: list[tuple[int, int, list]] = []
    start = end = digits = 0
    for m in _DIGITS.finditer(text):
        if digits and m.start() - end <= 3 and _SEPARATORS.match(text, end, m.start()):
            digits += m.end() - m.start()
        else:
            if digits >= 4:
                found.append((start, end, []))
            start, digits = m.start(), m.end() - m.start()
        end = m.end()
    if digits >= 4:
        found.append((start, end, []))
    # a sign or bracket that opens a number belongs to it
    found = [(s - 2 if text[max(s - 2, 0) : s] == "+(" else s - 1 if s and text[s - 1] in "+(" else s, e, c) for s, e, c in found]
    if "@" in text or any(d in text for d in ("dot", "DOT", "Dot")):
        for m in _MARK.finditer(text):
            host = _HOST.match(text, m.end())
            low = m.start()
            while low > 0 and m.start() - low < REACH and _LOCAL.match(text, low - 1):
                low -= 1
            if host and low < m.start():
                starts = [low + x.start() for x in _ATOM.finditer(text[low : m.start()]) if x[0].isalnum()]
                ends = [m.end() + x.end() for x in re.finditer("[A-Za-z0-9]+", host[0])]
                ends = [e for e in ends[1:] if _HOST.fullmatch(text, m.end(), e)]
                cands = [(s, e) for s in starts[:MOST_ATOMS] for e in ends if e - s <= 2 * MOST_CHARS]
                if cands:
                    found.append((low, host.end(), cands))
    merged: list[tuple[int, int, list]] = []
    for s, e, c in sorted(found, key=lambda x: x[:2]):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]), merged[-1][2] + c)
        else:
            merged.append((s, e, c))
    return merged


def _side(text: str, at: int, left: bool) -> str:
    """The kind of character beside a span; a dot or hyphen with a letter or digit behind it goes on."""
    if not 0 <= at < len(text):
        return "end"
    c = text[at]
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "letter"
    if c in ".-+@:/,_":
        after = at - 1 if left else at + 1
        return "on" if 0 <= after < len(text) and text[after].isalnum() else "stop"
    return "space" if c.isspace() else "other"


def features(text: str, kind: str, start: int, end: int) -> list[str] | None:
    """Names of the features of a span as a whole; None if it cannot be of this kind."""
    span = text[start:end]
    out = ["bias", "left " + _side(text, start - 1, True), "right " + _side(text, end, False)]
    cue = _WORD.search(text, max(0, start - 24), start)
    out.append("cue" if cue and cue[0].lower() in CUES[kind] else "no cue")
    groups = _DIGITS.findall(span)
    digits = sum(map(len, groups))
    if kind == "email":
        mark = _MARK.search(span)
        if mark is None:
            return None
        out.append("sign " + ("@" if mark[0] == "@" else " @ " if "@" in mark[0] else "[at]" if mark[0].strip()[0] in "[(" else "at"))
        host = re.split(r" ?\. ?| ?\[ ?dot ?\] ?| ?\( ?dot ?\) ?| dot ", span[mark.end() :], flags=re.I)
        dots = len(re.findall(r"dot[\]) ]", span[mark.end() :], re.I))
        out += ["dots spelled" if dots else "dots plain", f"signs and dots {mark[0] == '@'} {dots > 0} {' ' in span}"]
        out += ["top letters" if host[-1].isalpha() and 2 <= len(host[-1]) <= 6 else "top other", f"labels {min(len(host), 4)}"]
        return out
    if kind == "ip":
        if len(groups) != 4 or span != ".".join(groups):
            return None
        out += ["parts fit" if all(len(g) < 4 and int(g) < 256 for g in groups) else "parts too great"]
        out += ["zero before" if any(len(g) > 1 and g[0] == "0" for g in groups) else "plain parts", "small parts" if digits <= 6 else "long parts"]
        return out
    between = [s for s in _DIGITS.split(span)[1:-1]]
    opening = _DIGITS.split(span, maxsplit=1)[0]
    shape = "-".join(str(len(g)) for g in groups) if len(groups) <= 6 else "many"
    if kind == "card":
        if not 13 <= digits <= 19 or opening or any(s not in (" ", "-", ".") for s in between):
            return None
        out += [f"luhn {luhn(''.join(groups))}", f"digits {digits} luhn {luhn(''.join(groups))}", "separators " + ("none" if not between else "one" if len(set(between)) == 1 else "mixed")]
        out.append("groups " + ("one" if len(groups) == 1 else "fours" if all(len(g) == 4 for g in groups[:-1]) and len(groups) > 2 else "amex" if shape == "4-6-5" else "odd"))
        return out
    if not 7 <= digits <= 15 or opening not in ("", "+", "(", "+("):
        return None
    if span.count("(") != span.count(")") or any(not s.strip(" ().-") == "" or not s for s in between):
        return None
    out += ["plus" if "+" in opening else "bracket" if "(" in span else "bare", f"digits {digits}", f"groups {min(len(groups), 6)}"]
    kinds = {s.strip("() ") or " " for s in between}
    out.append("separators " + ("none" if not between else "one" if len(kinds) == 1 else "mixed"))
    out.append("tail " + "-".join(str(len(g)) for g in groups[-2:]) if len(groups) > 1 else "one group")
    out.append(f"{'plus' if '+' in opening else 'bare'} {'(' in span} {shape[-7:]}")
    return out


class Lattice:
    """A region's atoms and its candidate segments: what the dynamic programmes run over."""

    def __init__(self, text: str, region: tuple[int, int, list], closed: list[tuple[int, int]]) -> None:
        start, end, emails = region
        self.cuts = [start] + [m.end() for m in _ATOM.finditer(text, start, end)]
        at = {c: i for i, c in enumerate(self.cuts)}
        #: Whether an atom belongs to one of the ``closed`` spans.
        self.closed = [False] * (len(self.cuts) - 1)
        for s, e in closed:
            first = max(bisect_right(self.cuts, s) - 1, 0)
            for i in range(first, min(bisect_left(self.cuts, e, first), len(self.closed))):
                self.closed[i] = True
        n = len(self.cuts) - 1
        #: Features of each atom as O, and the candidates that end at each cut: (first atom, kind, feature names).
        self.outside = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            c = text[a]
            self.outside.append("O digits %d" % min(b - a, 8) if "0" <= c <= "9" else "O letters" if c.isalpha() else "O sign")
        self.ends: list[list[tuple[int, int, list[str]]]] = [[] for _ in range(n + 1)]

        def add(i: int, j: int, k: int) -> None:
            if not any(self.closed[i:j]):
                names = features(text, KINDS[k], self.cuts[i], self.cuts[j])
                if names is not None:
                    self.ends[j].append((i, k, [f"{KINDS[k]} {x}" for x in names]))

        for s, e in emails:
            if s in at and e in at:
                add(at[s], at[e], 0)
        digit = [o.startswith("O digits") for o in self.outside]
        for i in range(n):
            c = text[self.cuts[i]]
            if (digit[i] or c in "+(") and not self.closed[i]:
                total = groups = 0
                for j in range(i, min(i + MOST_ATOMS, n)):
                    if self.closed[j] or self.cuts[j + 1] - self.cuts[i] > MOST_CHARS or not (digit[j] or text[self.cuts[j]] in "+(). -"):
                        break
                    if digit[j]:
                        total += self.cuts[j + 1] - self.cuts[j]
                        groups += 1
                        if total > 19 or groups > (MOST_GROUPS if c == "+" else MOST_GROUPS - 1):
                            break
                        if digit[i] and groups == 4 and j == i + 6:
                            add(i, j + 1, 1)
                        if digit[i] and total >= 13:
                            add(i, j + 1, 2)
                        if 7 <= total <= 15:
                            add(i, j + 1, 3)

    @property
    def empty(self) -> bool:
        return not any(self.ends)


def _logsum(values: list[float]) -> float:
    most = max(values, default=-math.inf)
    return most if most == -math.inf else most + math.log(sum(math.exp(v - most) for v in values))


LABELS = len(KINDS) + 1  # the last is O
OUT = len(KINDS)


class Field:
    """Weights by feature name; ``x>y`` are those of neighbouring labels."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = weights or {}

    def _arcs(self, lat: Lattice) -> list[list[tuple[int, int, float, list[str]]]]:
        """By end: (first atom, label, score, features) of every segment, those of one atom outside among them."""
        w = self.weights.get
        out: list[list] = [[]]
        for j in range(1, len(lat.cuts)):
            o = lat.outside[j - 1]
            out.append([(j - 1, OUT, w(o, 0.0), [o])] + [(i, k, sum(w(f, 0.0) for f in names), names) for i, k, names in lat.ends[j]])
        return out

    def _next(self) -> list[list[float]]:
        return [[self.weights.get(f"{a}>{b}", 0.0) for b in range(LABELS)] for a in range(LABELS)]

    def best(self, lat: Lattice) -> list[tuple[int, int, int]]:
        """(kind, first atom, end) of the entities of the best segmentation; ties go to the one outside, then the shorter."""
        arcs, step = self._arcs(lat), self._next()
        score = [[-math.inf] * LABELS for _ in lat.cuts]
        back: list[list] = [[None] * LABELS for _ in lat.cuts]
        score[0][OUT] = 0.0
        for j in range(1, len(lat.cuts)):
            for i, k, s, _ in arcs[j]:
                for before in range(LABELS - 1, -1, -1):
                    v = score[i][before] + step[before][k] + s
                    if v > score[j][k]:
                        score[j][k], back[j][k] = v, (i, before)
        j, k = len(lat.cuts) - 1, max(range(LABELS - 1, -1, -1), key=lambda k: score[-1][k])
        out = []
        while j:
            i, before = back[j][k]
            if k != OUT:
                out.append((k, i, j))
            j, k = i, before
        return out[::-1]

    def gradient(self, lat: Lattice, gold: list[tuple[int, int, int]]) -> tuple[float, dict[str, float]]:
        """Log-likelihood of a segmentation, and its gradient: the gold features less the expected ones."""
        arcs, step = self._arcs(lat), self._next()
        n = len(lat.cuts) - 1
        alpha = [[-math.inf] * LABELS for _ in range(n + 1)]
        beta = [[-math.inf] * LABELS for _ in range(n + 1)]
        alpha[0][OUT] = 0.0
        for j in range(1, n + 1):
            into: list[list[float]] = [[] for _ in range(LABELS)]
            for i, k, s, _ in arcs[j]:
                into[k] += [alpha[i][b] + step[b][k] + s for b in range(LABELS) if alpha[i][b] > -math.inf]
            alpha[j] = [_logsum(x) for x in into]
        total = _logsum(alpha[n])
        beta[n] = [0.0] * LABELS
        grad: dict[str, float] = {}
        gather: list[list[list[float]]] = [[[] for _ in range(LABELS)] for _ in range(n + 1)]
        for j in range(n, 0, -1):
            if j < n:
                beta[j] = [_logsum(x) for x in gather[j]]
            for i, k, s, names in arcs[j]:
                if beta[j][k] == -math.inf:
                    continue
                for b in range(LABELS):
                    if alpha[i][b] > -math.inf:
                        gather[i][b].append(step[b][k] + s + beta[j][k])
                        p = math.exp(alpha[i][b] + step[b][k] + s + beta[j][k] - total)
                        if p > 1e-9:
                            for f in (*names, f"{b}>{k}"):
                                grad[f] = grad.get(f, 0.0) - p
        want = {(i, j): k for k, i, j in gold}
        named = {(i, j, k): names for j in range(1, n + 1) for i, k, _, names in arcs[j]}
        j, before, value = 0, OUT, 0.0
        ends = {i: j for _, i, j in gold}
        while j < n:
            to = ends.get(j, j + 1)
            k = want.get((j, to), OUT)
            for f in (*named[j, to, k], f"{before}>{k}"):
                grad[f] = grad.get(f, 0.0) + 1
                value += self.weights.get(f, 0.0)
            j, before = to, k
        return value - total, grad

    def train(self, examples: list[tuple[str, list[tuple[str, int, int]]]], seed: int = 11) -> None:
        """Fit by AdaGrad. examples: (text, its entities); entities that are no candidate are left out."""
        parts = []
        for text, entities in examples:
            for region in regions(text):
                lat = Lattice(text, region, [])
                if not lat.empty:
                    at = {c: i for i, c in enumerate(lat.cuts)}
                    gold = [(KINDS.index(k), at[s], at[e]) for k, s, e in entities if s in at and e in at]
                    if all(any((i, k) == x[:2] for x in lat.ends[j]) for k, i, j in gold):
                        parts.append((lat, gold))
        rng, squares = Random(seed), {}
        for _ in range(EPOCHS):
            rng.shuffle(parts)
            for lat, gold in parts:
                _, grad = self.gradient(lat, gold)
                for f, g in grad.items():
                    g -= RIDGE * self.weights.get(f, 0.0)
                    squares[f] = squares.get(f, 0.0) + g * g
                    self.weights[f] = self.weights.get(f, 0.0) + RATE * g / (math.sqrt(squares[f]) + 1e-6)

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans besides the base ones."""
        spans = sorted((s, e) for _, s, e in base)
        out, at = [], 0
        for region in regions(text):
            while at < len(spans) and spans[at][1] <= region[0]:
                at += 1
            upto = bisect_left(spans, (region[1], 0), at)
            lat = Lattice(text, region, spans[at:upto])
            if not lat.empty:
                out += [(KINDS[k], lat.cuts[i], lat.cuts[j]) for k, i, j in self.best(lat)]
        return out


# --- training examples

FILLERS = ["", "the", "und", "pour", "con", "see", "is", "and", "call", "from", "mail", "card", "tel", "phone", "host", "order", "page"]


def drawn(kind: str, rng: Random) -> str:
    """An entity as the base patterns know it."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9)))
    if kind == "email":
        return f"{word()}{rng.choice(['', '.' + word(), '.' + num(2), '_' + word(), num(1)])}@{word()}{rng.choice(['', num(1), '.' + word(), '-' + word()])}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'info'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = str(rng.randint(2, 6)) + num(rng.choice([14, 14, 14, 15, 17]))
        whole = body + next(d for d in "0123456789" if luhn(body + d))
        return whole if rng.random() < 0.5 else rng.choice(" -").join(whole[i : i + 4] for i in range(0, len(whole), 4))
    return rng.choice([f"+{rng.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"+{rng.randint(1, 99)} {num(3)} {num(3)} {num(4)}", f"+{rng.randint(1, 99)}{num(rng.randint(9, 11))}", f"+{rng.randint(1, 99)}-{num(2)}-{num(4)}-{num(4)}"])


def rewritten(kind: str, span: str, rng: Random) -> str:
    """An entity in a form that the base patterns miss, or miss in part."""
    if kind == "email":
        at, dot = rng.choice([(" @ ", "."), ("[at]", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), ("@", "[dot]"), ("@", " . ")])
        local, _, host = span.partition("@")
        return local + at + host.replace(".", dot)
    if kind == "card":
        digits = _NOT_DIGIT.sub("", span)
        return rng.choice(".. -").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "phone":
        return rng.choice([re.sub(r"^\+[0-9]+[ -]?(?=[(])", "", span), span.replace(" ", "."), span])
    return span


def decoy(rng: Random) -> str:
    """Numbers and signs that are no personal data."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    year = lambda: str(rng.randint(1900, 2030))
    pick = rng.randrange(14)
    if pick < 4:
        body = num(rng.choice([13, 15, 15, 15, 16, 18]))
        digits = body + next(d for d in "9876543210" if not luhn(body + d))
        return digits if pick < 3 else rng.choice(" -").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return [
        f"{year()}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{year()}", f"{year()}-{year()}", f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
        " ".join(num(rng.randint(1, 4)) for _ in range(rng.randint(3, 9))), num(rng.randint(7, 15)), f"({year()}) {num(3)}-{num(3)}", f"{rng.randint(256, 999)}.{num(3)}.{num(2)}.{num(3)}", f"meet at {num(4)} or at dot",
        f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
    ][pick - 4]


def examples(windows: list[tuple[str, list[tuple[str, int, int]]]], seed: int = 11, each: int = 220) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Windows of the corpus as they are, and lines made of entities, rewritten entities, decoys and filler words."""
    rng = Random(seed)
    known = {k: [t[s:e] for t, spans in windows for kind, s, e in spans if kind == k] for k in KINDS}
    out = list(windows)
    for _ in range(each * len(KINDS)):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += rng.choice(FILLERS)
            text += " " if text and text[-1] != " " else ""
            if rng.random() < 0.3:
                text += decoy(rng)
                text += rng.choice([", ", "; ", ". "])
            else:
                kind = rng.choice(KINDS)
                span = rng.choice(known[kind]) if known[kind] and rng.random() < 0.5 else drawn(kind, rng)
                span = rewritten(kind, span, rng) if rng.random() < 0.5 else span
                spans.append((kind, len(text), len(text) + len(span)))
                text += span + rng.choice([" ", " ", ", ", ". "])
        out.append((text + rng.choice(FILLERS), spans))
    return out


_WINDOW = pa.schema([("kind", pa.string()), ("window", pa.string()), ("s", pa.int32()), ("e", pa.int32())])


def sampled(docs: DataFrame, most_docs: int = SAMPLE_DOCS, most_windows: int = SAMPLE_WINDOWS) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Base spans with their surroundings, ``most_windows`` of each kind at most, of about ``most_docs`` documents by a hash of doc_id.

    A window holds one base span and no other digits or signs, so that nothing in it is a span that the base missed.
    """
    n = docs.count()
    rate = min(1.0, most_docs / max(n, 1))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("pii")), F.lit(1 << 24))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = dict.fromkeys(KINDS, 0)
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                for kind, s, e in base_spans(text):
                    window = text[max(0, s - 30) : e + 30]
                    at = min(s, 30)
                    around = window[:at] + window[at + e - s :]
                    if seen[kind] < most_windows and e - s <= 2 * MOST_CHARS and not re.search("[0-9@]", around):
                        seen[kind] += 1
                        found.append((kind, window, at, at + e - s))
            if found:
                yield pa.record_batch([list(x) for x in zip(*found)], schema=_WINDOW)

    rows = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (draw < F.lit(int(rate * (1 << 24)) + 1))).select("text")
    found = rows.mapInArrow(scan, "kind string, window string, s int, e int").distinct()
    out = []
    for kind in KINDS:
        out += [(r.window, [(kind, r.s, r.e)]) for r in found.where(F.col("kind") == kind).orderBy(F.xxhash64("window"), "window", "s").limit(most_windows).collect()]
    return out


def fit_field(docs: DataFrame) -> Field:
    field = Field()
    field.train(examples(sampled(docs)))
    return field


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, kind, start, end, base): every span, in code points, end exclusive; base tells those of the patterns.

    The general form of the operator; cases as in ``pii_report``.
    """
    model = field or fit_field(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                rows += [(doc_id, k, s, e, True) for k, s, e in base] + [(doc_id, k, s, e, False) for k, s, e in model.added(text, base)]
            if rows:
                yield pa.record_batch([list(x) for x in zip(*rows)], schema=pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, kind string, start long, end long, base boolean")


def pii_report(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row for each document: how many spans the base patterns find of each kind, a digest of those, and all spans.

    docs: doc_id, text and any other columns, which are ignored. n_email to n_phone count base spans, n_added the method's.
    Null counts as empty; repeated rows and null ids have rows of their own, but ids that are null are not drawn for
    fitting. Base spans of several kinds may overlap; added ones overlap nothing. An empty table gives an empty result and
    a field trained on drawn examples alone. Texts are searched whole, in time linear in their length, one at a time.
    """
    model = field or fit_field(docs)
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                added = model.added(text, base)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                every = sorted(base + added, key=lambda x: (order[x[0]], x[1]))
                rows.append((doc_id, *counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every), len(added)))
            if rows:
                columns = list(zip(*rows))
                yield pa.record_batch([pa.array(c, pa.int64()) if i not in (5, 6) else pa.array(c) for i, c in enumerate(columns)], names=[x.split()[0] for x in DDL.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DDL)
