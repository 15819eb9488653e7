"""Operator 2, toxicity: Levenshtein automata intersected with a lexicon trie, and scores by context window.

The lexicon is learned: words, and stems that begin many words, which occur in toxic documents and hardly in others.
It is held as a trie. The Levenshtein automaton of "at most e errors" is intersected with the trie on the fly: a state
is a set of (trie node, errors so far), made deterministic and remembered, so that nearly every word of a text dies
after two or three steps, and misspelled terms are met as surely as exact ones. Ordinary words that happen to be near a
term are no hits, and a misspelled hit counts for as much as its term and number of errors can be told from clean words.
Each hit is read in its window: between quotation marks or beside a word of reporting it counts as quotation, otherwise
as abuse. A logistic regression weighs exact and misspelled hits of both kinds; every toxic text is fitted as written
and as if its terms were misspelled.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._fit import labelled_texts
from lexloom.llm._tables import held_out

WORD = re.compile(r"[\w*@$]+")
#: Marks of quotation, and words of reporting in the languages at hand.
QUOTES = re.compile("[\"“”„«»‘’]")
REPORTING = frozenset(
    "said says wrote writes quote quoted quotes called word words term terms means"
    " sagte schrieb zitat wort begriff dit disait mot terme citation dijo palabra cita".split()
)
WINDOW = 6  # words on either side
PER_CLASS = 2_500  # labelled rows of each class that are used for fitting
OUT_DDL = "doc_id long, held_out boolean, score double, predicted int, hits int, quoted int"
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("hits", pa.int32()), ("quoted", pa.int32())])


def allowed(term: str) -> int:
    """Errors allowed in a term: none under five letters, two from nine."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The intersection of the lexicon trie with Levenshtein automata, made deterministic as words are read."""

    def __init__(self, words: list[str], stems: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.limit = [0]  # most errors that a term below the node allows
        self.word = [-1]  # errors allowed in the word that ends here
        self.stem = [-1]
        for term, ends in [(w, self.word) for w in words] + [(s, self.stem) for s in stems]:
            node, most = 0, allowed(term)
            for ch in term:
                self.limit[node] = max(self.limit[node], most)
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.limit.append(0), self.word.append(-1), self.stem.append(-1)
                node = self.children[node][ch]
            self.limit[node] = max(self.limit[node], most)
            ends[node] = most
        self.alphabet = {ch for c in self.children for ch in c}
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[list[tuple[int, int]]] = []  # (errors, node) of the words that may end here, fewest errors first
        self.stems: list[list[tuple[int, int]]] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        least: dict[int, int] = {}
        todo = list(pairs)
        while todo:  # a term's letter may be missing
            node, e = todo.pop()
            if e <= self.limit[node] and e < least.get(node, 99):
                least[node] = e
                todo += [(c, e + 1) for c in self.children[node].values()]
        key = frozenset(least.items())
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.steps.append({})
            self.accepts.append(sorted((e, n) for n, e in key if e <= self.word[n]))
            self.stems.append(sorted((e, n) for n, e in key if e <= self.stem[n]))
        return self.states[key]

    def terms(self, word: str) -> list[tuple[int, int]]:
        """(errors, node) of the terms that the word is and the stems that it begins with, fewest errors first."""
        state, stems = self.start, set()
        for ch in word:
            if ch not in self.alphabet:
                ch = ""
            step = self.steps[state].get(ch)
            if step is None:
                step = self.steps[state][ch] = self._state(
                    {x for node, e in self.members[state] for x in [(node, e + 1), *((c, e + (k != ch)) for k, c in self.children[node].items())]}
                )
            if step < 0:
                return sorted(stems)
            state = step
            if self.stems[state]:
                if self.stems[state][0][0] == 0:
                    return self.stems[state]
                stems.update(self.stems[state])
        return sorted(stems.union(self.accepts[state])) if stems else self.accepts[state]

    def errors(self, word: str) -> int:
        """The fewest errors with which the word is a term or begins with a stem; -1 if it is not in the language."""
        return next((e for e, _ in self.terms(word)), -1)


def learn_lexicon(rows: list[tuple[str, int]], share: float = 0.01, times: int = 20, family: int = 8) -> tuple[list[str], list[str]]:
    """(words, stems): terms of at least four letters in a ``share`` of the toxic texts (three at least), and ``times``
    as often there as in others, by shares of the two classes' texts.

    A stem is the shortest beginning of ``family`` or more different words for which that holds.
    """
    rows = sorted(set(rows))  # copies count once
    least = max(3, share * sum(toxic for _, toxic in rows))
    seen = [Counter(), Counter()]
    for text, toxic in rows:
        seen[toxic].update({w for w in WORD.findall(text.lower()) if len(w) >= 4})
    starts = [Counter(), Counter()]
    kinds: dict[str, set[str]] = defaultdict(set)
    for text, toxic in rows:
        starts[toxic].update({w[:k] for w in WORD.findall(text.lower()) for k in (4, 5, 6) if len(w) >= k})
    total = Counter(toxic for _, toxic in rows)
    good = lambda c, x: c[1][x] >= least and c[1][x] * total[0] >= times * c[0][x] * total[1]
    for w in seen[1]:
        for k in (4, 5, 6):
            if len(w) > k:
                kinds[w[:k]].add(w)
    stems: list[str] = []
    for x in sorted((x for x in starts[1] if good(starts, x) and len(kinds[x]) >= family), key=lambda x: (len(x), x)):
        if not any(x.startswith(s) for s in stems):
            stems.append(x)
    words = sorted(w for w in seen[1] if good(seen, w) and not any(w.startswith(s) for s in stems))
    return words, stems


def learn_trust(rows: list[tuple[str, int]], automaton: Automaton, times: int = 20) -> tuple[frozenset[str], frozenset[str], dict[tuple[int, int], float]]:
    """(ordinary, lone, trust): words near a term that clean texts hold (unless toxic ones do ``times`` as often), those of
    them in one clean text only, and what a term or a word near it counts for, by (errors, node) of the term.

    A word that only one clean text holds would be unknown without that text. So the lone ones show how often clean texts
    hold unknown words near a term, and trust compares that with how often toxic texts hold the term. A term itself that
    clean texts hold too, though seldom, counts for less than one that they never hold.
    """
    rows = sorted(set(rows))  # copies count once
    total = Counter(toxic for _, toxic in rows)
    held = [Counter(), Counter()]
    for text, toxic in rows:
        held[toxic].update(set(WORD.findall(text.lower())))
    exact, near = Counter(), Counter()
    terms = {w: t for w in held[0].keys() | held[1].keys() if (t := automaton.terms(w))}
    ordinary = frozenset(w for w, t in terms.items() if t[0][0] and held[0][w] and held[1][w] * total[0] < times * held[0][w] * total[1])
    lone = frozenset(w for w in ordinary if held[0][w] == 1)
    for text, toxic in rows:
        words = {w for w in WORD.findall(text.lower()) if w in terms}
        if toxic:
            exact.update({n for w in words for e, n in terms[w] if e == 0})
        else:
            near.update({t for w in words for t in terms[w] if t[0] == 0 or terms[w][0][0] and w in lone})
    able = [(e, n) for n in exact for e in range(max(automaton.word[n], automaton.stem[n]) + 1)]
    against = lambda e, n: times * (near[e, n] + 0.5) if e else 5 * times * near[e, n]
    return ordinary, lone, {(e, n): exact[n] * total[0] / (exact[n] * total[0] + against(e, n) * total[1]) for e, n in able}


class Known(dict):
    """(errors, trust, trust if misspelled) by word, for words met before; emptied when it is large.

    Trust is what a hit counts for: that of its (errors, node), or 1.
    Words of ``ordinary`` are no misspellings. Terms too short to be met misspelled have None as the last.
    """

    def __init__(self, automaton: Automaton, ordinary: frozenset[str] = frozenset(), trust: dict[tuple[int, int], float] | None = None) -> None:
        self.automaton, self.ordinary, self.trust = automaton, ordinary, trust or {}

    def __missing__(self, word: str) -> tuple[int, float, float | None]:
        if len(self) > 200_000:
            self.clear()
        terms = self.automaton.terms(word)
        if not terms or terms[0][0] and word in self.ordinary:
            got = -1, 0.0, None
        elif terms[0][0]:
            trust = max(self.trust.get(t, 1.0) for t in terms)
            got = terms[0][0], trust, trust
        else:
            n = terms[0][1]
            got = 0, self.trust.get((0, n), 1.0), self.trust.get((1, n), 1.0) if max(self.automaton.word[n], self.automaton.stem[n]) else None
        self[word] = got
        return got


def weighed(text: str, known: Known) -> np.ndarray | None:
    """Three rows of (exact, misspelled) x (abuse, quotation): counts, sums of trust, and these as if every term were
    misspelled that may be. None without a hit."""
    text = text.lower()
    words = WORD.findall(text)
    if max((known[w][0] for w in words), default=-1) < 0:
        return None
    spans = [m.span() for m in WORD.finditer(text)]
    out = np.zeros((3, 4))
    for i, w in enumerate(words):
        e, trust, wrong = known[w]
        if e < 0:
            continue
        lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        before, after = text[spans[lo][0] : spans[i][0]], text[spans[i][1] : spans[hi - 1][1] + 1]
        quoted = bool(QUOTES.search(before)) and bool(QUOTES.search(after)) or not REPORTING.isdisjoint(words[lo:i]) or not REPORTING.isdisjoint(words[i + 1 : hi])
        out[:2, 2 * quoted + (e > 0)] += 1, trust
        out[2, 2 * quoted + (wrong is not None)] += trust if wrong is None else wrong
    return out


def features(text: str, known: Known) -> np.ndarray | None:
    """Counts of (exact, misspelled) x (abuse, quotation), or None without a hit."""
    got = weighed(text, known)
    return None if got is None else got[0]


def expanded(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.log1p(x), np.minimum(x, 1), [1.0]])


def fit_weights(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton's method; ``share``: what each row counts for."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (share * (p - y)) + ridge * w
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fitted(rows: list[tuple[str, int]]) -> tuple:
    """(words, stems, ordinary, trust, weights) of labelled texts."""
    words, stems = learn_lexicon(rows)
    automaton = Automaton(words, stems)
    ordinary, lone, trust = learn_trust(rows, automaton)
    # a clean text is read as one that was not learned from: its lone words are unknown
    known = [Known(automaton, ordinary - lone, trust), Known(automaton, ordinary, trust)]
    x, y, share = [], [], []
    for text, toxic in rows:
        f = weighed(text, known[toxic])
        f = np.zeros((3, 4)) if f is None else f
        for row in (f[1], f[2]) if toxic else (f[1],):
            x.append(expanded(row)), y.append(float(toxic)), share.append(0.5 if toxic else 1.0)
    return words, stems, ordinary, trust, fit_weights(np.array(x), np.array(y), np.array(share)) if rows else np.zeros(9)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple:
    """(words, stems, ordinary, trust, weights) from up to ``per_class`` labelled rows of each class."""
    return fitted([(t.decode("utf-8", "replace"), int(y)) for t, y in labelled_texts(docs, labels.select("doc_id", F.col("toxic").alias("label")).where("toxic in (0, 1)"), per_class)])


class Scorer:
    """Score and counts of texts, with one automaton for all of them."""

    def __init__(self, words: list[str], stems: list[str], ordinary: frozenset[str], trust: dict[tuple[int, int], float], weights: np.ndarray) -> None:
        self.known, self.weights = Known(Automaton(words, stems), ordinary, trust), weights

    def __call__(self, text: str | None) -> tuple[float, np.ndarray]:
        f = weighed(text, self.known) if text else None
        f = np.zeros((3, 4)) if f is None else f
        return float(1 / (1 + np.exp(-expanded(f[1]) @ self.weights))), f[0]


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Score every whole text for toxicity; labels of the held-out fold (crc32 of doc_id mod 5 = 0) are not used.

    docs: doc_id, text; labels: doc_id, toxic; other columns are ignored. Returns doc_id, held_out, score (0 to 1),
    predicted (score >= 0.5), hits and quoted (terms met, and those met in quotation), one row per input row.

    Null and empty texts have no hits and the score of a text without any. A null doc_id is not held out. Labels
    other than 0 and 1 are ignored, repeated ones count once. Without usable labels every score is 0.5. An empty
    table gives an empty result. Memory: a batch of texts, and 200,000 known words.
    """
    model = fit(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)), per_class)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for batch in batches:
            rows = []
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                p, f = scorer(text.as_py())
                rows.append((doc_id, bool(out), p, int(p >= 0.5), int(f.sum()), int(f[2:].sum())))
            if rows:
                yield pa.record_batch([list(c) for c in zip(*rows)], schema=OUT)

    return docs.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 5, 0), F.lit(False)), "text").mapInArrow(score, OUT_DDL)


def reject_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``; the texts are neither joined nor shuffled.

    Without labels of both classes every score is 0.5 and means nothing: all rows stay.
    """
    known = labels.where(~held_out(F.col("doc_id"), 5, 0))
    if known.where("toxic in (0, 1)").select("toxic").distinct().count() < 2:
        return docs
    model = fit(docs, known, per_class)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for batch in batches:
            yield batch.filter(pa.array([scorer(text.as_py())[0] < threshold for text in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
