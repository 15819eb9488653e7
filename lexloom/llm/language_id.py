"""Operator 10, language identification by error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary classifier over hashed byte n-grams (logistic
regression) predicts on which side of the split a text lies. Decoding sums, for each codeword, the logistic loss of
the bits' margins, weighted by how well each bit did in fitting; the least loss wins. A text whose two best codewords
lie close together is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._fit import labelled_texts
from lexloom.llm._tables import held_out

BUCKETS = 4096
PIECE = 1 << 20
PER_LANGUAGE = 400  # rows of each language that are used for fitting
MARGIN = 0.2  # of the score, between the two best codewords, under which a text is ambiguous
OUT_DDL = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def grams(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed two- and three-byte grams of the whole text."""
    out = np.zeros(BUCKETS)
    for lo in range(0, len(text), PIECE):
        b = np.frombuffer(text[max(0, lo - 2) : lo + PIECE], np.uint8).astype(np.uint32)
        b = np.where((b >= 65) & (b <= 90), b + np.uint32(32), b)
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        # a later piece begins with the last two bytes of the one before: their pair was counted there
        for g in (two[min(lo, 1) :], three + np.uint32(1 << 24)):
            out += np.bincount((g * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    total = out.sum()
    return np.sqrt(out / total).astype(np.float32) if total else out.astype(np.float32)


def codewords(n: int, seed: int = 10) -> np.ndarray:
    """n codewords of +1 and -1: one bit for each language against the rest, and random splits, far apart."""
    bits = 2 * n - 1 if n <= 8 else n + 32
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(50):
        code = np.concatenate([2 * np.eye(n) - 1, rng.choice([-1.0, 1.0], (n, max(bits - n, 0)))], 1)
        code = code[:, np.abs(code.sum(0)) < n] if n > 1 else code
        gap = min((int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]), default=0)
        if gap > far:
            best, far = code, gap
    return best


class Codes:
    def __init__(self, rows: list[tuple[bytes, str]]) -> None:
        self.languages = sorted({y for _, y in rows})
        if not self.languages:
            return
        self.code = codewords(len(self.languages))
        x = np.array([grams(t) for t, _ in rows])
        x = np.concatenate([x, np.ones((len(rows), 1), np.float32)], 1)
        y = self.code[[self.languages.index(y) for _, y in rows]]
        self.weights = np.zeros((x.shape[1], y.shape[1]), np.float32)
        speed = np.zeros_like(self.weights)
        for _ in range(150):
            p = 1 / (1 + np.exp(np.clip(y * (x @ self.weights), -30, 30)))
            speed = 0.9 * speed + (x.T @ (-y * p)).astype(np.float32) / len(rows) + 1e-5 * self.weights
            self.weights -= 4 * speed
        right = ((x @ self.weights) * y > 0).mean(0)
        self.trust = np.clip(2 * right - 1, 0.05, 1)

    def decode(self, text: bytes) -> tuple[str, float, bool]:
        margins = np.append(grams(text), 1).astype(np.float32) @ self.weights
        losses = (np.logaddexp(0, -self.code * margins) * self.trust).sum(1)
        share = np.exp(losses.min() - losses)
        share /= share.sum()
        best = int(losses.argmin())
        rest = np.delete(share, best)
        return self.languages[best], float(share[best]), bool(len(rest) and share[best] - rest.max() < MARGIN)


def identify_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Predict the language of every whole text; the fold with crc32 of doc_id mod 5 = 0 is not used for fitting.

    docs: doc_id, text, lang and any other columns, which are ignored. Returns doc_id, held_out, lang_pred, score
    (share of the best codeword, 0 to 1) and ambiguous, one row per input row. Up to ``per_language`` rows of each
    non-null language are used to fit.

    Null texts and texts without a letter are ``und`` with score 0; so is every text if no language is known. Ties go
    to the language that sorts first. A null doc_id is not held out. An empty table gives an empty result.
    """
    known = docs.where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col("lang").alias("label"))
    codes = Codes([(t, y) for t, y in labelled_texts(docs, known, per_language) if t])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py() or ""
                got = codes.decode(text.encode("utf-8", "replace")) if codes.languages and any(map(str.isalpha, text)) else ("und", 0.0, True)
                rows.append((doc_id, bool(out), *got))
            if rows:
                yield pa.record_batch([list(c) for c in zip(*rows)], schema=OUT)

    return docs.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 5, 0), F.lit(False)), "text").mapInArrow(predict, OUT_DDL)
