"""Operator 7, quality classifier: a byte-level convolutional network in numpy.

A filter is a table of weights by place and byte. Its responses over a text, rectified, are max-pooled in overlapping
chunks that cover the whole document; the chunks' pooled responses are averaged and maximised over the document, and
one logistic unit combines them. Training is by Adam on the gradients of the pooled places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._fit import labelled_texts
from lexloom.llm._tables import held_out

FILTERS, WIDTH, BLOCK = 16, 5, 256  # a chunk is two blocks; chunks overlap by one
PIECE = 256 * BLOCK  # bytes whose responses are held at once
PER_CLASS = 1_200  # labelled rows of each class that are used for fitting
EPOCHS, BATCH, RATE = 5, 32, 0.01
OUT_DDL = "doc_id long, held_out boolean, score double, predicted int"
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


class Network:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32)

    def blocks(self, text: bytes, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(largest response of each filter in each block of the text, and where)."""
        data = np.frombuffer(text.ljust(WIDTH, b"\0"), np.uint8)
        tops, wheres = [], []
        for lo in range(0, len(data) - WIDTH + 1, PIECE):
            part = data[lo : lo + PIECE + WIDTH - 1]
            n = len(part) - WIDTH + 1
            r = np.take(self.table[0], part[:n], axis=0)
            for k in range(1, WIDTH):
                r += np.take(self.table[k], part[k : n + k], axis=0)
            if places:
                rest = -n % BLOCK
                at = np.concatenate([r, np.full((rest, FILTERS), -np.inf, np.float32)]).reshape(-1, BLOCK, FILTERS).argmax(1)
                at += np.arange(len(at))[:, None] * BLOCK
                tops.append(np.take_along_axis(r, at, 0))
                wheres.append(at + lo)
            else:
                tops.append(np.maximum.reduceat(r, np.arange(0, n, BLOCK), axis=0))
        return np.concatenate(tops), np.concatenate(wheres) if places else None

    def pooled(self, tops: np.ndarray) -> np.ndarray:
        top = np.maximum(tops + self.bias, 0)
        return np.maximum(top[:-1], top[1:]) if len(top) > 1 else top

    def vector(self, chunks: np.ndarray) -> np.ndarray:
        return np.concatenate([chunks.mean(0), chunks.max(0), [1.0]]).astype(np.float32)

    def probability(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-(self.vector(self.pooled(self.blocks(text)[0])) @ self.out))))

    def gradients(self, text: bytes, label: int, to: list[np.ndarray]) -> float:
        """Add the gradients of one text to ``to`` (table, bias, out); returns its loss."""
        tops, where = self.blocks(text, places=True)
        top = np.maximum(tops + self.bias, 0)
        chunks = np.maximum(top[:-1], top[1:]) if len(top) > 1 else top
        source = np.arange(len(chunks))[:, None] + (top[1:] > top[:-1] if len(top) > 1 else np.zeros_like(top, int))
        v = self.vector(chunks)
        p = 1 / (1 + np.exp(-(v @ self.out)))
        d = np.float32(p - label)
        to[2] += d * v
        g = np.repeat(d * self.out[None, :FILTERS] / len(chunks), len(chunks), 0)
        best = chunks.argmax(0)
        g[best, np.arange(FILTERS)] += d * self.out[FILTERS : 2 * FILTERS]
        f = np.broadcast_to(np.arange(FILTERS), source.shape)
        g = np.where(top[source, f] > 0, g, 0)
        at = where[source, f]
        np.add.at(to[1], f.ravel(), g.ravel())
        data = np.frombuffer(text.ljust(WIDTH, b"\0"), np.uint8)
        for k in range(WIDTH):
            np.add.at(to[0][k], (data[at + k].ravel(), f.ravel()), g.ravel())
        return float(-np.log(max(p if label else 1 - p, 1e-9)))


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    net = Network(seed)
    rng = np.random.default_rng(seed)
    params = [net.table, net.bias, net.out]
    m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), BATCH):
            grads = [np.zeros_like(p) for p in params]
            for i in order[lo : lo + BATCH]:
                net.gradients(rows[i][0], rows[i][1], grads)
            t += 1
            for i, p in enumerate(params):
                g = grads[i] / BATCH
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                p -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Score every whole text for quality; labels of the held-out fold (crc32 of doc_id mod 3 = 1) are not used.

    docs: doc_id, text; labels: doc_id, quality; other columns are ignored. Returns doc_id, held_out, score (0 to 1),
    predicted (score >= 0.5), one row per input row. Up to ``per_class`` labelled rows of each class are used to fit.

    Null, empty and very short texts are scored as if padded with zero bytes. A null doc_id is not held out. Labels
    other than 0 and 1 are ignored, repeated ones count once. Without usable labels the network is as initialised.
    An empty table gives an empty result. Memory: a batch of texts, and the responses to 64 KB.
    """
    known = labels.where(~held_out(F.col("doc_id"), 3, 1) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    net = train([(t, int(y)) for t, y in labelled_texts(docs, known, per_class)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                p = net.probability(text.as_py() or b"")
                rows.append((doc_id, bool(out), p, int(p >= 0.5)))
            if rows:
                yield pa.record_batch([list(c) for c in zip(*rows)], schema=OUT)

    return docs.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(False)), F.col("text").cast("binary")).mapInArrow(score, OUT_DDL)
