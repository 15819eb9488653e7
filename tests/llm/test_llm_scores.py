"""Scores of the fitted models, recomputed in plain Python from their weights."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexloom.llm import language_id, quality, queries
from lexloom.llm._fit import labelled_texts
from lexloom.llm._tables import held_out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    words = {"en": "the and of that with thing".split(), "fr": "les une dans que être çà".split(), "de": "und der das nicht über ßa".split()}
    docs, labels = [], []
    for i in range(180):
        lang = rng.choice(list(words))
        good = rng.random() < 0.5
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 60))) + ("." if good else "!!$ 7") * rng.randint(1, 4)
        docs.append((i, text, lang, "s"))
        labels.append((i, int(good), 0))
    docs += [(500, None, "en", "s"), (501, "", "fr", "s"), (502, "12 !", None, "s"), (None, "the thing", "en", "s"), (3, docs[3][1], "en", "s"), (3, "x" * 700, "de", "s")]
    path = str(tmp_path_factory.mktemp("scores"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "0 AS score", "1 AS held_out").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, labels[0], (900, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def fold(doc_id, modulus, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def test_quality_scores(spark, folder, monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 1)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known = labels.where(~held_out(F.col("doc_id"), 3, 1) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    net = quality.train([(t, int(y)) for t, y in labelled_texts(docs, known, quality.PER_CLASS)])
    table, bias, out = net.table.tolist(), net.bias.tolist(), net.out.tolist()

    def plain(text):
        data = (text or "").encode()
        data += bytes(max(0, quality.WIDTH - len(data)))
        ends = range(len(data) - quality.WIDTH + 1)
        means, tops = [], []
        for f in range(quality.FILTERS):
            r = [max(0.0, sum(table[k][data[i + k]][f] for k in range(quality.WIDTH)) + bias[f]) for i in ends]
            block = [max(r[i : i + quality.BLOCK]) for i in range(0, len(r), quality.BLOCK)]
            chunks = [max(p) for p in zip(block, block[1:])] or block
            means.append(sum(chunks) / len(chunks))
            tops.append(max(chunks))
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip([*means, *tops, 1.0], out))))

    texts = sorted(((str(r.doc_id), r.text or "") for r in docs.collect()), key=lambda x: (x[0], plain(x[1])))
    got = sorted(queries.op7_quality(spark, folder).collect(), key=lambda r: (str(r.doc_id), r.score))
    assert len(got) == len(texts) == 186
    for (i, text), r in zip(texts, got):
        assert str(r.doc_id) == i and abs(r.score - plain(text)) < 1e-4, i
        assert r.predicted == int(r.score >= 0.5) and r.held_out == fold(r.doc_id, 3, 1)


def test_language_scores(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = docs.where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col("lang").alias("label"))
    codes = language_id.Codes([(t, y) for t, y in labelled_texts(docs, known, language_id.PER_LANGUAGE) if t])
    weights, trust, code = codes.weights.tolist(), codes.trust.tolist(), codes.code.tolist()

    def plain(text):
        data = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
        counts = {}
        for n, mark in ((2, 0), (3, 1 << 24)):
            for i in range(len(data) - n + 1):
                at = ((int.from_bytes(data[i : i + n], "big") + mark) * 2654435761 % (1 << 32)) >> 20
                counts[at] = counts.get(at, 0) + 1
        total = sum(counts.values())
        margins = [weights[-1][b] + sum(math.sqrt(c / total) * weights[at][b] for at, c in counts.items()) for b in range(len(trust))]
        losses = [sum(math.log1p(math.exp(-c * m)) * t for c, m, t in zip(word, margins, trust)) for word in code]
        share = [math.exp(min(losses) - x) for x in losses]
        return codes.languages[losses.index(min(losses))], max(share) / sum(share)

    got = queries.op10_language_id(spark, folder).collect()
    want = [plain(r.text) if r.text and any(map(str.isalpha, r.text)) else ("und", 0.0) for r in docs.collect()]
    ids = [r.doc_id for r in docs.collect()]
    mine, theirs = sorted((str(r.doc_id), r.lang_pred, r.score) for r in got), sorted((str(i), p, x) for i, (p, x) in zip(ids, want))
    assert len(mine) == len(theirs) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4 for a, b in zip(mine, theirs))
    assert all(r.held_out == fold(r.doc_id, 5, 0) for r in got)
