"""Operator 3 and the pipeline against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from lexloom.llm.mixing import DOMAINS, SHARE, WEIGHTS, domain_of, mix_sources
from pyspark.sql import functions as F


def fill(budget, nodes):
    """nodes: name -> (weight, capacity); least capacity per weight first."""
    out, weight = {}, sum(w for w, _ in nodes.values())
    order = sorted(nodes, key=lambda n: (nodes[n][1] / nodes[n][0], n))
    for i, n in enumerate(order):
        w, c = nodes[n]
        if c * weight <= budget * w:
            out[n], budget, weight = c, budget - c, weight - w
        else:
            out |= {m: budget * nodes[m][0] // weight for m in order[i:]}
            break
    return out


def mixed(rows, epochs=2):
    """rows: (doc_id, text, lang, source) -> epochs by doc_id."""
    leaf, size = defaultdict(list), {}
    for i, t, lang, source in rows:
        m = re.search(r"([0-9]{1,9})$", source or "")
        size[i] = len((t or "").encode().split())
        leaf[DOMAINS[int(m[1]) % 4] if m else "other", lang or "", source or ""].append(i)
    supply = {k: sum(size[i] for i in v) for k, v in leaf.items()}

    def down(path, budget):
        level = len(path)
        if level == 3:
            return {path: budget}
        kids = sorted({k[: level + 1] for k in leaf if k[:level] == path})
        held = {k: sum(epochs * supply[x] for x in leaf if x[: level + 1] == k) for k in kids}
        got = fill(budget, {k[-1]: (WEIGHTS[level].get(k[-1], 1), held[k]) for k in kids})
        return {x: b for k in kids for x, b in down(k, got[k[-1]]).items()}

    total = sum(supply.values()) * SHARE[0] // SHARE[1]
    out = {}
    for k, budget in down((), min(total, epochs * sum(supply.values()))).items():
        whole, part = divmod(budget, supply[k]) if supply[k] else (0, 0)
        run = 0
        for i in sorted(leaf[k], key=lambda i: (hashlib.md5(f"42|{whole}|{i}".encode()).hexdigest(), i)):
            run += size[i]
            out[i] = whole + (run <= part and part > 0)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(400):
        source = "src0" if rng.random() < 0.4 else rng.choice(["src1", "src2", "src3", "src5", "blog", None])
        out.append((i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 5, 50, 300]))), rng.choice(["en", "fr", "xx", None]), source, rng.randrange(9)))
    return [*out, (900, None, "en", "src1", 1)]


def test_mixing_takes_equal_rows_together_and_carries_texts(spark):
    docs = [(1 + i // 3, f"w{i} a b", "en", "src1") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = mix_sources(df).collect()
    by_id = {d: {r.epochs for r in got if r.doc_id == d} for d in range(1, 21)}
    assert len(got) == 60 and all(len(e) == 1 for e in by_id.values()) and sum(r.n_tokens * r.epochs for r in got) <= 180 * SHARE[0] // SHARE[1]
    told = mix_sources(df, ties=["text"]).collect()
    assert sum(r.n_tokens * r.epochs for r in told) == 180 * SHARE[0] // SHARE[1]
    assert sorted((r.doc_id, r.body, r.epochs) for r in mix_sources(df.withColumn("body", F.col("text")), ties=["text"], carry=["body"]).collect()) == sorted((r.doc_id, r.text, r.epochs) for r in told)


def test_mixing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, budget int")
    want = mixed([r[:4] for r in rows])
    for digits in (1, 3):
        assert {r.doc_id: r.epochs for r in mix_sources(df, digits=digits).collect()} == want
    assert mix_sources(df.where("false")).collect() == [] and {r.epochs for r in mix_sources(df.where("text = ''")).collect()} == {0}
    assert max(want.values()) == 2 and 0 in want.values()


def test_domains(spark):
    df = spark.createDataFrame([("src7",), ("blog",), ("",), ("99999999999",)], "s string")
    assert [r[0] for r in df.select(domain_of(F.col("s"))).collect()] == ["talk", "other", "other", "talk"]


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    draw = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    bench = [(i, draw(15)) for i in range(3)]
    docs, labels, clean = {}, [], {}
    for i in range(260):
        t = draw(rng.randint(20, 80))
        if i % 10 == 0:
            t += " grobnik flumpard grobnik"
        labels.append((i, 1, int(i % 10 == 0)))
        docs[i] = t
    docs |= {300: docs[1] + "  ", 301: docs[3] + " extra", 302: draw(20) + " " + bench[1][1].upper() + " " + draw(9), 303: None, 304: ""}
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")

    clean = {i: t for i, t in docs.items() if "grobnik" not in (t or "")}
    groups = defaultdict(list)
    for i, t in clean.items():
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append(i)
    clean = {i: clean[i] for ids in groups.values() for i in [min(ids, key=lambda i: (-len(clean[i] or ""), i))]}
    assert 1 not in clean and 300 in clean
    clean.pop(301), clean.pop(302)  # near copy of 3 (kept: smallest id); benchmark passage
    want = {i: e for i, e in mixed([(i, t, "en", f"src{i % 3}") for i, t in clean.items()]).items() if e}
    assert {r.doc_id: r.epochs for r in corpus_pipeline.run(spark, path).collect()} == want
    read = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, read, path).columns == read.columns, name
        assert stage(spark, read.where("false"), path).count() == 0


def test_pipeline_judges_every_row_by_its_own_text(spark, tmp_path):
    rng = random.Random(11)
    draw = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    bench, a, b, c, d, e, f = (draw(n) for n in (15, 40, 40, 40, 40, 40, 40))
    # (doc_id, text, stays)
    rows = [(1, a, True), (1, a, False), (2, b, True), (None, b, False), (None, c, True), (None, c, False), (None, c + " more", False), (None, f"{d} {bench}", False)]
    rows += [(3, e, True), (4, e, False), (4, f, True), (5, f"{draw(9)} {bench}", False), (5, d, True)]
    path = str(tmp_path)
    table = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    order = lambda x: (x[0] or -1, x[1])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, path)
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=order) == sorted(((i, t) for i, t, stays in rows if stays), key=order)
    got = corpus_pipeline.mixing(spark, docs, path).collect()
    left = [r for r in mix_sources(docs).collect() if r.epochs]
    assert sorted((r.doc_id or -1, r.n_tokens, r.epochs) for r in got) == sorted((r.doc_id or -1, r.n_tokens, r.epochs) for r in left)


def test_pipeline_with_clashing_names_and_without_labels(spark, tmp_path):
    rng = random.Random(12)
    draw = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = [draw(40) for _ in range(20)]
    rows = [(i, t, 7, i, f"a{i}", "r", "n") for i, t in enumerate([*texts, texts[3]])]
    path = str(tmp_path)
    names = ["doc_id", "text", "_row", "_place", "a.b", "row", "number"]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, _place int, `a.b` string, row string, number string").selectExpr("*", "'en' lang", "'src1' source")
    for ids in (F.col("doc_id"), F.lit(5).cast("long")):
        folder = f"{path}/{abs(hash(str(ids)))}"
        df.withColumn("doc_id", ids).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(0, "no such words here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == [*names, "lang", "source"], name
            assert docs.count() == (21 if name == "toxicity" else 20), name
        assert {r["a.b"] for r in docs.collect()} >= {f"a{i}" for i in range(20) if i != 3}
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == [*names, "lang", "source", "domain", "n_tokens", "epochs"] and out.count() > 0
