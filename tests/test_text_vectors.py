import pytest
from pyspark.sql import functions as F

from lexloom import queries
from lexloom.functions import text as T
from lexloom.operators import neighbours, tfidf

SMALL = "/root/testdata/sf0.001"


def test_listed_counts_and_placed_vectors_are_the_long_tables(spark):
    rows = [(1, "b a b c", True), (2, "", False), (3, None, False), (4, "A é\nzz b x", False), (5, "b", True), (5, "b q", True), (6, "unseen", True), (7, "b a b c", False)]
    docs = spark.createDataFrame(rows, "k long, t string, m boolean")
    words = lambda t: T.words(F.lower(t))
    listed = tfidf.listed_counts(docs, "k", "t", words, "m")
    long = tfidf.term_counts(docs, "k", words(F.col("t")), "m")
    assert sorted(map(tuple, tfidf.each_count(listed, "k", "m").collect())) == sorted(map(tuple, long.collect()))
    idf = [("a", 1.5), ("b", 1.25), ("c", 2.0), ("zz", 3.0)]
    got = {r.k: r for r in tfidf.placed_vectors(listed, "k", idf, "m").collect()}
    want = {r.k: [(x["term"], x["weight"]) for x in r.v] for r in tfidf.vectors(long, "k", spark.createDataFrame(idf, "term string, idf double"), "m").collect()}
    assert {k: [idf[i][0] for i in r["at"]] for k, r in got.items()} == {k: [t for t, _ in v] for k, v in want.items()}
    assert all(r.w == pytest.approx([w for _, w in want[k]], abs=1e-15) for k, r in got.items())
    assert got[1].d == got[7].d and got[1].w == got[7].w and len({bytes(r.d) for r in got.values()}) == 3 and got[1].m and not got[7].m


def test_mean_vectors_are_means_of_signs(spark):
    docs = spark.createDataFrame([(i, f"a b{i} a") for i in range(150)] + [(999, "")], "k long, t string")
    listed = tfidf.listed_counts(docs, "k", "t", T.words)
    sign = F.transform(T.words("t"), lambda w: F.when(F.getbit(F.xxhash64(w), F.lit(47)) == 1, 1.0).otherwise(-1.0))
    want = {r.k: sum(r.s) / 3 for r in docs.where("t <> ''").select("k", sign.alias("s")).collect()}
    assert {r.k: r.v[47] for r in queries._mean_vectors(listed, "k").collect()} == want


def test_text_neighbours_stores_few_tables(spark, monkeypatch):
    stored = []
    for module in (queries, neighbours):
        monkeypatch.setattr(module, "kept", lambda df, label="kept", *a, real=module.kept: (stored.append(label), real(df, label, *a))[1])
    assert queries.text_neighbours(spark, SMALL).count() > 0
    assert len(stored) <= 9 and stored.count("vectors") == 0


def test_three_models_share_one_look_at_the_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "_text_vectors", lambda *a, real=queries._text_vectors: (seen.append(a), real(*a))[1])
    models = queries._three_models(spark, SMALL)
    assert [name for name, _ in models] == ["tfidf_logreg", "tfidf_knn", "means_logreg"] and len(seen) == 1
