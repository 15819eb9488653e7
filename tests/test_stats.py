import pytest

from lexloom.operators import stats, tfidf
from pyspark.sql import functions as F

PAIRS = [(4, 2), (3, 2), (4, 4), (4, 3), (5, 4), (5, 5), (3, 3), (4, 5), (3, 4), (2, 3), (5, 5), (3, 5), (3, 4), (3, 3), (5, 5), (4, 5), (4, 4), (4, 4), (4, 4), (4, 5)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(PAIRS)], "pair_id int, a int, b int")


def test_agreement(pairs):
    k = stats.kappa(pairs, "a", "b", [1, 2, 3, 4, 5]).first()
    assert (k.kappa_plain, k.kappa_linear, k.kappa_quadratic) == pytest.approx((0.2226148, 0.3434343, 0.4785276), abs=1e-6)
    assert stats.spearman(pairs, "a", "b").first().spearman == pytest.approx(0.5156795, abs=1e-6)
    r = stats.agreement(pairs, "a", "b").first()
    assert (r.exact, r.within_one, r.mean_difference) == pytest.approx((0.45, 0.90, 0.65))
    m = {(r.a, r.b): r.n for r in stats.confusion(pairs, "a", "b", [1, 2, 3, 4, 5]).collect()}
    assert len(m) == 25 and [m[4, j] for j in range(1, 6)] == [0, 1, 1, 4, 3] and [m[1, j] for j in range(1, 6)] == [0] * 5


def test_pair_scores(spark, pairs):
    notes = pairs.select("pair_id", F.lit("x").alias("annotator"), F.col("a").alias("score")).union(pairs.select("pair_id", F.lit("y"), "b"))
    out = stats.pair_scores(pairs.select("pair_id"), notes, ("x", "y"))
    assert sorted(r.pair_id for r in out.where("review = 'sim'").collect()) == [1, 12]
    with pytest.raises(Exception, match="no score of every annotator"):
        stats.pair_scores(pairs.select("pair_id"), notes.where("not (annotator = 'y' and pair_id = 3)"), ("x", "y")).collect()


def test_describe_and_histogram(spark):
    df = spark.createDataFrame([("g", x) for x in (1, 2, 3, 10)], "g string, x int")
    r = stats.describe_by(df, "g", "x").first()
    assert (r.q25, r.q50, r.q75) == (1.75, 2.5, 4.75) and r.sd == pytest.approx(4.0824829)
    h = {r.bin: r.n for r in stats.histogram(df, "x", 3).collect()}
    assert h == {1: 3, 2: 0, 3: 1}
    assert sum(r.n for r in stats.histogram(df.where("false"), "x", 3).collect()) == 0


def test_mode_goes_to_the_first_seen(spark):
    df = spark.createDataFrame([("e", v, i) for i, v in enumerate((5, 4, 4, 5))], "g string, v int, i int")
    assert stats.mode_first(df, "g", "v", "i").first()["mode"] == 5


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "c c c c")], "id int, t string")
    counts = tfidf.term_counts(docs, "id", F.split("t", " "))
    n = F.lit(3)
    w = {(r.id, r.term): r.weight for r in tfidf.transform(counts, "id", tfidf.fit(counts, "id", n)).collect()}
    assert w[1, "a"] == pytest.approx(0.912202, abs=1e-5) and w[1, "b"] == pytest.approx(0.409742, abs=1e-5) and w[3, "c"] == pytest.approx(1)
    m = {r.term: r.mean_tfidf for r in tfidf.mean_weights(tfidf.transform(counts, "id", tfidf.fit(counts, "id", n)), n).collect()}
    assert m == pytest.approx({"a": 0.304067, "b": 0.372283, "c": 0.569036}, abs=1e-5)


def test_shuffled_pairs_use_each_word_once(spark):
    words = [f"w{i}" for i in range(10)]
    rows = tfidf.shuffled_pairs(spark.createDataFrame([(w,) for w in words], "term string"), "term").collect()
    assert sorted(x for r in rows for x in (r.word_1, r.word_2)) == words and {r.pair_id for r in rows} == {f"P00{i}" for i in range(1, 6)}


def test_report_without_denominators(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "t string, p string")
    r = {x.label: (x.precision, x.recall, x.f1, x.support) for x in stats.class_report(df, "t", "p").collect()}
    assert r["b"] == (0.0, 0.0, 0.0, 1) and r["a"][:2] == (0.5, 1.0)


def test_notes_join_on_two_keys(spark):
    scores = spark.createDataFrame([("a", "b", 1, 2), ("a", "c", 3, 3), ("d", None, 5, 1)], "w1 string, w2 string, x int, y int")
    notes = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("z", "z", 9.0)], "w1 string, w2 string, llm double")
    got = stats.with_notes(scores, notes, ["w1", "w2"], "llm")
    assert {(r.w1, r.w2): r.llm for r in got.collect()} == {("a", "b"): 1.0, ("a", "c"): 2.0, ("d", None): None}
    rows = {r.human: tuple(r)[1:] for r in stats.compared_scores(got, "llm", ["x", "y"]).collect()}
    assert rows == {"x": (3, 2, 1, 3.0, 1.5), "y": (3, 2, 0, 2.0, 1.5)}
    with pytest.raises(Exception, match="several notes for a b"):
        stats.with_notes(scores, notes.union(notes), ["w1", "w2"], "llm").collect()
    assert stats.compared_scores(got.where("false"), "llm", ["x", "y"]).count() == 0


def test_error_report_has_previews(spark):
    missed = spark.createDataFrame([(1, "t"), (2, "t")], "id int, truth string")
    texts = spark.createDataFrame([(1, "é" * 200)], "id int, text string")
    assert {r.id: r.preview for r in stats.error_report(missed, texts, "id", "text").collect()} == {1: "é" * 120, 2: None}
