import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lexloom import queries
from lexloom.operators import sweep
from lexloom.operators.sweep import Setting

ROWS = [(i, i % 3, i % 2, t) for i, t in enumerate(["a b c", "a b", "b c c d", "a a e", "e f", "f a b", "c d", "a b e", "d d"])]


def test_vocabularies_are_fitted_outside_each_fold(spark):
    settings = [Setting("two", 2), Setting("pairs", None, bigrams=True), Setting("rare", None, max_df=0.5)]
    df = spark.createDataFrame(ROWS, "id long, fold int, y int, t string")
    counts = sweep.counted(df, "id", "fold", F.split("t", " "))
    got = {(r.setting, r.fold, r.term): r.idf for r in sweep.vocabularies(counts, df.groupBy("fold").agg(F.count(F.lit(1)).alias("n")), "fold", settings).collect()}
    want = {}
    for fold in range(3):
        docs = [t.split() for _, f, _, t in ROWS if f != fold]
        for s in settings:
            each = [d + ([f"{a} {b}" for a, b in zip(d, d[1:])] if s.bigrams else []) for d in docs]
            df_ = Counter(w for d in each for w in set(d))
            tf = Counter(w for d in each for w in d)
            terms = sorted((w for w in df_ if df_[w] <= s.max_df * len(docs)), key=lambda w: (-tf[w], w))[: s.size]
            want |= {(s.name, fold, w): math.log((1 + len(docs)) / (1 + df_[w])) + 1 for w in terms}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_votes_and_macro_f1(spark):
    df = spark.createDataFrame(ROWS, "id long, fold int, y int, t string")
    votes = sweep.neighbour_votes(df, "id", "fold", "y", F.split("t", " "), [Setting("all")], k=1).collect()
    assert len(votes) == len({v.id for v in votes}) <= 9 and all(v.truth == v.id % 2 and v.fold == v.id % 3 for v in votes)
    table = spark.createDataFrame([("x", 0, 0), ("x", 0, 1), ("x", 1, 1), ("y", 2, 0)], "s string, truth int, predicted int")
    got = {r.s: r.macro_f1 for r in sweep.macro_f1(table, "s").collect()}
    assert abs(got["x"] - 2 / 3) < 1e-12 and got["y"] == 0


def test_joint_errors(spark):
    truth = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "id long, truth int")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "id long, text string")
    models = [(n, spark.createDataFrame(rows, "id long, predicted double")) for n, rows in (("a", [(1, 1.0), (2, 1.0), (3, 0.0)]), ("b", [(1, 1.0), (2, 0.0), (3, 0.0)]), ("c", [(1, 1.0), (2, 1.0), (3, 0.0), (4, 0.0)]))]
    got = queries.joint_errors(models, truth, texts, "id").collect()
    assert sorted((r.id, r.truth, r.a, r.b, r.c, r.preview) for r in got) == [(1, 0, 1, 1, 1, "text 1"), (3, 1, 0, 0, 0, "text 3")]


def test_rows_of_one_setting_and_fold_meet_only_each_other(spark, monkeypatch):
    met = []
    monkeypatch.setattr(sweep.neighbours, "best_met", lambda train, test, *a, real=sweep.neighbours.best_met: (met.append((train, test, a[-1])), real(train, test, *a))[1])
    df = spark.createDataFrame(ROWS, "id long, fold int, y int, t string")
    votes = {(v.setting, v.id): v.predicted for v in sweep.neighbour_votes(df, "id", "fold", "y", F.split("t", " "), [Setting("all", 9), Setting("few", 2)], k=2).collect()}
    train, test, groups = met[0]
    assert groups == 6 and {r.s for r in train.collect()} <= set(range(6)) and test.count() <= 18
    for name in ("all", "few"):
        alone = sweep.neighbour_votes(df, "id", "fold", "y", F.split("t", " "), [Setting(name, 9 if name == "all" else 2)], k=2).collect()
        assert alone and {v.id: v.predicted for v in alone} == {i: p for (s, i), p in votes.items() if s == name}


def _wide_rows(n=240):
    """Rows of words and pairs, with copies within and across folds, empty and null texts."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(30)], k=r.randint(1, 25))) for _ in range(n - 60)]
    texts += [texts[3]] * 30 + [texts[7] + " w1 w2"] * 26 + ["", None, "rare", "w0"]
    return [(i, i * 7 % 5, i % 3, t) for i, t in enumerate(texts)]


def _brute(rows, setting, k):
    """(id: predicted) of one setting, row by row."""
    docs = {i: ([] if t is None else t.split(" ")) for i, _, _, t in rows}
    if setting.bigrams:
        docs = {i: d + [f"{a} {b}" for a, b in zip(d, d[1:])] for i, d in docs.items()}
    out = {}
    for fold in {f for _, f, _, _ in rows}:
        train = [i for i, f, _, _ in rows if f != fold]
        df, tf = Counter(w for i in train for w in set(docs[i])), Counter(w for i in train for w in docs[i])
        terms = sorted((w for w in df if df[w] <= setting.max_df * len(train)), key=lambda w: (-tf[w], w))[: setting.size]
        idf = {w: math.log((1 + len(train)) / (1 + df[w])) + 1 for w in terms}
        weights = {}
        for i, d in docs.items():
            x = {w: (1 + math.log(c)) * idf[w] for w, c in Counter(d).items() if w in idf}
            norm = math.sqrt(sum(v * v for v in x.values()))
            weights[i] = {w: v / norm for w, v in x.items()}
        for i, f, _, _ in rows:
            if f == fold:
                dots = sorted((-round(sum(v * weights[j].get(w, 0) for w, v in weights[i].items()), 12), j) for j in train)
                near = [rows[j][2] for d, j in dots[:k] if d < 0]
                if near:
                    out[i] = min(near, key=lambda y: (-near.count(y), y))
    return out


def test_a_row_is_kept_once_for_all_settings_and_folds(spark, monkeypatch):
    monkeypatch.setattr(sweep.neighbours, "best_met", None)  # which needs a row for each setting and fold
    monkeypatch.setattr(sweep.chunked, "HELD_ROWS", 50)
    monkeypatch.setattr(sweep.chunked, "HELD_CELLS", 300)
    monkeypatch.setattr(sweep.chunked, "TILE", 7)
    monkeypatch.setattr(sweep.chunked, "FIRST", 5)
    stored, real = {}, sweep.chunked.kept
    monkeypatch.setattr(sweep.chunked, "kept", lambda df, label, *a: stored.setdefault(label, real(df, label, *a)))
    rows = _wide_rows()
    settings = [Setting("few", 6), Setting("pairs", 40, bigrams=True), Setting("all", 1000, bigrams=True), Setting("rare", 12, max_df=0.4)]
    df = spark.createDataFrame(rows, "id long, fold int, y int, t string")
    votes = sweep.neighbour_votes(df, "id", "fold", "y", F.split("t", " "), settings).collect()
    assert all(v.truth == v.id % 3 and v.fold == v.id * 7 % 5 for v in votes)
    for s in settings:
        assert {v.id: v.predicted for v in votes if v.setting == s.name} == _brute(rows, s, 3), s
    assert stored["coded"].count() <= len(rows)


def test_sieved_vocabularies_are_those_of_all_counts(spark):
    rows = _wide_rows()
    df = spark.createDataFrame(rows, "id long, fold int, y int, s string").withColumn("t", F.split("s", " "))
    sizes = df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    settings = [Setting("few", 6), Setting("pairs", 25, bigrams=True), Setting("rare pairs", 20, bigrams=True, max_df=0.3), Setting("all", 5000, bigrams=True)]
    every = sweep.vocabularies(sweep.counted(df, "id", "fold", F.col("t")), sizes, "fold", settings)
    sieved = sweep.sieved_vocabularies(df, sizes, "fold", settings)
    rounded = lambda x: sorted((r.setting, r.fold, r.term, round(r.idf, 12)) for r in x.collect())
    assert rounded(sieved) == rounded(every)
