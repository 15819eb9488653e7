"""Operators 2, 5, 7 and 10: accuracy on held-out rows, and the defined edge cases."""

import random
import zlib

import pytest

from lexloom.llm import language_id, quality, toxicity, url_filter
from lexloom.llm.language_id import identify_language
from lexloom.llm.quality import score_quality
from lexloom.llm.toxicity import reject_toxic, score_toxicity
from lexloom.llm.url_filter import url_filter as judge

SYLLABLES = {"xx": ["ka", "lo", "mi", "ter"], "yy": ["ßu", "öng", "sch", "at"], "zz": ["ción", "que", "ll", "ar"]}
BAD = ["grobnik", "flumpard", "skrelding", "vantorque"]


def words(rng, lang, n):
    return ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(2, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(900):
        lang = rng.choice(list(SYLLABLES))
        w = words(rng, lang, rng.randint(30, 120))
        toxic, good = rng.random() < 0.2, rng.random() < 0.6
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        if not good:
            w = [x + "###" for x in w]
        docs.append((i, " ".join(w), lang, "s"))
        labels.append((i, int(good), int(toxic)))
    docs += [(2000, None, None, None), (2001, "", None, None), (2002, "123 !", "xx", None), (None, "kalo mi", "xx", None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def fold(i, m, r):
    return i is not None and zlib.crc32(str(i).encode()) % m == r


def accuracy(rows, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_toxicity(spark, made):
    docs, labels = made
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == fold(r.doc_id, 5, 0) for r in rows)
    assert accuracy(rows, labels, "toxic") > 0.98
    kept = reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in rows)
    assert score_toxicity(docs.where("false"), labels).collect() == [] and {r.score for r in score_toxicity(docs, labels.where("false")).collect()} == {0.5}


def test_misspelled_terms_decide_and_ordinary_neighbours_do_not(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        w, toxic = words(rng, "xx", rng.randint(20, 60)), i % 8 == 0
        if toxic:
            w[5:5] = rng.sample(["moron", *BAD], 2)
        elif i % 3 == 0:  # common clean words beside two of the terms
            w[5:5] = ["oron", "vantorgue"]
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    wrong = [" ".join(words(rng, "xx", 20) + [*x, *words(rng, "xx", 20)]) for x in (["grobnyk", "flumpaard"], ["skreldig", "grobik", "moroon"], ["vantorqe", "flumperd"])]
    clean = [" ".join(words(rng, "xx", 20) + ["oron", "vantorgue"] * n) for n in (1, 9)]
    docs += list(enumerate(wrong + clean, 2000))
    got = {r.doc_id: r for r in score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[i].predicted for i in range(2000, 2005)] == [1, 1, 1, 0, 0]
    assert [got[i].hits for i in range(2000, 2005)] == [2, 3, 2, 0, 0]


def test_lexicon_compares_shares_of_the_classes():
    def learned(n_toxic, n_clean, in_toxic, in_clean):
        rows = [(f"t{i} " + "blorpish " * (i < in_toxic), 1) for i in range(n_toxic)] + [(f"c{i} " + "blorpish " * (i < in_clean), 0) for i in range(n_clean)]
        return toxicity.learn_lexicon(rows)[0]

    assert learned(50, 1000, 16, 1) == learned(50, 1000, 8, 2) == learned(500, 500, 40, 2) == learned(20, 20, 3, 0) == ["blorpish"]
    assert learned(50, 1000, 8, 10) == learned(1000, 50, 40, 1) == []


def test_levenshtein_trie():
    a = toxicity.Automaton(["idiot", "disgusting", "scum"], ["vequ"])
    want = {"idiot": 0, "idiiot": 1, "idot": 1, "idioz": 1, "idiotic": -1, "disgustnig": 2, "dsgustng": 2, "scum": 0, "scam": -1, "vequique": 0, "veqique": -1, "idi": -1, "": -1}
    assert {w: a.errors(w) for w in want} == want

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, old = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
        return row[-1]

    rng = random.Random(2)
    for _ in range(3000):
        w = list(rng.choice(["idiot", "disgusting", "scum"]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "i", "s"])
        w = "".join(w)
        near = [d for t in ("idiot", "disgusting", "scum") if (d := distance(w, t)) <= toxicity.allowed(t)]
        if not w.startswith("vequ"):
            assert a.errors(w) == min(near, default=-1), w


def test_quotation_is_told_from_abuse():
    known = toxicity.Known(toxicity.Automaton(["idiot"], []))
    assert toxicity.features("you idiot go home", known).tolist() == [1, 0, 0, 0]
    assert toxicity.features("they wrote “idiot” on it", known).tolist() == [0, 0, 1, 0]
    assert toxicity.features("the word idiott is rude", known).tolist() == [0, 0, 0, 1]
    assert toxicity.features("nothing here", known) is None


def test_quality(spark, made, monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 3)
    docs, labels = made
    rows = score_quality(docs, labels, per_class=150).collect()
    assert len(rows) == 904 and all(0 <= r.score <= 1 and r.held_out == fold(r.doc_id, 3, 1) for r in rows)
    assert accuracy(rows, labels, "quality") > 0.95
    assert score_quality(docs.where("false"), labels).collect() == []


def test_network_sees_every_byte_and_its_gradients_are_right(monkeypatch):
    net = quality.Network()
    rng = random.Random(5)
    text = bytes(rng.randrange(97, 123) for _ in range(3000))
    whole = net.blocks(text)[0]
    monkeypatch.setattr(quality, "PIECE", 2 * quality.BLOCK)
    assert (net.blocks(text)[0] == whole).all() and (net.blocks(text, True)[0] == whole).all()
    grads = [quality.np.zeros_like(p) for p in (net.table, net.bias, net.out)]
    before = net.gradients(text, 1, grads)
    k, b, f = quality.np.unravel_index(quality.np.abs(grads[0]).argmax(), grads[0].shape)
    net.table[k, b, f] += 1e-3
    after = net.gradients(text, 1, [quality.np.zeros_like(p) for p in (net.table, net.bias, net.out)])
    assert (after - before) / 1e-3 == pytest.approx(grads[0][k, b, f], rel=0.1)


def test_language(spark, made):
    docs, _ = made
    rows = {r.doc_id: r for r in identify_language(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in rows if i is not None and i < 900 and rows[i].held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in rows.values())
    assert [rows[i].lang_pred for i in (2000, 2001, 2002)] == ["und"] * 3 and rows[None].lang_pred == "xx"
    assert identify_language(docs.where("false")).collect() == [] and {r.lang_pred for r in identify_language(docs.selectExpr("doc_id", "text", "null :: string as lang")).collect()} == {"und"}


def test_codewords_differ():
    for n in (1, 2, 3, 5, 20):
        code = language_id.codewords(n)
        assert len(code) == n and len({tuple(c) for c in code}) == n


@pytest.fixture(scope="module")
def urls(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        good = rng.random() < 0.5
        name = "".join(rng.choices("abcd" if good else "wxyz", k=6))
        rows.append((i, f"https://{name}.{'org' if good else 'com'}/{'x' if good else 'de'}/{rng.randrange(999)}", "h", "p"))
        rows.append((1000 + i, f"http://{name}.net/en/{rng.randrange(999)}?q", "h", "p"))
    rows += [(5000, None, "h", "p"), (5001, "no scheme", "h", "p"), (5002, "HTTP://Sub.EXAMPLE.org/es/1", "h", "p"), (5003, "x://org", "h", "p"), (5004, "x://example.org/en/1", "h", "p"), (5005, "x://nexample.org/en/1#a", "h", "p")]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string")


def test_url_rules_and_model(urls):
    got = {r.page_id: r for r in judge(urls).collect()}
    want = {5000: ("", "", None), 5001: ("", "", None), 5002: ("sub.example.org", "/es/1", "example.org/es/"), 5003: ("org", "", None), 5004: ("example.org", "/en/1", "example.org/en/1"), 5005: ("nexample.org", "/en/1", "org/")}
    assert {i: (got[i].host, got[i].path, got[i].rule) for i in want} == want
    assert [got[i].verdict for i in (5002, 5004, 5005)] == ["block", "block", "allow"]
    truth = {r.page_id: r.url for r in urls.collect()}
    right = sum((got[i].verdict == "allow") == (truth[i][7] in "abcd") for i in range(1000, 1400))
    assert right / 400 > 0.97 and all(got[i].rule is None for i in range(1000, 1400))
    assert judge(urls.where("false")).collect() == []
    assert {r.verdict for r in judge(urls.where("page_id between 1000 and 1399")).collect()} == {"allow"}


def test_grams_across_a_piece_border_count_once(monkeypatch):
    text = bytes(random.Random(2).randrange(97, 123) for _ in range(5_000))
    whole = language_id.grams(text)
    for piece in (7, 64, 1_000, 4_999):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert abs(language_id.grams(text) - whole).max() < 1e-6
