import random

import pytest
from pyspark.sql import functions as F
from test_dedup import greedy, squash

from lexloom import queries
from lexloom.operators import automata, lexicon, quality


@pytest.mark.parametrize("segment", [3, 256])
def test_automata_match_a_loop(spark, monkeypatch, segment):
    monkeypatch.setattr(automata, "SEGMENT", segment)
    rng = random.Random(segment)
    table = automata.letter_sequence()
    assert table[0] == [0, 1, 0, 0, 0, 0] and table[5][1] == 1 and table[3][4] == 4
    keys = {"long": 120, "one": 1, None: 7, "x": 28}
    rows = [(k, i, rng.choice([0, 1, 2, 3, 4, 5, None, i % 5 + 1])) for k, n in keys.items() for i in range(n)]
    got = {(r.k, r.i): (r.before, r.after) for r in automata.run(spark.createDataFrame(rows, "k string, i int, x int"), "k", "i", F.col("x"), table).collect()}
    want, state = {}, {}
    for k, i, x in rows:
        before = state.get(k, 0)
        state[k] = before if x is None else table[before][x]
        want[k, i] = (before, state[k])
    assert got == want


def test_automaton_of_nothing(spark):
    none = spark.createDataFrame([], "k string, i int, x int")
    assert automata.run(none, "k", "i", F.col("x"), [[0]]).count() == 0


def test_an_assembled_corpus(spark):
    rng = random.Random(4)
    words = "the and that with of to is in rede banco dados chave valor linha".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(60):
        if rows and rng.random() < 0.4:
            _, source, s, o, answer = rng.choice(rows)
            s, o = s + rng.choice(["", " x", " rede rede rede"]), rng.choice([o, o, text(6)])
        else:
            source, s, o, answer = rng.choice(["src1", "Direito", "Informática"]), text(rng.choice([5, 15])), text(6), rng.choice(["A", "A", "B", "ANULADA"])
        rows.append((i, source, s, o, answer))
    data = [(i, source, [s], {x: [o] if x == "A" else [f"option {x}"] for x in "ABCDE"}, False, False, 5, answer) for i, source, s, o, answer in rows]
    schema = "doc_id long, source string, statement array<string>, options map<string,array<string>>, merged boolean, received_context boolean, n_options int, answer string"
    lex = lexicon.stopword_lexicon(spark)
    got = {r.doc_id: r for r in queries.assembled(quality.flagged(spark.createDataFrame(data, schema)), lex).collect()}
    assert sorted(got) == list(range(60))
    clean = [(i, s, "".join([o, *(f"option {x}" for x in "BCDE")])) for i, _, s, o, _ in rows if got[i].kept or got[i].reasons == "duplicada"]
    led, _ = greedy(clean, 150)
    assert {i for i, r in got.items() if r.reasons == "duplicada"} == set(led) and led
    for i, r in got.items():
        assert r.kept == (r.reasons == "") and (r.area is not None) == r.kept
        also = [int(x) for x in r.also_in.split(",") if x]
        assert sorted(also) == sorted(j for j, leader in led.items() if leader == i)
        source, s, answer = rows[i][1], rows[i][2], rows[i][4]
        assert ("questao_anulada" in r.reasons) == (answer == "ANULADA")
        assert ("enunciado_curto" in r.reasons) == (len(" ".join(s.split())) < 25) and squash(s)
        if source == "Informática" and not r.kept:
            assert "fora_de_computacao_secao" not in r.reasons
    assert {r.origin for r in got.values() if r.kept} <= {"palavras_chave", "knn"}
