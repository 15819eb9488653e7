import random
import re

import pytest

from lexloom.functions import text as T
from lexloom.operators import lexicon


def plain(text, term):
    return len(re.findall(r"(?<!\w)" + re.escape(term) + r"(?!\w)", text))


@pytest.mark.parametrize("limit", [lexicon.BROADCAST_TERMS, 3])
def test_term_hits_match_one_expression_a_term(spark, monkeypatch, limit):
    monkeypatch.setattr(lexicon, "BROADCAST_TERMS", limit)
    rng = random.Random(limit)
    terms = ["sql", "sql injection", "c#", ".net", "a a", "a a a", "ci/cd", "iso/iec 27", "802.11", "c", "x_1", "servidor dns", "dns", "a b a", "#", "é", "a"]
    pieces = ["sql", "injection", "c#", "c", ".net", "net", "a", "b", "ci/cd", "iso/iec", "27", "802.11", "802.111", "x_1", "servidor", "dns", "#", "é", "_", "csharp"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", " ", " ", "", ".", "  ", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {(r.id, r.term): r.n for r in lexicon.term_hits(df, "id", T.col("t"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(i, t): n for i, text in enumerate(texts) for t in terms if (n := plain(text, t))}


def test_scores_of_phrases(spark):
    lex = lexicon.lexicon(spark, [("security", ["controle de acesso", "sql injection"], ["senha"]), ("data", ["sql"], []), ("networks", ["csma/cd"], [])])
    texts = [(1, "SQL Injection, sql injection e SENHA senha"), (2, "Controle de Acesso ao Meio"), (3, None), (4, "nada")]
    got = {(r.id, r.area): (r.score, r.strong) for r in lexicon.scores(spark.createDataFrame(texts, "id long, t string"), "id", T.col("t"), lex).collect()}
    assert got == {(1, "security"): (5, 1), (1, "data"): (4, 1), (2, "networks"): (2, 1)}
    assert lexicon.scores(spark.createDataFrame(texts, "id long, t string"), "id", T.col("t"), lex.limit(0)).count() == 0
