import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import dedup, exams, lexicon, lines, ml, quality
from lexloom.plans import corpus
from lexloom.queries import EXAM, EXAM_KEY

AREAS = [("software", ["java"], []), ("dados", ["sql"], []), ("redes", ["csma/cd", "servidor dns"], ["dns", "servidor"]), ("seguranca", ["sql injection", "controle de acesso"], [])]


def scores(spark, text):
    lex = lexicon.lexicon(spark, AREAS)
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return {r.area: r.score for r in lexicon.scores(df, "id", F.col("t"), lex).collect()}


def test_lexicon_traps(spark):
    assert scores(spark, "java Java java java") == {"software": 6}
    assert scores(spark, "javascript") == {}
    assert scores(spark, "sql injection") == {"dados": 2, "seguranca": 2}
    assert scores(spark, "Controle de acesso ao meio") == {"redes": 2}
    assert scores(spark, "servidor DNS") == {"redes": 4}


def test_ties_go_to_the_first_area(spark):
    lex = lexicon.lexicon(spark, AREAS)
    df = spark.createDataFrame([(1, "sql injection")], "id int, t string")
    d = lexicon.decide(lexicon.scores(df, "id", F.col("t"), lex), "id")
    assert d.first().area == "dados" and not d.first().confident
    assert [lexicon.in_domain(d, special=F.lit(s)).first().in_domain for s in (True, False)] == [True, False]


def test_domain_reason_by_section(spark):
    rows = [("Língua Portuguesa", 20, 3), ("Direito", 7, 2), ("Direito", 8, 2), ("Conhecimentos Específicos", 2, 1), (None, 2, 1)]
    out = spark.createDataFrame(rows, "s string, p int, k int").select(lexicon.domain_reason(F.col("s"), F.col("p"), F.col("k")).alias("r")).collect()
    assert [r.r for r in out] == ["fora_de_computacao_secao", "fora_de_computacao_secao", None, None, "fora_de_computacao_sem_termos_de_TI"]


def test_header_removal_keeps_options_and_pages(spark):
    rows = [("e", i, t) for i, t in enumerate(["Cabeçalho repetido longo"] * 4 + ["(A) opção repetida longa"] * 4 + ["curta"] * 5 + ["\f", "Página 3"])]
    out = lines.without_headers(spark.createDataFrame(rows, "exam string, line_no int, text string"), "exam")
    assert sorted(r.text for r in out.collect()) == ["\f"] + ["(A) opção repetida longa"] * 4 + ["curta"] * 5


def test_reading_order(spark):
    rows = [("p", 100.0, y, x0, x1, n) for n, y, x0, x1 in (("right", 10.0, 55.0, 95.0), ("left2", 20.0, 5.0, 45.0), ("head", 1.0, 5.0, 95.0), ("foot", 90.0, 5.0, 95.0), ("left1", 10.0, 5.0, 45.0))]
    out = lines.reading_order(spark.createDataFrame(rows, "page string, width double, y_min double, x_min double, x_max double, name string"), ["page"])
    assert [r.name for r in out.orderBy("place").collect()] == ["head", "left1", "left2", "right", "foot"]


def test_key_blocks():
    got = exams.blocks("Manhã\nAnalista Tipo 1 Branca\n\n1 2 3\n\nA C *\nTécnico Tipo 1\n1 2\nb X\n4\nZZ")
    assert [(b["header"], b["shift"], b["answers"]) for b in got] == [
        ("Manhã Analista Tipo 1 Branca", "manha", {1: "A", 2: "C", 3: "ANULADA"}),
        ("Técnico Tipo 1", "manha", {1: "B", 2: "ANULADA"}),
    ]


def test_exam_without_key_or_with_manual_key(spark):
    e = spark.createDataFrame([("01", "analista-exemplo-fgv-2023", EXAM)], "exam string, slug string, text string")
    none = spark.createDataFrame([], "exam string, text string")
    manual = spark.createDataFrame([("01", EXAM_KEY.replace("A C *", "B B B"))], "exam string, text string")
    rows = exams.records(e, none, manual=manual).orderBy("number").collect()
    assert [r.answer for r in rows] == ["B", "B", "B"] and rows[2].problems == ["questoes_mescladas"]
    assert all("sem_gabarito" in r.problems for r in exams.records(e, spark.createDataFrame([("01", EXAM_KEY)], "exam string, text string"), invalid=["01"]).collect())
    report = exams.extraction_report(e, spark.createDataFrame([("01", EXAM_KEY)], "exam string, text string"), exams.questions(e)).first()
    assert (report.n_questions, report.separated, report.similarity, report.key_used, report.alert) == (3, 3, 0.5, True, False)


def test_fuzzy_dedup_is_greedy_and_ordered(spark):
    base = "qual comando lista arquivos no linux"
    rows = [(1, base), (2, base + " hoje"), (3, base + " agora mesmo"), (4, base + " hoje"), (5, "outra coisa")]
    df = dedup.block_keys(spark.createDataFrame(rows, "position long, t string"), F.col("t"), prefix=20)
    got = {r.position: r.leader for r in dedup.leaders(dedup.similar_pairs(df, "position")).collect()}
    assert got == {2: 1, 4: 1}


def test_knn_and_vote(spark):
    votes = spark.createDataFrame([(1, "c"), (1, "a"), (1, "b")], "id long, label string")
    assert ml.vote(votes, "id").first().predicted == "a"
    train = spark.createDataFrame([(1, [0.0, 0.0], "x"), (2, [1.0, 0.0], "y"), (3, [1.0, 0.0], "z"), (4, [9.0, 9.0], "w")], "id long, v array<double>, label string")
    test = spark.createDataFrame([(7, [1.0, 0.1], "y")], "id long, v array<double>, label string")
    assert [r.neighbour for r in ml.nearest(train, test, "id", "v", "label", 3).orderBy("rank").collect()] == [2, 3, 1]


def test_corpus_invariants(spark):
    def q(i, text, section="Conhecimentos Específicos", answer="A", problems=()):
        return (f"01-{i:03d}", i, section, text, {"A": f"opção java {i}", "B": "outra"}, answer, list(problems))

    rows = [q(1, "Sobre java, qual a saída do programa?"), q(2, "Sobre java, qual a saída do programa??"), q(3, "Sobre flores"), q(4, "Texto java sql", problems=["enunciado_curto"]), q(5, "Consulta sql de dados", "Direito")]
    raw = spark.createDataFrame(rows, "id string, position long, section string, statement string, options map<string,string>, answer string, problems array<string>")
    lex = lexicon.lexicon(spark, AREAS)
    kept, gone = corpus.build_corpus(raw, lex)
    k, g = kept.collect(), gone.collect()
    assert len(k) + len(g) == len(rows) and all(r.reasons for r in g)
    assert {r.id: r.reasons for r in g} == {"01-002": ["duplicada"], "01-004": ["enunciado_curto"], "01-005": ["fora_de_computacao_secao"]}
    assert {r.id: r.also_in for r in k} == {"01-001": ["01-002"], "01-003": []}
    areas = {r.id: (r.area, r.origin) for r in corpus.assign_areas(kept, lex).collect()}
    assert areas["01-001"][0] == "software"


def test_flags(spark):
    got = {r.t: r.f for r in spark.createDataFrame([("a  b" * 20,), ("curto",), ("x" * 30 + "\n12",), ("Observe a figura e responda à questão",)], "t string").select("t", quality.text_flags("t").alias("f")).collect()}
    assert got["a  b" * 20] == ["espaco_de_simbolo_perdido"] and got["curto"] == ["enunciado_curto"] and got["x" * 30 + "\n12"] == ["fragmento_solto"]
    assert got["Observe a figura e responda à questão"] == ["depende_de_imagem"]


def test_logistic_queries_run_to_convergence_without_stopwords(spark, tmp_path, monkeypatch):
    from lexloom import queries
    from lexloom.operators import ml

    asked = []
    fit = ml.logistic
    monkeypatch.setattr(ml, "logistic", lambda *args, **more: (asked.append(more["max_iter"]), fit(*args, **more))[1])
    path = str(tmp_path)
    docs = [(i, f"the {'good fine' if i % 2 else 'poor bad'} and word{i % 7}") for i in range(60)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    model, _, vocabulary = queries._text_model(spark, path)
    assert {"good", "poor", "word3"} <= set(vocabulary) and not {"the", "and"} & set(vocabulary)
    assert asked == [2000] and model.stages[-1].summary.totalIterations < 2000


def test_footers_with_a_colour_go(spark):
    rows = [(1, i, t) for i, t in enumerate(["TIPO BRANCA – PÁGINA 8", "Tipo 1 Branca – Página 8", "tipo azul – página 12", "O tipo de página", "Página 3", "Questão"])]
    df = spark.createDataFrame(rows, "doc long, line_no int, text string")
    assert [r.text for r in lines.without_headers(df, "doc").orderBy("line_no").collect()] == ["O tipo de página", "Questão"]


def test_questions_need_their_options_and_their_turn():
    assert exams.numbered(["1", "q", "(A) x", "7", "(A) no", "2", "3", "(A) y", "4", "text", "5"]) == [0, 6]
    assert exams.numbered(["2", "(A)", "5", "(A)", "9", "(A)"]) == [0, 2] and exams.numbered(["4", "(A)"]) == []
    got = exams.split_body(["Stem", "(B) no", "(A) a", "(A) again", "(B)", "b", "(C) c.", "Redes de Dados"])
    assert got == {"statement": ["Stem", "(B) no"], "options": {"A": ["a", "(A) again"], "B": ["b"], "C": ["c."]}, "merged": True, "context": []}
    assert exams.split_body(["Stem"]) == {"statement": ["Stem"], "options": {}, "merged": False, "context": []}
    got = exams.split_body(["S", "(A) a", "•", "(B) b", "Texto 2", "More"])
    assert got["options"] == {"A": ["a"], "B": ["b"]} and got["context"] == ["Texto 2", "More"]


def test_folding_lines(spark):
    rows = [["", "", "-", "a"], ["a-", "b-", "c"], ["a -", "b"], ["a--", "b"], ["a", "-", "b"], ["a-", "B"], ["a- ", "b"], ["x-", "", "b"], []]
    want = ["a", "abc", "a - b", "a-b", "a - b", "a- B", "a- b", "x- b", ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, l array<string>")
    assert [r[0] for r in df.orderBy("i").select(T.fold_lines("l")).collect()] == want
