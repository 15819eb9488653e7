from pyspark.sql import functions as F

from lexloom.functions import text as T


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def test_norm_and_squash(spark):
    assert value(spark, T.norm("t"), "Órgão É nº") == "orgao e nº"
    assert value(spark, T.squash("t"), "Á-b_c 1!") == "ab_c1"
    assert value(spark, T.ascii_tokens("t"), "Ação 2, ação") == ["acao", "2"]


def test_token_rule(spark):
    assert value(spark, T.tokens("t"), "isn’t ab.c u_v x² ½") == ["isn’t", "ab.c", "u_v", "x²", "½"]


def test_fold_removes_hyphen_only_before_lower_case(spark):
    fold = T.fold_lines(F.split("t", "\n"))
    assert value(spark, fold, "termi-\nnal") == "terminal"
    assert value(spark, fold, "termi-\nNal") == "termi- Nal"
    assert value(spark, fold, "a -\nb") == "a - b"


def test_exam_columns(spark):
    slug = "agente-da-ti-fgv-2023-2"
    assert value(spark, T.exam_year("t"), slug) == 2023
    assert value(spark, T.exam_title("t"), slug) == "agente da ti"
    assert value(spark, T.exam_type("t"), "PROVA  T I P O 3") == 3
    assert value(spark, T.exam_type("t"), "nada") == 1
    assert value(spark, T.exam_shift("t"), "x-tarde-y") == "tarde"
    assert [value(spark, T.header_type("t"), x) for x in ("Cargo Tipo 2", "cargo 3 turno", "Branca", "Cargo")] == [2, 3, 1, None]
    assert [value(spark, T.answer("t"), x) for x in ("a", "*", "X")] == ["A", "ANULADA", "ANULADA"]


def test_symbols_and_acronyms(spark):
    assert value(spark, T.symbols("t"), "ab") == "•a≥b"
    assert [value(spark, T.is_acronym("t"), x) for x in ("TCP", "Tcp", "12", "A")] == [True, False, False, False]


def test_options_as_letters(spark):
    m = F.from_json("t", "map<string,string>")
    assert [tuple(x) for x in value(spark, T.lettered(m), '{"A": "ls", "B": "cd"}')] == [("A", "ls"), ("B", "cd")]
    assert value(spark, T.lettered(m), "{}") == [] and value(spark, T.lettered(m), None) is None


def test_nfc_date_and_percent(spark):
    assert [value(spark, T.nfc("t"), x) for x in ("ac\u0327a\u0303o", "plain", "\u00e9", "", None)] == ["a\u00e7\u00e3o", "plain", "\u00e9", "", None]
    at = F.to_timestamp_ntz("t")
    assert [value(spark, T.today(at=at), x) for x in ("2024-03-01 01:30:00", "2024-03-01 04:00:00")] == ["2024-02-29", "2024-03-01"]
    assert len(value(spark, T.today(), "")) == 10
    assert [value(spark, T.percent(F.col("t").cast("double")), x) for x in ("0.1234", "1")] == ["12.3%", "100.0%"]


def test_lemmas_are_composed(spark):
    from lexloom.operators import models

    def analyse(texts):
        return [[("Ac\u0327a\u0303o", "ac\u0327a\u0303o", "NOUN"), ("TCP", "tcpe", "X"), ("Rede", " rede ", "NOUN"), ("de", "de", "ADP")] if t else [] for t in texts]

    docs = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    got = [(r.id, r.place, r.lemma) for r in models.lemmatised(docs, "id", "t", analyse, ["de"]).orderBy("id", "place").collect()]
    # a form with loose marks is not alphabetic
    assert got == [(1, 1, "tcp"), (1, 2, "rede")]
    got = models.lemmatised(docs, "id", "t", lambda ts: [[("ações", "ac\u0327a\u0303o", "NOUN")] for _ in ts], ["de"])
    assert {r.lemma for r in got.collect()} == {"a\u00e7\u00e3o"}
