import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import quality

ODD = [
    "", " ", "plain", "como descrito anteriormente", "DEſCRITA ANTERIORMENTE", "no texto 3", "NA TABELA 2", "queſtão anterior", "QUESTÃO ANTERIOR", "mesmo cenÁrio",
    "a figura a seguir", "a FİGURA a seguir", "fıgura abaixo", "diaKrama", "o grÁfico da rede acima", "observe o ESQUEMA", "a  b", "a  -", "x ", "□", "€" * 9 + "x",
    "a-\nb c", "-\nb", "a\t b  c\n\n d", "\n\nx", "a •", "x Tipo 1 - Branca 3", "• Tipo 2 – Branca", "Branca", "x · ±", "\x01\x02ab", "café 中",
]


def test_cheap_tests_change_no_flag(spark):
    df = spark.createDataFrame([(t, t.split("\n")) for t in ODD], "t string, l array<string>")
    share = F.when(F.length("t") > 0, F.length(F.regexp_replace("t", quality.ORDINARY + "+", "")) / F.length("t")).otherwise(0.0)
    whole = F.regexp_replace(F.array_join("l", "\n"), "^\n+", "")
    fold = F.trim(F.regexp_replace(F.regexp_replace(whole, "(^|[^ \n])-\n(?=\\p{Ll})", "$1"), "\\s+", " "))
    like = lambda p: F.regexp_like("t", F.lit(p))
    lower = F.lower("t")
    pairs = [
        (quality.odd_share(F.col("t")), share), (T.fold_lines("l"), fold), (quality._lost_gap(F.col("t")), like(quality.LOST_GAP)),
        (quality._found(F.col("t"), quality.ELSEWHERE, lower, quality.ELSEWHERE_PARTS), like(quality.ELSEWHERE)),
        (quality._found(F.col("t"), quality.PICTURE, lower, quality.PICTURE_PARTS), like(quality.PICTURE)),
        (F.regexp_like(quality.unusual(F.col("t")), F.lit(quality.UNCONVERTED)), like(quality.UNCONVERTED)),
    ]
    for r in df.select("t", *[c.alias(f"{x}{i}") for i, two in enumerate(pairs) for x, c in zip("ab", two)]).collect():
        assert [r[f"a{i}"] for i in range(len(pairs))] == [pytest.approx(r[f"b{i}"]) if isinstance(r[f"b{i}"], float) else r[f"b{i}"] for i in range(len(pairs))], r.t
    assert sum(r[0] for r in df.select(like(quality.ELSEWHERE)).collect()) >= 5 and sum(r[0] for r in df.select(like(quality.PICTURE)).collect()) >= 3


def test_records_are_dealt_to_several_tasks(spark):
    from lexloom import queries

    rows = queries._records(spark, "/root/testdata/sf0.01")
    assert spark.read.parquet("/root/testdata/sf0.01/documents.parquet").rdd.getNumPartitions() <= rows.rdd.getNumPartitions() > 1
