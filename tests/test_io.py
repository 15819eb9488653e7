from pyspark.sql import functions as F

from lexloom.sources import readers, sinks
from lexloom.streaming.score import scored_stream, tumbling


def test_exam_folders(spark, tmp_path):
    for name in ("02_b-fgv-2022", "01_a-fgv-2021", "notes"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "prova.txt").write_text("l1\nl2", encoding="utf-8")
    rows = readers.exam_texts(spark, str(tmp_path)).orderBy("folder").collect()
    assert [(r.exam, r.slug, r.text) for r in rows] == [("01", "a-fgv-2021", "l1\nl2"), ("02", "b-fgv-2022", "l1\nl2")]


def test_page_blocks(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<doc><page width="100" height="50"><flow><block xMin="1" yMin="2" xMax="30" yMax="4"><line><word>Olá</word><word>a&amp;b</word></line></block></flow></page></doc>', encoding="utf-8")
    r = readers.page_blocks(spark, str(tmp_path / "p.xml")).first()
    assert (r.width, r.x_min, r.lines) == (100.0, 1.0, ["Olá a&b"])


def test_csv_with_mark_and_annotations(spark, tmp_path):
    for who in "ab":
        (tmp_path / f"anotador_{who}.csv").write_bytes(f"﻿id_par,anotador,nota\nP001,{who},4\n".encode())
    assert readers.csv_strings(spark, str(tmp_path / "anotador_a.csv")).columns == ["id_par", "anotador", "nota"]
    assert {(r.annotator, r.score) for r in readers.annotations(spark, str(tmp_path / "anotador_*.csv")).collect()} == {("a", 4), ("b", 4)}


def test_read_through_makes_the_table_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([("P001", 0.5)], "pair_id string, score double")

    for _ in range(2):
        assert readers.read_through(spark, str(tmp_path / "notes"), "pair_id string, score double", make).first().score == 0.5
    assert len(calls) == 1


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("01-001", "dados", 2023, "FGV", "post", "Qual?", [("A", "sim"), ("B", "não")], "A")],
        "id string, area string, year int, banca string, post string, statement string, options array<struct<letra:string,texto:string>>, answer string",
    )
    sinks.texts(df, str(tmp_path / "txt"), sinks.record_text(), "area", "year")
    files = list((tmp_path / "txt").glob("area=dados/year=2023/*.txt"))
    assert len(files) == 1 and "(A) sim\n(B) não\n\n[GABARITO]\nA" in files[0].read_text(encoding="utf-8")
    r = readers.text_corpus(spark, str(tmp_path / "txt")).first()
    assert (r.id, r.statement, r.answer, [o.texto for o in r.options]) == ("01-001", "Qual?", "A", ["sim", "não"])
    wide = sinks.options_wide(spark.createDataFrame([(1, {"A": "x"})], "id int, options map<string,string>")).first()
    assert (wide.A, wide.E) == ("x", "")
    doc = sinks.corpus_document(df, spark.createDataFrame([("v1",)], "versao string"), order=("area", "year", "id"))
    doc.write.text(str(tmp_path / "doc"))
    back = readers.json_records(spark, str(tmp_path / "doc"), schema="id string, year int").first()
    assert (back.id, back.year) == ("01-001", 2023)


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, t string").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    scored_stream(stream, lambda df: df.withColumn("n", F.length("t")), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    e = spark.createDataFrame([(0, "x", 1.0), (3599, "x", 2.0), (3600, "x", 4.0)], "s long, k string, value double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.total for r in tumbling(e, "ts", "1 hour", "k").collect()) == [3.0, 4.0]
