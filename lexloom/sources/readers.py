"""Readers with declared schemas."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import lines

RAW_QUESTION = (
    "id string, prova string, ano int, banca string, url string, numero int, secao string, enunciado string, alternativas map<string,string>, gabarito string, problemas array<string>"
)
QUESTION = (
    "id string, subarea string, origem_subarea string, ano int, banca string, cargo_orgao string, prova string, url_prova string, numero_na_prova int, secao_na_prova string,"
    " enunciado string, alternativas array<struct<letra:string,texto:string>>, gabarito string, resposta_correta string, tambem_em array<string>, pontuacao_subareas map<string,int>"
)
PAGE = "_width double, _height double, flow array<struct<block:array<struct<_xMin:double,_yMin:double,_xMax:double,_yMax:double,line:array<struct<word:array<struct<_VALUE:string>>>>>>>>"


def exam_texts(spark: SparkSession, base: str, file: str = "prova.txt") -> DataFrame:
    """(exam, slug, folder, text) of ``<base>/NN_slug/<file>``, whole files, by folder name."""
    df = spark.read.text(f"{base}/*/{file}", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("folder"), F.col("value").alias("text"))
    df = df.withColumn("folder", F.url_decode(F.replace("folder", F.lit("+"), F.lit("%2B"))))
    return df.where(F.regexp_like("folder", F.lit("^[0-9]{2}_"))).select(T.exam_number("folder").alias("exam"), T.exam_slug("folder").alias("slug"), "folder", "text")


def json_lines(spark: SparkSession, path: str, schema: str = RAW_QUESTION) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_records(spark: SparkSession, path: str, field: str = "questoes", schema: str = QUESTION) -> DataFrame:
    """The rows of an array inside one JSON document."""
    return spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", True).json(path).selectExpr(f"inline({field})")


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all strings, a byte-order mark tolerated."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def annotations(spark: SparkSession, glob: str) -> DataFrame:
    """(pair_id, annotator, score, file) of all annotation files, one per annotator."""
    df = spark.read.option("header", True).schema("id_par string, anotador string, nota int").csv(glob)
    return df.select(F.col("id_par").alias("pair_id"), F.col("anotador").alias("annotator"), F.col("nota").alias("score"), F.col("_metadata.file_name").alias("file"))


def text_corpus(spark: SparkSession, base: str) -> DataFrame:
    """One-record text files ``<base>/<area>/<year>/<id>.txt`` (or ``area=<area>/year=<year>``) with labelled parts."""
    df = spark.read.text(f"{base}/*/*/*.txt", wholetext=True).select("value", F.split(F.col("_metadata.file_path"), "/").alias("path"))
    bare = lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")
    head = lambda name: bare(F.regexp_extract("value", f"(?m)^{name}:(.*)$", 1))
    part = lambda name, after: bare(F.regexp_extract("value", f"(?s)\\[{name}\\]\\n(.*?)(?=\\n\\n\\[{after}\\]|$)" if after else f"(?s)\\[{name}\\]\\n(.*)$", 1))
    folder = lambda i: F.regexp_replace(F.element_at("path", i), "^[a-z]+=", "")
    options = F.regexp_extract_all(part("ALTERNATIVAS", "GABARITO"), F.lit("(?m)^\\(([A-E])\\) (.*)$"), F.lit(0))
    return df.select(
        head("ID").alias("id"), folder(-3).alias("area"), folder(-2).cast("int").alias("year"), head("BANCA").alias("banca"), head("CARGO/ÓRGÃO").alias("post"),
        part("ENUNCIADO", "ALTERNATIVAS").alias("statement"),
        F.transform(options, lambda x: F.struct(F.substring(x, 2, 1).alias("letra"), F.substring(x, F.lit(5), F.length(x)).alias("texto"))).alias("options"), part("GABARITO", "").alias("answer"),
    )


def page_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, width, block, x_min, y_min, x_max, lines) of XHTML with positioned blocks."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path).withColumn("file", F.input_file_name()).withColumn("page", F.monotonically_increasing_id())
    blocks = pages.select("file", "page", F.col("_width").alias("width"), F.posexplode(F.flatten(F.col("flow.block"))).alias("block", "b"))
    lines = F.transform("b.line", lambda ln: F.array_join(ln["word"]["_VALUE"], " "))
    return blocks.select("file", "page", "width", "block", F.col("b._xMin").alias("x_min"), F.col("b._yMin").alias("y_min"), F.col("b._xMax").alias("x_max"), lines.alias("lines"))


def xhtml_blocks(df: DataFrame, key: str, xhtml: str) -> DataFrame:
    """(key, page, width, block, x_min, y_min, x_max, lines) of positioned pages held as text, as a converter prints them.

    The document type goes, and ampersands that begin no reference are escaped, before each page element is parsed. Pages
    are numbered from 0 in their document; a page that is no well-formed markup has no blocks.
    """
    whole = F.regexp_replace(F.regexp_replace(F.col(xhtml), "<!DOCTYPE[^>]*>", ""), "&(?!(amp|lt|gt|quot|apos|#[0-9]+);)", "&amp;")
    pages = df.select(key, F.posexplode(F.regexp_extract_all(whole, F.lit("(?s)<page\\b.*?</page>"), F.lit(0))).alias("page", "x"))
    parsed = pages.select(key, "page", F.from_xml("x", PAGE, {"rowTag": "page"}).alias("p"))
    blocks = parsed.select(key, "page", F.col("p._width").alias("width"), F.posexplode(F.flatten(F.filter(F.col("p.flow.block"), lambda b: b.isNotNull()))).alias("block", "b"))
    words = F.transform("b.line", lambda ln: F.array_join(F.transform(ln["word"], lambda w: F.coalesce(w["_VALUE"], F.lit(""))), " "))
    return blocks.select(key, "page", "width", "block", F.col("b._xMin").alias("x_min"), F.col("b._yMin").alias("y_min"), F.col("b._xMax").alias("x_max"), words.alias("lines"))


#: Lines that conversion leaves behind: watermark, site, publisher, page numbers. Fixed values.
NOISE = "(?iu)^(pcimarkpci(?![\\p{L}\\p{N}_]).*|www\\.pciconcursos\\.com\\.br|FGV Conhecimento|Página [0-9]+( de [0-9]+)?)$"


def layout_texts(blocks: DataFrame, key: str) -> DataFrame:
    """(key, text): the lines of positioned blocks in reading order, without noise; pages are parted by a form feed line."""
    ordered = lines.reading_order(blocks, [key, "page"])
    each = ordered.select(key, "page", "place", F.posexplode("lines").alias("i", "line")).withColumn("line", T.unescape("line"))
    each = each.withColumn("line", F.regexp_replace("line", "^\\s+|\\s+$", ""))
    good = each.where((F.col("line") != "") & ~F.regexp_like("line", F.lit(NOISE)))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "i", "line"))), lambda x: x["line"]), "\n")
    pages = blocks.select(key, "page").distinct().join(good.groupBy(key, "page").agg(listed.alias("t")), [key, "page"], "left")
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("t", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\f\n").alias("text"))


def pdf_texts(spark: SparkSession, glob: str, command: tuple[str, ...] = ("pdftotext", "-bbox-layout"), key_command: tuple[str, ...] = ("pdftotext", "-layout")) -> DataFrame:
    """(path, text) of PDFs by an external program on the executors; answer keys keep their layout. Invalid UTF-8 is replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                program = key_command if "gabarito" in path.rsplit("/", 1)[-1].lower() else command
                out.append(subprocess.run([*program, "-", "-"], input=content, capture_output=True, check=True).stdout.decode("utf-8", "replace"))
            yield pd.DataFrame({"path": pdf["path"], "text": out})

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "path string, text string")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_through(spark: SparkSession, path: str, schema: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The CSV table at ``path``, made and written first if it is not there; always read from the file."""
    if not exists(spark, path):
        make().write.option("header", True).csv(path)
    return csv_typed(spark, path, schema)


def sheet(spark: SparkSession, path: str, columns: dict[str, str], required: str) -> DataFrame:
    """A spreadsheet exported to CSV: columns renamed, trimmed and lower-cased, rows without ``required`` dropped."""
    df = csv_strings(spark, path).dropna(subset=[required])
    return df.select(*[F.lower(F.trim(F.col(a))).alias(b) for a, b in columns.items()])
