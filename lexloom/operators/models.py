"""Parts that need a model or a service: the callable is a parameter, so that any model, or a table, can stand in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.vectors import cosine, mean_of

NOTE = "pair_id string, score double, reason string, model string"


def lemmatised(docs: DataFrame, key: str, text: str, analyse: Callable[[list[str]], list[list[tuple[str, str, str]]]], stop: list[str], tags: tuple[str, ...] = ("NOUN", "PROPN", "ADJ", "VERB")) -> DataFrame:
    """(key, place, lemma, form): kept tokens. ``analyse`` maps texts to lists of (form, lemma, tag).

    Lemmas are in Unicode normal form C. Acronyms keep their own form, in lower case; other tokens are alphabetic, of two letters or more, of a listed tag,
    and neither form nor lemma is a stopword.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = analyse(pdf[text].fillna("").tolist())
            rows = [(k, i, *t) for k, tokens in zip(pdf[key], parsed) for i, t in enumerate(tokens)]
            yield pd.DataFrame(rows, columns=[key, "place", "form", "lemma", "tag"])

    kind = dict(docs.dtypes)[key]
    parsed = docs.select(key, text).mapInPandas(run, f"{key} {kind}, place int, form string, lemma string, tag string")
    acronym = T.is_acronym("form")
    lemma = F.when(acronym, F.lower("form")).otherwise(F.trim(F.lower("lemma")))
    lemma = T.nfc(lemma)
    out = parsed.withColumn("lemma", lemma)
    alphabetic = F.regexp_like("form", F.lit("^\\p{L}{2,}$"))
    return out.where(alphabetic & (F.length("lemma") >= 2) & ~F.col("lemma").isin(stop) & ~F.lower("form").isin(stop) & (acronym | F.col("tag").isin(*tags))).select(
        key, "place", "lemma", F.lower("form").alias("form")
    )


def embedded(docs: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """(key, vector) by a model's ``encode``, in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            vectors = [list(map(float, v)) for lo in range(0, len(texts), batch) for v in encode(texts[lo : lo + batch])]
            yield pd.DataFrame({key: pdf[key], "vector": vectors})

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, vector array<double>")


def mean_pooled(tokens: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """(key, vector): mean of the tokens' static vectors. tokens: key, term; table: term, vector."""
    hit = tokens.join(table, "term").select(key, F.posexplode("vector").alias("d", "x"))
    per = hit.groupBy(key, "d").agg(F.avg("x").alias("x"))
    return per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("vector"))


def word_similarity(pairs: DataFrame, vectors: DataFrame, a: str = "word_1", b: str = "word_2", name: str = "similarity") -> DataFrame:
    """Pairs with the cosine of their words' mean vectors; a word of several tokens needs a vector of each. vectors: term, vector."""
    words = pairs.select(F.col(a).alias("word")).union(pairs.select(b)).distinct()
    parts = words.select("word", F.explode(F.split("word", " ")).alias("term")).join(vectors, "term", "left")
    means = parts.groupBy("word").agg(F.when(F.count_if(F.col("vector").isNull()) == 0, mean_of(F.collect_list("vector"))).alias("v"))
    x, y = means.withColumnsRenamed({"word": a, "v": "_x"}), means.withColumnsRenamed({"word": b, "v": "_y"})
    return pairs.join(x, a, "left").join(y, b, "left").withColumn(name, F.coalesce(cosine(F.col("_x"), F.col("_y")), F.lit(0.0))).drop("_x", "_y")


def unknown_words(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """Words with a token that has no vector. words: word."""
    return words.select("word", F.explode(F.split("word", " ")).alias("term")).join(vectors.select("term"), "term", "left_anti").select("word").distinct()


def noted(pairs: DataFrame, ask: Callable[[list[tuple[str, str]]], list[tuple[float, str]]], model: str, batch: int = 25, wait: float = 60.0, tries: int = 100) -> DataFrame:
    """Scores of word pairs by a service, ``batch`` pairs a request; a failed request is repeated after ``wait`` seconds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                for left in range(tries, 0, -1):
                    try:
                        got = ask(list(zip(part["word_1"], part["word_2"])))
                        break
                    except (ConnectionError, TimeoutError):
                        if left == 1:
                            raise
                        time.sleep(wait)
                yield pd.DataFrame({"pair_id": part["pair_id"], "score": [float(s) for s, _ in got], "reason": [r for _, r in got], "model": model})

    return pairs.select("pair_id", "word_1", "word_2").mapInPandas(run, NOTE)
