"""TF-IDF as a long table (doc, term, weight): sublinear tf, smooth idf, L2 norm after filtering."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType


def term_counts(docs: DataFrame, key: str, tokens: Column, *more: str) -> DataFrame:
    """(key, more, term, tf). ``more`` are columns that a key has once."""
    return docs.select(key, *more, F.explode(tokens).alias("term")).groupBy(key, *more, "term").agg(F.count(F.lit(1)).alias("tf"))


def listed_counts(docs: DataFrame, key: str, text: str, tokens: Callable[[Column], Column], *more: str) -> DataFrame:
    """(key, more, terms, tfs): a key's terms and how often each occurs, as two lists. ``more`` are columns that a key has once.

    ``tokens`` cuts a text into words without blanks, none of which goes over a line. Texts are dealt by key and counted in
    the task that holds them, so that their words are no rows.
    """
    whole = docs.groupBy(key, *more).agg(F.concat_ws("\n", F.collect_list(text)).alias("_t"))
    words = whole.select(key, *more, F.array_join(tokens(F.col("_t")), " ").alias("_w"))
    schema = StructType([*words.schema.fields[:-1], StructField("terms", ArrayType(StringType())), StructField("tfs", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tfs, ends = [], [], [0]
            for joined in batch.column(batch.num_columns - 1).to_pylist():
                found = Counter(joined.split(" ")) if joined else {}
                terms.extend(found)
                tfs.extend(found.values())
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(terms, pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))]
            yield pa.record_batch([*batch.columns[:-1], *lists], names=schema.names)

    return words.mapInArrow(run, schema)


def each_count(listed: DataFrame, *columns: str) -> DataFrame:
    """(columns, term, tf) of ``listed_counts``."""
    pairs = F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))
    return listed.select(*columns, F.inline(pairs).alias("term", "tf"))


def placed_vectors(listed: DataFrame, key: str, idf: list[tuple[str, float]], *more: str) -> DataFrame:
    """(key, more, at, w, d): weights of ``listed_counts`` as ``vectors`` has them, by places in ``idf``, which is bounded by its fit.

    d is a digest of at and w, by which equal vectors are told. Rows without a fitted term are left out.
    """
    rows = listed.select(key, *more, "terms", "tfs")
    schema = StructType([*rows.schema.fields[:-2], StructField("at", ArrayType(LongType())), StructField("w", ArrayType(DoubleType())), StructField("d", BinaryType())])
    place, weight = {term: i for i, (term, _) in enumerate(idf)}, np.array([x for _, x in idf], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, tfs = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            at = np.array([place.get(x, -1) for x in terms.flatten().to_pylist()], np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
            fits = np.nonzero(at >= 0)[0]
            fits = fits[np.lexsort((at[fits], owner[fits]))]
            at, owner, tf = at[fits], owner[fits], tfs.flatten().to_numpy()[fits]
            w = (1 + np.log(tf)) * weight[at] if len(at) else np.zeros(0)
            # squares are added one by one in the order of the terms: equal counts have equal weights to the last bit
            w = w / np.sqrt(np.bincount(owner, w * w, batch.num_rows))[owner]
            sizes = np.bincount(owner, minlength=batch.num_rows)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            told = [sha256(at[lo:hi].tobytes() + w[lo:hi].tobytes()).digest() for lo, hi in zip(ends, ends[1:])]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (at, w)]
            out = pa.record_batch([*batch.columns[:-2], *lists, pa.array(told, pa.binary())], names=schema.names)
            yield out.filter(pa.array(sizes > 0))

    return rows.mapInArrow(run, schema)


def fit(counts: DataFrame, key: str, n_docs: Column, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None, stopwords: DataFrame | None = None) -> DataFrame:
    """(term, df, idf). min_df is a count, max_df a share of ``n_docs``; the features with most occurrences stay (ties: term)."""
    if stopwords is not None:
        counts = counts.join(stopwords, "term", "left_anti")
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    terms = terms.withColumn("n", n_docs).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    if max_features is not None:
        terms = terms.orderBy(F.col("total").desc(), "term").limit(max_features)
    return terms.select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def vectors(counts: DataFrame, key: str, idf: DataFrame, *more: str) -> DataFrame:
    """(key, more, v): each row's terms, in order, with their weights; terms that were not fitted are dropped before the norm.

    Squares are added up in the order of the terms, so that equal counts have equal weights to the last bit. ``more`` are
    columns of ``counts`` that a key has once.
    """
    w = counts.join(idf, "term").select(key, *more, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    listed = w.groupBy(key, *more).agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    # the norm is an argument of the inner function, else Spark would work it out for each term anew
    divided = F.transform(F.array(norm), lambda n: F.transform("v", lambda x: F.struct(x["term"].alias("term"), (x["w"] / n).alias("weight"))))
    return listed.select(key, *more, F.get(divided, F.lit(0)).alias("v"))


def transform(counts: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(key, term, weight) of ``vectors``."""
    return vectors(counts, key, idf).select(key, F.inline("v"))


def mean_weights(weights: DataFrame, n_docs: Column) -> DataFrame:
    """(term, mean_tfidf, n_docs): the mean runs over all documents, zeros included."""
    return weights.groupBy("term").agg((F.sum("weight") / F.first(n_docs)).alias("mean_tfidf"), F.count(F.lit(1)).alias("docs_with_term"))


def top_terms(means: DataFrame, k: int = 200) -> DataFrame:
    """The k terms of greatest mean (ties: term) with their position."""
    top = means.orderBy(F.col("mean_tfidf").desc(), "term").limit(k)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.col("mean_tfidf").desc(), "term")))  # k rows


def term_examples(counts: DataFrame, key: str, terms: DataFrame, k: int = 3, sep: str = ", ") -> DataFrame:
    """(term, examples): the first k keys that hold each term."""
    w = Window.partitionBy("term").orderBy(key)
    first = counts.join(terms.select("term"), "term").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return first.groupBy("term").agg(F.array_join(F.array_sort(F.collect_list(key)), sep).alias("examples"))


def forms(pairs: DataFrame, position: list[str], k: int = 5) -> DataFrame:
    """(lemma, frequency, forms): the k most frequent observed forms of each lemma; ties go to the form seen first.

    pairs: lemma, form and the columns of ``position``, which order all occurrences. A counter by lemma and form carries
    the first position of each form.
    """
    counts = pairs.groupBy("lemma", "form").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*position)).alias("first"))
    w = Window.partitionBy("lemma").orderBy(F.col("n").desc(), "first")
    top = counts.withColumn("r", F.row_number().over(w))
    listed = F.array_sort(F.collect_list(F.when(F.col("r") <= k, F.struct("r", "form"))))
    return top.groupBy("lemma").agg(F.sum("n").alias("frequency"), F.array_join(F.transform(listed, lambda x: x["form"]), " | ").alias("forms"))


def bigrams(tokens: Column) -> Column:
    """Tokens and pairs of neighbours, in one array."""
    pairs = F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.slice(tokens, F.lit(2), F.size(tokens) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(tokens, F.coalesce(pairs, F.array().cast("array<string>")))


def shuffled_pairs(terms: DataFrame, term: str, seed: int = 42) -> DataFrame:
    """Pair neighbours of a seeded shuffle: (pair_id P001..., word_1, word_2); an odd last term stays alone and is dropped.

    The order is that of an md5 of term and seed. Meant for a few hundred chosen terms: they are numbered in one window.
    """
    order = Window.orderBy(F.md5(F.concat(F.col(term), F.lit(f"-{seed}")).cast("binary")), term)
    placed = terms.select(term, (F.row_number().over(order) - 1).alias("i")).withColumn("pair", F.floor(F.col("i") / 2))
    at = lambda r: F.max(F.when(F.col("i") % 2 == r, F.col(term)))
    pairs = placed.groupBy("pair").agg(at(0).alias("word_1"), at(1).alias("word_2")).where("word_2 is not null")
    return pairs.select(F.format_string("P%03d", F.col("pair") + 1).alias("pair_id"), "word_1", "word_2")
