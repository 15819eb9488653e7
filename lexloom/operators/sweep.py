"""A cross-validated sweep over vectoriser settings, in one plan.

Words are counted by fold, pairs only of words that are frequent enough. What a fold's training rows hold of a term is the
total less the fold's own. With vocabularies of a size, a row's counts are kept once, and the vectors of each setting and
fold are made of them where rows meet (see ``chunked``); otherwise vectors are rows, and go through one neighbour join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators import chunked, neighbours, tfidf
from lexloom.session import kept

#: Up to so many rows go as vectors, one a row; words that are sieved for pairs at most.
FEW, WORDS = 64, 50_000


@dataclass(frozen=True)
class Setting:
    """A vectoriser: the most frequent ``size`` terms (None: all), with pairs of neighbours or not, terms up to a share of rows."""

    name: str
    size: int | None = None
    bigrams: bool = False
    max_df: float = 1.0


def counted(rows: DataFrame, key: str, fold: str, tokens: Column) -> DataFrame:
    """(key, fold, term, pair, tf): words and pairs of neighbouring words; pair tells those."""
    pairs = F.when(F.size("t") > 1, F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    cut = rows.select(key, fold, tokens.alias("t"))
    each = cut.select(key, fold, F.explode("t").alias("term"), F.lit(False).alias("pair")).unionByName(cut.select(key, fold, F.explode(pairs).alias("term"), F.lit(True).alias("pair")))
    return each.groupBy(key, fold, "term", "pair").agg(F.count(F.lit(1)).alias("tf"))


def _outside(own: DataFrame, sizes: DataFrame, fold: str) -> DataFrame:
    """(term, pair, fold, n, df, tf): what the n rows outside each fold hold of each term. own: term, pair, fold, df, tf, once each."""
    n = sizes.agg(F.sum("n").alias("n_all"))
    folds = sizes.crossJoin(n).select(fold, (F.col("n_all") - F.col("n")).alias("n"))  # a row a fold
    total = own.groupBy("term", "pair").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"), F.map_from_entries(F.collect_list(F.struct(fold, F.struct("df", "tf")))).alias("own"))
    less = lambda c: (F.col(c) - F.coalesce(F.try_element_at("own", F.col(fold))[c], F.lit(0))).alias(c)
    return total.crossJoin(F.broadcast(folds)).select("term", "pair", fold, "n", less("df"), less("tf")).where("df > 0")


def _fitted(outside: DataFrame, fold: str, settings: list[Setting]) -> DataFrame:
    """(setting, fold, term, pair, tf, idf) of the terms of each setting."""
    named = outside.sparkSession.createDataFrame([(s.name, s.size, s.bigrams, s.max_df) for s in settings], "setting string, size int, bigrams boolean, max_df double")
    fits = outside.crossJoin(F.broadcast(named)).where((~F.col("pair") | F.col("bigrams")) & (F.col("df") <= F.col("max_df") * F.col("n")))
    w = Window.partitionBy("setting", fold).orderBy(F.col("tf").desc(), "term")
    most = max((s.size for s in settings if s.size is not None), default=0)
    columns = ["setting", fold, "term", "pair", "tf", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")]
    # only settings with a size are ranked, and a window up to a bound keeps that many rows a task
    ranked = fits.where("size is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).where("r <= size")
    return fits.where("size is null").select(*columns).unionByName(ranked.select(*columns))


def vocabularies(counts: DataFrame, sizes: DataFrame, fold: str, settings: list[Setting]) -> DataFrame:
    """(setting, fold, term, idf) of each setting, fitted on the rows outside each fold. sizes: fold, n rows."""
    own = kept(counts.groupBy("term", "pair", fold).agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")), "own")
    return _fitted(_outside(own, sizes, fold), fold, settings).select("setting", fold, "term", "idf")


def sieved_vocabularies(rows: DataFrame, sizes: DataFrame, fold: str, settings: list[Setting]) -> DataFrame | None:
    """(setting, fold, term, pair, idf) as ``vocabularies`` of rows (fold, t), of settings with a size; None if more than ``WORDS`` words may be in pairs.

    As many words as a setting has terms occur at least so often, and a term that occurs less is none of them. A pair that
    occurs so often is of two words that do: only pairs of such words are counted, so that most pairs are no rows.
    """
    spark = rows.sparkSession
    words = _outside(kept(chunked.word_counts(rows, fold).withColumn("pair", F.lit(False)), "own"), sizes, fold)
    fits = [F.count_if(F.col("df") <= s.max_df * F.col("n")).alias(f"c{i}") for i, s in enumerate(settings)]
    bits = words.groupBy(fold, F.length(F.bin("tf")).alias("bits")).agg(*fits).collect()  # 63 rows a fold at most
    outs = sorted({r[fold] for r in bits})
    reached = lambda i, o, b: sum(r[f"c{i}"] for r in bits if r[fold] == o and r["bits"] >= b) >= settings[i].size
    often = {o: min(max((1 << b - 1 for b in range(1, 64) if reached(i, o, b)), default=0) for i in range(len(settings))) for o in outs}
    least = lambda of: F.broadcast(spark.createDataFrame(sorted(of.items()), f"{fold} {dict(rows.dtypes)[fold]}, least long"))
    some = kept(words.join(least(often), fold).where("tf >= least").drop("least"), "words") if outs else words
    paired = [s for s in settings if s.bigrams]
    if paired and outs:
        last = _fitted(some, fold, paired).groupBy("setting", fold).agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("tf")).collect()  # a row a setting and fold
        size = {s.name: s.size for s in paired}
        full = {(r["setting"], r[fold]): r["tf"] for r in last if r["n"] == size[r["setting"]]}
        bound = {o: min(full.get((s.name, o), 0) for s in paired) for o in outs}
        frequent = some.join(least(bound), fold).where("tf >= least").select("term").distinct().limit(WORDS + 1)
        listed = sorted(r["term"] for r in frequent.collect())
        if len(listed) > WORDS:
            return None
        numbers = spark.createDataFrame(list(enumerate(listed)), "i long, word string")
        word = lambda name: F.broadcast(numbers.select(F.col("i").alias(name), F.col("word").alias(f"{name}_word")))
        pairs = _outside(kept(chunked.pair_counts(rows, fold, listed).select(F.col("code").alias("term"), F.lit(True).alias("pair"), fold, "df", "tf"), "pairs"), sizes, fold)
        pairs = pairs.join(least(bound), fold).where("tf >= least").withColumns({"a": F.expr(f"term div {max(len(listed), 1)}"), "b": F.col("term") % max(len(listed), 1)})
        pairs = pairs.join(word("a"), "a").join(word("b"), "b").withColumn("term", F.concat_ws(" ", "a_word", "b_word"))
        some = some.unionByName(pairs.select(*some.columns))
    return _fitted(some, fold, settings).select("setting", fold, "term", "pair", "idf")


def neighbour_votes(rows: DataFrame, key: str, fold: str, label: str, tokens: Column, settings: list[Setting], k: int = 3) -> DataFrame:
    """(setting, fold, key, truth, predicted): every row's vote among its nearest rows of the other folds, for each setting.

    Keys are whole numbers of at least 0; names of settings hold no bar. A row that shares no term with a row of the other
    folds has no vote.
    """
    rows = kept(rows.select(key, fold, F.col(label).alias("truth"), tokens.alias("t")), "rows")
    sizes = kept(rows.groupBy(fold).agg(F.count(F.lit(1)).alias("n")), "sizes")
    labels = rows.select(key, fold, "truth")
    n = sum(r["n"] for r in sizes.collect())
    # vectors of a bounded length are made where they meet; a few rows are not worth the packing
    sized = all(s.size is not None for s in settings) and n > FEW
    vocabulary = sieved_vocabularies(rows, sizes, fold, settings) if sized else None
    near = _near_by_vectors(rows, key, fold, sizes, settings, k) if vocabulary is None else _near_by_counts(rows, key, fold, vocabulary, settings, k)
    near = near.select(F.struct("setting", "id").alias("of"), F.col("neighbour").alias("n"))
    voted = neighbours.vote(near.join(labels.select(F.col(key).cast("long").alias("n"), F.col("truth").alias("label")), "n"), "of")
    return voted.select(F.col("of.setting").alias("setting"), F.col("of.id").alias(key), "predicted").join(labels, key)


def _near_by_counts(rows: DataFrame, key: str, fold: str, vocabulary: DataFrame, settings: list[Setting], k: int) -> DataFrame:
    """(setting, id, neighbour) by chunks of counts. vocabulary: setting, fold, term, pair, idf, of so many terms a setting and fold."""
    fitted = vocabulary.collect()
    terms = sorted({(r["term"], r["pair"]) for r in fitted})
    folds, place, number = sorted({r[fold] for r in fitted}), {x: i for i, x in enumerate(terms)}, {s.name: i for i, s in enumerate(settings)}
    idf = np.zeros((len(settings), len(folds), len(terms)))
    for r in fitted:
        idf[number[r["setting"]], folds.index(r[fold]), place[r["term"], r["pair"]]] = r["idf"]
    names = F.broadcast(rows.sparkSession.createDataFrame([(i, s) for s, i in number.items()], "s int, setting string"))
    return chunked.nearest_of_other_folds(rows, key, fold, terms, idf, folds, k).join(names, "s").select("setting", "id", "neighbour")


def _near_by_vectors(rows: DataFrame, key: str, fold: str, sizes: DataFrame, settings: list[Setting], k: int) -> DataFrame:
    """(setting, id, neighbour) by one row a vector: a vocabulary without a size has no bound."""
    counts = counted(rows, key, fold, F.col("t"))
    counts = kept(counts.groupBy(key, fold).agg(F.collect_list(F.struct("term", "pair", "tf")).alias("c")), "counts")
    each = counts.select(key, fold, F.inline("c"))
    vocabulary = kept(vocabularies(each, sizes, fold, settings), "vocabulary")
    outs = sorted(r[fold] for r in sizes.select(fold).collect())
    numbers = rows.sparkSession.createDataFrame([(s.name, o, i * len(outs) + j) for i, s in enumerate(settings) for j, o in enumerate(outs)], f"setting string, out {dict(rows.dtypes)[fold]}, s int")
    fitted = vocabulary.select("setting", F.col(fold).alias("out"), "term", "idf").join(F.broadcast(numbers), ["setting", "out"]).select("s", "setting", "out", "term", "idf")
    if all(s.size is not None for s in settings):
        fitted = F.broadcast(fitted)  # of so many terms a setting and fold
    vectors = tfidf.vectors(counts.repartition(key).select(key, fold, F.inline("c")), key, fitted, "s", "setting", "out", fold)
    named = F.concat_ws("|", "setting", F.col("out").cast("string"), F.lpad(F.col(key).cast("string"), 20, "0"))
    vectors = vectors.select((F.col(fold) == F.col("out")).alias("asks"), named.alias("id"), "s", "v")
    if any(s.size is None for s in settings):
        vectors = kept(vectors, "weights")
    part = lambda asks: vectors.where(F.col("asks") == asks).drop("asks")
    near = neighbours.best_met(part(False), part(True), "id", "v", k, "s", len(settings) * len(outs))
    part_of = lambda c, i: F.get(F.split(c, "\\|"), F.lit(i))
    return near.select(part_of("q", 0).alias("setting"), part_of("q", 2).cast("long").alias("id"), part_of("neighbour", 2).cast("long").alias("neighbour"))


def macro_f1(votes: DataFrame, *by: str) -> DataFrame:
    """(by, macro_f1): the mean F1 of the labels that occur, as truth or as prediction; 0 where nothing was hit."""
    each = votes.select(*by, "truth", "predicted", F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("label"))
    hit, claimed, due = (F.count_if(c) for c in ((F.col("truth") == F.col("label")) & (F.col("predicted") == F.col("label")), F.col("predicted") == F.col("label"), F.col("truth") == F.col("label")))
    return each.groupBy(*by, "label").agg((2 * hit / (claimed + due)).alias("f1")).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
