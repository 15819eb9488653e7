"""Whole workflows: exam texts to a labelled corpus; corpus to word pairs; classifiers compared; similarity judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import dedup, lexicon, ml, quality, stats, tfidf
from lexloom.session import kept as stored


def build_corpus(raw: DataFrame, lex: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded) of raw records: flags, domain, dedup, in that order.

    raw: id, position, section, statement, options (map), answer, problems. Every discarded row has its reasons in
    ``reasons``; kept rows list the ids of their duplicates in ``also_in``.
    """
    joined = F.array_join(F.map_values("options"), " ")
    scored = lexicon.decide(lexicon.scores(raw, "id", F.concat_ws(" ", "statement", joined), lex), "id").select("id", "area", "score", "strong")
    full = raw.join(scored, "id", "left").withColumns({"score": F.coalesce("score", F.lit(0)), "strong": F.coalesce("strong", F.lit(0))})
    outside = lexicon.domain_reason(F.col("section"), F.col("score"), F.col("strong"))
    reasons = F.concat(F.array_intersect("problems", F.array(*map(F.lit, quality.FLAGS))), F.filter(F.array(outside), lambda x: x.isNotNull()))
    full = stored(full.withColumn("reasons", reasons), "full")
    clean = full.where(F.size("reasons") == 0)
    keyed = dedup.block_keys(clean.select("id", "position", "statement", "options"), F.col("statement"), F.array_join(F.map_values("options"), "|"))
    led = dedup.greedy_leaders(keyed, "position")
    marked = full.join(led, "position", "left").withColumn("reasons", F.when(F.col("leader").isNull(), F.col("reasons")).otherwise(F.array(F.lit("duplicada"))))
    also = marked.where("leader is not null").groupBy(F.col("leader").alias("position")).agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("_d"))
    kept = marked.where(F.size("reasons") == 0).drop("leader", "reasons", "area").join(also, "position", "left")
    kept = kept.withColumn("also_in", F.coalesce(F.transform("_d", lambda x: x["id"]), F.array().cast("array<string>"))).drop("_d")
    return kept.withColumn("answer_text", F.try_element_at("options", F.col("answer"))), marked.where(F.size("reasons") > 0).drop("leader", "area")


def assign_areas(kept: DataFrame, lex: DataFrame, k: int = 3) -> DataFrame:
    """(id, area, origin): by lexicon where the lead is clear, else by the k nearest clear rows in TF-IDF."""
    options = F.array_join(F.map_values("options"), " ")
    both = lexicon.combined(lexicon.scores(kept, "id", F.col("statement"), lex), lexicon.scores(kept, "id", options, lex), "id")
    decided = lexicon.decide(both, "id")
    first = lex.orderBy("area_ord").select("area").limit(1).scalar()
    full = kept.join(decided, "id", "left").select("id", F.coalesce("area", first).alias("area"), F.coalesce("confident", F.lit(False)).alias("confident"), F.concat_ws(" ", "statement", "statement", options).alias("text"))
    full = stored(full, "decided")
    counts = stored(tfidf.term_counts(full, "id", F.filter(T.words(F.lower("text")), lambda w: F.length(w) >= 2)), "counts")
    clear = full.where("confident").select("id")
    train = counts.join(clear, "id", "left_semi")
    idf = tfidf.fit(train, "id", clear.agg(F.count(F.lit(1))).scalar(), min_df=2)
    weights = stored(tfidf.transform(counts, "id", idf), "weights")
    near = ml.sparse_nearest(weights.join(clear, "id", "left_semi"), weights.join(clear, "id", "left_anti"), "id", k, clear, full.where("not confident").select("id"))
    voted = ml.vote(near.join(full.select(F.col("id").alias("neighbour"), F.col("area").alias("label")), "neighbour"), "id")
    return full.join(voted, "id", "left").select(
        "id", F.when(F.col("confident"), F.col("area")).otherwise(F.coalesce("predicted", "area")).alias("area"), F.when(F.col("confident"), "palavras_chave").otherwise("knn").alias("origin")
    )


def representative_words(lemmas: DataFrame, docs: DataFrame, key: str, position: list[str], min_df: int = 5, max_df: float = 0.8, k: int = 200) -> DataFrame:
    """The k words of greatest mean TF-IDF (ties: word) with frequency, documents, forms and examples.

    lemmas: key, lemma, form and the columns of ``position``; docs: key of all documents, those without a lemma too.
    """
    counts = stored(lemmas.groupBy(key, F.col("lemma").alias("term")).agg(F.count(F.lit(1)).alias("tf")), "counts")
    n = docs.agg(F.count(F.lit(1))).scalar()
    weights = tfidf.transform(counts, key, tfidf.fit(counts, key, n, min_df, max_df))
    top = stored(tfidf.top_terms(tfidf.mean_weights(weights, n).withColumn("mean_tfidf", F.round("mean_tfidf", 9)), k), "top")
    chosen = lemmas.join(F.broadcast(top.select(F.col("term").alias("lemma"))), "lemma")  # k words
    forms = tfidf.forms(chosen, position).withColumnRenamed("lemma", "term")
    return top.join(forms, "term").join(tfidf.term_examples(counts, key, top, sep=" | "), "term").select(
        "position", F.col("term").alias("word"), "mean_tfidf", "frequency", "docs_with_term", "forms", "examples"
    )


def compare_models(vectors: DataFrame, key: str, vector: str, label: str, k: int = 3) -> DataFrame:
    """Macro F1 and accuracy of k-NN and of balanced, scaled logistic regression on a stratified 80/20 split. label: int."""
    split = ml.stratified_split(vectors, key, label)
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    knn = test.join(ml.vote(ml.nearest(train, test, key, vector, label, k), key), key)
    model = ml.logistic(train.withColumn("_v", ml.as_vector(vector)), "_v", label, c=0.1, max_iter=3_000, scale=True)
    logreg = model.transform(test.withColumn("_v", ml.as_vector(vector))).withColumn("predicted", F.col("prediction").cast("int"))
    name = lambda df, n: stats.macro_report(df.select(F.col(label).alias("truth"), F.col("predicted").cast("int").alias("predicted")), "truth", "predicted").withColumn("model", F.lit(n))
    return name(knn, "knn").unionByName(name(logreg, "logreg"))


def correlations(scores: DataFrame, human: str, models: list[str]) -> DataFrame:
    """Spearman's correlation of each model's scores with the human ones."""
    out = None
    for m in models:
        one = stats.spearman(scores, human, m).withColumn("model", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def rescaled(score: str, low: int = 1, high: int = 5):
    return (F.col(score) - low) / (high - low)
