"""Splits, folds, logistic regression; nearest neighbours are those of ``neighbours``."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexloom.operators.neighbours import nearest, sparse_nearest, vectors_nearest, vote
from lexloom.session import kept

__all__ = ["nearest", "sparse_nearest", "vectors_nearest", "vote"]


def seeded_order(key: Column, seed: int = 42) -> Column:
    """A pseudo-random order that any engine can repeat."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")).cast("binary"))


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: the first ``share`` of each label's rows in seeded order."""
    return _placed(df, key, label, seed).withColumn("is_test", F.col("_place") <= F.floor(F.col("_n") * share)).drop("_place", "_n")


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``, 0 to k - 1, evenly within each label."""
    return _placed(df, key, label, seed).withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place", "_n")


def _placed(df: DataFrame, key: str, label: str, seed: int, digits: int = 3) -> DataFrame:
    """Add ``_place``, each row's number among those of its label in seeded order, and ``_n``, how many those are.

    Rows are numbered within buckets of the order, so that no task sorts all rows of a label.
    """
    order = seeded_order(F.col(key), seed)
    bucket = F.substring(order, 1, digits)
    held = df.groupBy(F.col(label).alias("_l"), bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    of_label = Window.partitionBy("_l")  # 16**digits rows a label at most
    before = of_label.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_l", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(of_label).alias("_n"))
    dealt = df.withColumn("_bucket", bucket).join(held, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    within = Window.partitionBy("_l", "_b").orderBy(order, key)
    return dealt.withColumn("_place", F.col("_before") + F.row_number().over(within)).drop("_l", "_b", "_bucket", "_before")


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Add ``class_weight``: rows / (classes x rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = Window.partitionBy()
    weights = counts.select(label, (F.sum("_n").over(total) / (F.count(F.lit(1)).over(total) * F.col("_n"))).alias("class_weight"))
    return df.join(F.broadcast(weights), label)


def logistic(train: DataFrame, features: str, label: str, c: float, max_iter: int, scale: bool = False):
    """A multinomial L2 model with balanced classes; ``c`` is the inverse strength per row. features: vector column."""
    n = train.count()
    stages = [StandardScaler(inputCol=features, outputCol="_scaled", withMean=True, withStd=True)] if scale else []
    stages.append(
        LogisticRegression(
            featuresCol="_scaled" if scale else features, labelCol=label, weightCol="class_weight", family="multinomial", regParam=1 / (c * max(n, 1)), elasticNetParam=0.0,
            standardization=False, maxIter=max_iter,
        )
    )
    return Pipeline(stages=stages).fit(balanced(train, label))


def as_vector(column: str) -> Column:
    return array_to_vector(F.col(column).cast("array<double>"))


def sparse_vectors(rows: DataFrame, key: str, at: str, w: str, size: int) -> DataFrame:
    """(key, features), stored, of lists of places, in order, and weights.

    The vectors are put together as the columns that Spark stores a vector as, and read back as vectors.
    """
    parts = [F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col(at).cast("array<int>").alias("indices"), F.col(w).alias("values")]
    listed = rows.select(key, F.struct(*parts).alias("features"))
    return kept(listed, "vectors", StructType([listed.schema[key], StructField("features", VectorUDT())]))


def top_coefficients(model: LogisticRegression, terms: list[str], k: int = 10) -> list[tuple[int, str, float]]:
    """(class, term, coefficient): the k greatest of each class."""
    matrix = model.coefficientMatrix.toArray()
    return [(c, terms[j], float(row[j])) for c, row in enumerate(matrix) for j in np.argsort(-row, kind="stable")[:k]]


def cross_validated(df: DataFrame, key: str, label: str, evaluate, k: int = 5) -> list[float]:
    """Scores of ``evaluate(train, test)`` over stratified folds."""
    dealt = folds(df, key, label, k).persist()
    scores = [evaluate(dealt.where(F.col("fold") != i), dealt.where(F.col("fold") == i)) for i in range(k)]
    dealt.unpersist()
    return scores
