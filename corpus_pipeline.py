"""The training-data pipeline: five stages over ``documents``, each an operator of ``lexloom.llm`` whose decision takes effect.

Every row is judged by its own text: operators that tell documents apart by doc_id are given the row's number instead, so
that rows that repeat a doc_id, or have none, are judged like all others. All stages share these cases: columns besides
doc_id, text, lang and source, whatever their names, are carried through untouched (but see ``mixing``); null ids and
repeated rows are rows of their own, ordered by (doc_id, nulls last, a hash of the text, place); texts of any length are
read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm._tables import stored
from lexloom.llm.decontamination import decontaminate
from lexloom.llm.exact_dedup import exact_dedup
from lexloom.llm.mixing import mix_sources
from lexloom.llm.near_dedup import near_dedup
from lexloom.llm.toxicity import reject_toxic


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source, number, row): the rows of ``docs`` with numbers that ascend with doc_id, none last.

    ``row`` holds all columns, so that no name of theirs meets one that is used here. Where every row has a doc_id of its
    own, that is its number, and the texts are neither sorted nor stored.
    """
    rows = docs.select("doc_id", "text", "lang", "source", F.struct(*[F.col(_quoted(c)).alias(c) for c in docs.columns]).alias("row"))
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return rows.withColumn("number", F.col("doc_id").cast("long"))
    # rows of one doc_id, and those without, go by text and place, so that they are dealt to many tasks
    order = rows.withColumn("place", F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "place")
    told = stored(order.select("row", F.monotonically_increasing_id().alias("number")), "rows")
    return told.select(*[F.col("row").getField(c).alias(c) for c in ("doc_id", "text", "lang", "source")], "number", "row")


def _unpacked(rows: DataFrame, names: list[str], *more: str) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names], *more)


def _without(docs: DataFrame, dropped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` less the rows whose numbers ``dropped`` returns as doc_id of (doc_id: number, text).

    The numbers are stored first, so that Spark knows their size before it plans the join: up to its broadcast threshold
    the texts are not shuffled, beyond it they are, by row number.
    """
    rows = _numbered(docs)
    gone = stored(dropped(rows.select(F.col("number").alias("doc_id"), "text")).select(F.col("doc_id").alias("number")), "dropped")
    return _unpacked(rows.select("number", "row").join(gone, "number", "left_anti"), docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of 0.5 or more) go. Null and empty texts have no hits and stay; without
    labels of both classes there is nothing to go by, and all stay."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest original, then the first. Null and empty texts are one group."""
    return _without(docs, lambda rows: exact_dedup(rows).where(~F.col("kept")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near-duplicates stays. Null, empty and blank texts are linked with nothing and stay."""
    return _without(docs, lambda rows: near_dedup(rows).where(~F.col("kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go. Null and empty texts have no words and stay; an empty benchmark takes none."""
    return _without(docs, lambda rows: decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture reads, with their domain, n_tokens and how often they are read (epochs).

    Columns of these three names are replaced. Null language or source counts as the empty name; null and empty texts have
    no tokens and fall in whole epochs or in the prefix like others."""
    rows = _numbered(docs)
    names = [c for c in docs.columns if c not in ("domain", "n_tokens", "epochs")]
    return _unpacked(mix_sources(rows, ties=["number"], carry=["row"]).where("epochs > 0"), names, "domain", "n_tokens", "epochs")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
