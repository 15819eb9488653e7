"""Writers; each replaces what is at its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv_file(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def texts(df: DataFrame, path: str, text: Column, *by: str) -> None:
    """Text files in folders by the given columns."""
    df.select(*by, text.alias("value")).write.mode("overwrite").option("lineSep", "\n\n").partitionBy(*by).text(path)


def partitions(df: DataFrame, path: str, *by: str) -> None:
    """A Parquet table in folders by the given columns, in place of whatever is there."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, due: DataFrame, path: str, *by: str) -> None:
    """Write the rows of ``df`` in place of the partitions ``due`` (columns ``by``), and leave all others as they are.

    Spark overwrites the partitions that have rows; those of ``due`` that have none any more are deleted. ``due`` is read on
    the driver: a row a partition.
    """
    spark = df.sparkSession
    left = [F.col(f"n.{c}").eqNullSafe(F.col(f"d.{c}")) for c in by]
    on = left[0]
    for c in left[1:]:
        on = on & c
    gone = due.alias("d").join(df.select(*by).distinct().alias("n"), on, "left_anti").select(*[F.col(c).cast("string") for c in by]).distinct().collect()
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for row in gone:
        target = jvm.org.apache.hadoop.fs.Path("/".join([path, *[name(c, row[c]) for c in by]]))
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_partitions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that ``partitions`` wrote, with its declared types."""
    return spark.read.schema(schema).parquet(path)


def options_wide(df: DataFrame, options: str = "options", letters: str = "ABCDE") -> DataFrame:
    """A column for each letter of a map; empty where it is missing."""
    return df.select(*[c for c in df.columns if c != options], *[F.coalesce(F.try_element_at(options, F.lit(x)), F.lit("")).alias(x) for x in letters])


def corpus_document(df: DataFrame, meta: DataFrame, field: str = "questoes", order: tuple[str, ...] = ()) -> DataFrame:
    """One row (value): a JSON document of metadata and all records. For small corpora: the records meet in one task."""
    rows = df.select(F.struct(*order).alias("_o"), F.struct(*df.columns).alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "r"))), lambda x: x["r"]).alias(field))
    return rows.select(F.to_json(F.struct(meta.select(F.struct(*meta.columns)).scalar().alias("metadados"), F.col(field))).alias("value"))


def nested(df: DataFrame, outer: str, inner: str, order: str) -> DataFrame:
    """(outer, total, groups): records by outer and inner column with totals; one row per outer value."""
    cols = [c for c in df.columns if c not in (outer, inner)]
    by = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(order, *[c for c in cols if c != order]))).alias("records"))
    return by.groupBy(outer).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct(inner, "n", "records"))).alias("groups"))


def nested_totals(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, total, groups): the same without the records, counted before anything meets in a row."""
    by = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(outer).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct(inner, "n"))).alias("groups"))


def record_text(letters: str = "options") -> Column:
    """The labelled text form of one record: id, year, banca, post, area, statement, options (array of letra, texto), answer."""
    listed = F.array_join(F.transform(letters, lambda o: F.concat(F.lit("("), o["letra"], F.lit(") "), o["texto"])), "\n")
    return F.concat(
        *[F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n")) for name, c in (("ID", "id"), ("ANO", "year"), ("BANCA", "banca"), ("CARGO/ÓRGÃO", "post"), ("SUBÁREA", "area"))],
        F.lit("\n[ENUNCIADO]\n"), F.col("statement"), F.lit("\n\n[ALTERNATIVAS]\n"), listed, F.lit("\n\n[GABARITO]\n"), F.col("answer"),
    )
