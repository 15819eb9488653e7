"""Shared plumbing: intermediate tables in the cluster's shared folder, and integer-safe hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace, the separators of `[^\x20\x09-\x0D]+` words.
SPACES = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. A session without one gets a temporary folder if it runs on this machine
    alone; on a cluster, where executors would each write to their own disk and rows would be missing, this raises."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        name = got.get() if got.isDefined() else None
    if not name and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not name:
        name = tempfile.mkdtemp(prefix="lexloom-")
        spark.sparkContext.setCheckpointDir(name)
    return name.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character untouched (``lower`` alone also folds non-ASCII letters)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """The fold of the contracts: crc32 of the id's decimal text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder
