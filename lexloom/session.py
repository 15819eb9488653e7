"""Session defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def session(app: str = "lexloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` (dots as __) overrides."""
    build = SparkSession.builder.appName(app)
    if master:
        build = build.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return build.config(map=defaults | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Without one, a temporary folder on a single machine; raises on a cluster."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        name = got.get() if got.isDefined() else None
    if not name:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = tempfile.mkdtemp(prefix="lexloom-")
        spark.sparkContext.setCheckpointDir(name)
    return name.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    shared_dir(spark)


def kept(df: DataFrame, label: str = "kept", schema: StructType | None = None) -> DataFrame:
    """``df`` as Parquet in the shared folder: what is read several times is computed once, by columns, and survives lost executors.

    ``schema`` reads it as types that are stored as those of ``df``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(schema or df.schema).parquet(path)
