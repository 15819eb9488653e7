"""Connected components of an edge table, without collecting anything: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._tables import stored


def _star(edges: DataFrame, large: bool, label: str) -> DataFrame:
    """Hang the neighbours of every node (large: the greater ones, small: the lesser ones and itself) on its least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # stored: a node with very many neighbours is then a skewed join between two scans, which Spark splits
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{label}-least")
    hung = both.join(least, "u")
    out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and no centre hangs on any."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    by_node = ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return by_node.where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (u, v) reaches. Nulls and loops are ignored."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}-edges")
    while not _stars(edges):
        edges = stored(_star(_star(edges, True, label), False, label), f"{label}-round")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
