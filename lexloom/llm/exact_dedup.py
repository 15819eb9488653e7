"""Operator 4, exact dedup: content-defined chunk recipes, in DataFrame functions only.

A text, stripped of ASCII whitespace, is cut into chunks where its own characters say so. Chunks are deduplicated to
identifiers: a 64-bit hash, verified by SHA-256 over all chunks that share it, and extended by the SHA-256 where they
differ. A document is then its recipe, the ordered list of its chunks' identifiers; texts are equal when recipes are.
Text is read once, where it lies; what is shuffled is about 40 bytes a chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._tables import SPACES, stored

#: A chunk ends after one of these pairs, once 512 characters are in, and at 4,096 at the latest. changing
#: them changes the recipes, not the result.
CUT_AFTER = "[bfgkpvwyzà-öø-ÿ0-9\\u0400-\\uFFFF][aiuhrd]"
CHUNK = f"(?s).{{510,4094}}?{CUT_AFTER}|.{{1,4096}}"


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_points, text_sha256, recipe): the documents with their ordered chunk identifiers, without texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.regexp_replace(text, SPACES + "+", "")
    cut = docs.select("doc_id", F.char_length(text).cast("long").alias("n_points"), norm.alias("norm")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_points",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks"),
    )
    read = stored(
        cut.select(
            "row", "doc_id", "n_points", "text_sha256",
            F.transform("chunks", lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("sha"))).alias("chunks"),
        ),
        "chunks",
    )
    each = read.select("row", F.posexplode("chunks").alias("i", "c")).select("row", "i", "c.h", "c.sha")
    # stored, so that a chunk of a third of all documents is a skewed join between two scans, which Spark splits
    known = stored(each.groupBy("h").agg((F.min("sha") == F.max("sha")).alias("verified")), "identifiers")
    named = each.join(known, "h").select(
        "row", F.struct("i", F.concat(F.unhex(F.lpad(F.hex("h"), 16, "0")), F.when(F.col("verified"), F.lit(b"")).otherwise(F.col("sha"))).alias("id")).alias("part")
    )
    lists = named.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["id"]).alias("recipe"))
    return read.drop("chunks").join(lists, "row", "left").select(
        "doc_id", "n_points", "text_sha256", F.coalesce("recipe", F.array().cast("array<binary>")).alias("recipe")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Group texts that are identical once ASCII whitespace is deleted; the longest original, then smallest id stays.

    docs: doc_id, text and any other columns, which are ignored. Returns doc_id, keep_id, group_size, kept,
    text_sha256, one row per input row, dropped ones too.

    Null counts as empty, and all empty texts are one group. Length is in code points of the original text. Rows that
    repeat a doc_id are all counted, and all are kept if that id stays. A null doc_id loses to any other id of its
    group. An empty table gives an empty result. Long texts are long recipes; none is cut off.
    """
    listed = stored(recipes(docs), "recipes")
    rank = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    groups = stored(listed.groupBy("recipe").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    return listed.join(groups, "recipe").select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("best.id")).alias("kept"),
        "text_sha256",
    )
