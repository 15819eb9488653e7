"""Operator 3, mixing sources to target weights: hierarchical budgeting, in DataFrame functions only.

A token budget goes down the tree domain - language - source. At each node the children share their parent's budget
by weight; a child that has fewer tokens than its share gives the rest to its siblings, by weight, and only what no
sibling can take goes back to the ancestors (whose shares were bounded by what their subtrees hold). A leaf fills its
budget from seeded epochs: every epoch is another order of its documents, whole epochs are taken while they fit, and
of the next one the longest prefix that fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm._tables import WORD, stored

#: Stand-in for a catalogue of domains: by the last digits of the source's name.
DOMAINS = ["web", "books", "code", "talk"]
#: Production weights by level and name; 1 where a name is not listed.
WEIGHTS = [{"web": 4, "books": 3, "code": 2}, {"en": 4, "fr": 2, "de": 2}, {}]
LEVELS = ["domain", "lang", "source"]
SHARE = (3, 4)  # of all tokens, as the budget
EPOCHS = 2
SEED = 42


def domain_of(source: Column) -> Column:
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(digits == "", F.lit("other")).otherwise(F.element_at(F.array(*map(F.lit, DOMAINS)), (digits.cast("int") % len(DOMAINS) + 1).cast("int")))


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for k, v in weights.items():
        out = F.when(name == k, F.lit(v).cast("long")).otherwise(out)
    return out


def shared_out(nodes: DataFrame, parent: list[str], key: str, weights: dict[str, int]) -> DataFrame:
    """Add ``budget`` to nodes (parent..., key, capacity, given): the parent's ``given`` tokens by weight, bounded by capacity."""
    family = Window.partitionBy(*parent)
    before = family.orderBy("fill", key).rowsBetween(Window.unboundedPreceding, -1)
    w = nodes.withColumn("w", weight_of(F.col(key), weights)).withColumn("fill", F.col("capacity") / F.col("w"))
    left = w.withColumns(
        {"tokens": F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), "weight": F.sum("w").over(family) - F.coalesce(F.sum("w").over(before), F.lit(0))}
    )
    # in order of capacity / weight, a node is filled if it holds no more than its share of what the earlier ones left
    full = left.withColumn("full", F.col("capacity") * F.col("weight") <= F.col("tokens") * F.col("w"))
    rest = full.withColumns(
        {"tokens": F.col("given") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(family), "weight": F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(family)}
    )
    return rest.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("tokens * w div greatest(weight, 1)"))).select(*parent, key, "capacity", "budget")


def leaf_budgets(leaves: DataFrame, weights: list[dict[str, int]], share: tuple[int, int], epochs: int) -> DataFrame:
    """(domain, lang, source, supply, budget) from (domain, lang, source, supply); a row per leaf."""
    sized = leaves.withColumn("capacity", F.col("supply") * epochs)
    budgets = None
    for i, level in enumerate(LEVELS):
        path = LEVELS[:i]
        nodes = sized.groupBy(*path, level).agg(F.sum("capacity").alias("capacity"))
        if budgets is None:
            total = leaves.agg(F.floor(F.sum("supply") * share[0] / share[1]).cast("long")).scalar()
            nodes = nodes.withColumn("given", F.least(total, F.sum("capacity").over(Window.partitionBy())))
        else:
            nodes = nodes.join(budgets.select(*path, F.col("budget").alias("given")), path)
        budgets = stored(shared_out(nodes, path, level, weights[i]), f"budget-{level}")
    return leaves.join(budgets.drop("capacity"), LEVELS)


def leafed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and ``columns`` of docs, with n_tokens and the leaf (domain, lang, source)."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    slim = docs.select("doc_id", *columns, F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), n.alias("n_tokens"))
    return slim.withColumn("domain", domain_of(F.col("source")))


def ordered(rows: DataFrame, ties: Sequence[str], seed: int) -> DataFrame:
    """Add ``key``, the place of a row in the order of its leaf's epoch ``whole``."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return rows.withColumn("key", F.struct(h.alias("h"), "doc_id", *ties))


def leaf_cuts(slim: DataFrame, budgets: DataFrame, ties: Sequence[str], seed: int, digits: int) -> DataFrame:
    """(leaf, whole, cut): epochs read whole, and the first key that the epoch read in part leaves out (null: it leaves all).

    A leaf's order is summed by buckets of its keys, and only the rows of the bucket in which the budget ends are sorted.
    """
    drawn = ordered(slim.join(budgets, LEVELS), ties, seed).withColumn("bucket", F.substring("key.h", 1, digits))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 16**digits rows a leaf at most
    held = drawn.groupBy(*LEVELS, "part", "bucket").agg(F.sum("n_tokens").alias("held"))
    prior = held.withColumn("prior", F.coalesce(F.sum("held").over(before), F.lit(0)))
    ends = stored(prior.where("part > 0 and prior <= part and prior + held > part").select(*LEVELS, "bucket", "prior"), "ends")
    upto = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    past = drawn.join(ends, [*LEVELS, "bucket"]).withColumn("upto", F.col("prior") + F.sum("n_tokens").over(upto)).where("upto > part")
    return stored(budgets.join(past.groupBy(*LEVELS).agg(F.min("key").alias("cut")), LEVELS, "left").select(*LEVELS, "whole", "cut"), "cuts")


def mix_sources(
    docs: DataFrame, weights: list[dict[str, int]] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: int = SEED, digits: int = 3,
    ties: Sequence[str] = (), carry: Sequence[str] = (),
) -> DataFrame:
    """How often each document is read, so that leaves meet their token budgets.

    docs: doc_id, text, lang, source and any other columns, which are ignored. Returns doc_id, domain, lang, source,
    n_tokens (ASCII-whitespace words) and epochs (0: not selected), one row per input row. ``weights``: integers by
    level and name; ``share``: the budget as a fraction of all tokens; ``epochs``: how often a leaf may be read;
    ``digits``: hex digits of the buckets in which a leaf's order is summed, so that no task reads a whole leaf;
    ``ties``: further columns to return, which order the rows that repeat a doc_id; ``carry``: further columns to return.
    Rows are told by one row a leaf (``leaf_cuts``), so that what is carried, such as texts, is not shuffled while the
    leaves are small enough to broadcast.

    A null language or source counts as the empty name. Null and empty texts have no tokens; they are selected with
    the epochs and prefixes that they fall in. A prefix ends before the first document that does not fit. Division
    leaves less than one token a child unspent. Rows that repeat a doc_id are each counted; ties in the order go by
    doc_id, then ``ties``; rows equal in all of them are taken or left together. An empty table gives an empty result.
    """
    slim = stored(leafed(docs, *ties), "tokens")
    leaves = stored(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")), "leaves")
    budgets = stored(
        leaf_budgets(leaves, weights, share, epochs).select(
            *LEVELS, F.expr("case when supply > 0 then budget div supply else 0 end").alias("whole"), F.expr("case when supply > 0 then budget % supply else 0 end").alias("part")
        ),
        "budgets",
    )
    cuts = leaf_cuts(slim, budgets, ties, seed, digits)
    rows = ordered((leafed(docs, *ties, *carry) if carry else slim).join(cuts, LEVELS), ties, seed)
    taken = F.coalesce(F.col("key") < F.col("cut"), F.lit(False))
    return rows.select("doc_id", *ties, *carry, *LEVELS, "n_tokens", (F.col("whole") + taken.cast("int")).cast("long").alias("epochs"))
