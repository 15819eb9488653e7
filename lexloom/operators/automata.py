"""Finite automata over ordered rows, as an associative fold.

Reading a stretch of symbols takes each state to a state; such maps compose. Rows are cut into segments of bounded length,
each segment is folded to its map, segments of segments again, until one is left for a key. From there the states go down
to the segments and rows. So a key of any number of rows is read by many tasks, and what a task holds is one segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import kept

#: Rows, or maps, of one segment.
SEGMENT = 256


def _table(table: list[list[int]]) -> Column:
    return F.array(*[F.array(*map(F.lit, row)) for row in table])


def _sorted(by: str, *columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(by, *columns))).alias("items")


def run(df: DataFrame, key: str, order: str, symbol: Column, table: list[list[int]], start: int = 0) -> DataFrame:
    """(key, order, symbol, before, after): the automaton's state before and after each row of its key.

    ``table[state][symbol]`` is the next state. order: whole numbers from 0 without gaps within a key, as ``posexplode``
    gives. Null symbols leave the state as it is. Keys are told apart as values, and a null key is one.
    """
    states = len(table)
    step = _table(table)
    move = lambda s, x: F.when(x.isNull(), s).otherwise(F.get(F.get(step, s), x))
    rows = df.select(key, F.col(order).cast("long").alias("n"), symbol.cast("int").alias("x"))
    level = rows.groupBy(key, F.floor(F.col("n") / SEGMENT).alias("seg")).agg(_sorted("n", "x"))
    folded = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.aggregate("items", s, lambda a, r: move(a, r["x"])))
    levels = [kept(level.withColumn("f", folded), "segments")]
    while levels[-1].agg(F.coalesce(F.max("seg"), F.lit(0))).first()[0] > 0:
        up = levels[-1].select(key, F.col("seg").alias("n"), "f").groupBy(key, F.floor(F.col("n") / SEGMENT).alias("seg")).agg(_sorted("n", "f"))
        identity = F.sequence(F.lit(0), F.lit(states - 1))
        composed = F.aggregate("items", identity, lambda a, r: F.transform(a, lambda s: F.get(r["f"], s)))
        levels.append(kept(up.withColumn("f", composed), "segments"))
    entered = levels[-1].withColumn("s", F.lit(start))
    for i in range(len(levels) - 1, -1, -1):
        # the state before each item of a segment, and after the last
        after = (lambda a, r: F.get(r["f"], a)) if i else (lambda a, r: move(a, r["x"]))
        trail = F.aggregate("items", F.array("s"), lambda t, r: F.concat(t, F.array(after(F.element_at(t, -1), r))))
        each = entered.withColumn("trail", trail).select(key, F.posexplode("items").alias("i", "r"), "trail")
        before = F.get("trail", F.col("i"))
        if i:
            entered = levels[i - 1].join(
                each.select(F.col(key).alias("_k"), F.col("r.n").alias("_seg"), before.alias("s")), F.col(key).eqNullSafe(F.col("_k")) & (F.col("seg") == F.col("_seg"))
            ).drop("_k", "_seg")
        else:
            return each.select(key, F.col("r.n").alias(order), F.col("r.x").alias("symbol"), before.alias("before"), F.get("trail", F.col("i") + 1).alias("after"))
    raise AssertionError


def letter_sequence(letters: int = 5) -> list[list[int]]:
    """The automaton of lettered options: state i has read i options in order; the first opens a new list at any end."""
    return [[s] + [x if x == s + 1 or (s == letters and x == 1) else s for x in range(1, letters + 1)] for s in range(letters + 1)]
