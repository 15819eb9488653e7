"""Bounded, deterministic samples of labelled rows for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 24


def _draw(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("fit")), F.lit(_SCALE))


def labelled_texts(docs: DataFrame, labels: DataFrame, per_class: int) -> list[tuple[bytes, object]]:
    """Up to ``per_class`` (text, label) rows of each label, in the order of a hash of doc_id.

    docs: doc_id, text; labels: doc_id, label. Every class is drawn at a rate that leaves about 1.25 x per_class rows,
    so what reaches the driver is bounded by the number of classes x per_class whole texts.
    """
    labels = labels.where("doc_id is not null and label is not null").select("doc_id", "label")
    counts = labels.groupBy("label").count().collect()
    if not counts:
        return []
    rate = F.lit(0)
    for label, n in counts:
        rate = F.when(F.col("label") == label, F.lit(min(_SCALE, int(_SCALE * 1.25 * per_class / n) + 1))).otherwise(rate)
    chosen = labels.where(_draw(F.col("doc_id")) < rate).distinct().withColumnRenamed("doc_id", "chosen_id")
    rows = docs.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))
    got = sorted(rows.select(_draw(F.col("doc_id")), "label", "doc_id", "text").collect(), key=lambda r: (r[0], r[2], str(r[1])))
    out, seen = [], {}
    for _, label, _, text in got:
        seen[label] = seen.get(label, 0) + 1
        if seen[label] <= per_class:
            out.append((bytes(text), label))
    return out
