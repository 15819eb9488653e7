"""Operator 9, benchmark decontamination: a broadcast hash set of test n-grams, in DataFrame functions only.

The n-grams of the benchmark become a hash set (64-bit hash -> words). One scan reads the texts: a document's windows
are hashed where it lies (those whose first two words begin an n-gram), looked up in the set, and verified word for word
in the same operator. What moves on is a row for each document, with its number of words, and the verified hits. The set
is broadcast while it has at most ``broadcast_grams`` rows, of all sizes together; beyond that Spark joins by shuffling
hashes, with the words joined afterwards for verification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm._tables import ascii_lower, stored

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Rows of the hash set that may be broadcast: about 200 bytes each, so 40 MB at most, and its first words besides.
BROADCAST_GRAMS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_grams(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id, gram): each item's distinct windows of ``n`` words; a shorter item is one window."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("gram")).distinct()


def tokens(docs: DataFrame) -> DataFrame:
    """(row, doc_id, w): documents by number, with their words."""
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))


def hits(read: DataFrame, grams: DataFrame, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(row, doc_id, n_words, pos, gram): where the distinct ``grams`` occur, verified word for word, and a row or more
    without a gram for each document. read: as of ``tokens``, and stored if there are more grams than may be broadcast."""
    count = {r[0]: r[1] for r in grams.groupBy(F.size("gram")).count().collect()}  # as many rows as a window has words
    out = ["row", "doc_id", F.size("w").cast("long").alias("n_words")]
    none = [F.lit(None).cast("int").alias("pos"), F.lit(None).cast("array<string>").alias("gram")]
    keys = grams.select(F.xxhash64("gram").alias("h"), "gram")
    # posexplode_outer: posexplode would make Spark test size(w) > 0 below, and so compute the words twice
    at = read.select("row", "doc_id", "w", F.posexplode_outer("w").alias("i", "x")).withColumn("pos", F.col("i") + 1)
    if not count:
        return read.select(*out, *none)
    if sum(count.values()) > broadcast_grams:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("size"), F.xxhash64(F.slice("w", F.col("pos"), n)).alias("h")) for n in sorted(count)]))
        maybe = at.where("pos is not null").select("row", "pos", each.alias("k")).select("row", "pos", "k.h").join(keys, "h").select("row", "pos", "gram")
        found = maybe.join(read, "row").where(F.slice("w", F.col("pos"), F.size("gram")) == F.col("gram")).select(*out, "pos", "gram")
        return read.select(*out, *none).unionByName(found)
    # a test of the first two words comes before the window's own hash; windows of one word have their own test
    longer = grams.where(F.size("gram") > 1).select(F.xxhash64(F.element_at("gram", 1), F.try_element_at("gram", F.lit(2))).alias("lead"), F.size("gram").alias("size")).distinct()
    first = F.coalesce(F.col("pos") <= 1, F.lit(True))
    seen = at.withColumn("lead", F.xxhash64("x", F.try_element_at("w", F.col("pos") + 1))).join(F.broadcast(longer), "lead", "left")
    if 1 in count:
        single = grams.where(F.size("gram") == 1).select(F.xxhash64(F.element_at("gram", 1)).alias("word"), F.lit(1).alias("alone"))
        seen = seen.withColumn("word", F.xxhash64("x")).join(F.broadcast(single), "word", "left").where(first | F.col("size").isNotNull() | F.col("alone").isNotNull())
        seen = seen.select("row", "doc_id", "w", "pos", F.explode(F.array("size", "alone")).alias("size"))
    seen = seen.where(first | F.col("size").isNotNull()).select("row", "doc_id", "w", "pos", "size")
    window = F.slice("w", F.col("pos"), F.col("size"))
    met = seen.withColumn("h", F.when(F.col("size").isNotNull(), F.xxhash64(window))).join(F.broadcast(keys), "h", "left")
    right = F.coalesce(F.col("gram") == window, F.lit(False))
    return met.where(first | right).select(*out, "pos", F.when(right, F.col("gram")).alias("gram"))


def _read(docs: DataFrame, grams: DataFrame, broadcast_grams: int) -> DataFrame:
    return tokens(docs) if grams.count() <= broadcast_grams else stored(tokens(docs), "words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Find the benchmark's ``n``-word windows in documents.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Returns, one row per document, doc_id,
    n_words, n_hit (words inside any occurrence of a window), n_items (items with occurring windows), items_sha256
    (of their ids, sorted as strings, comma-joined) and contaminated (n_hit > 0). ``without_hits`` and a filter on
    contaminated take the passages or the documents out.

    Null and empty texts have no words. Items without words match nothing, whatever their number; repeated items all
    count; an item without an id counts as hit words but is in no list. Every row is judged by its own text, those that
    repeat a doc_id or have none too. An empty documents table gives an empty result, an empty benchmark no hits.
    Overlapping windows count a word once. Documents of any length are read whole; a document's words are held at once.
    """
    grams = stored(benchmark_grams(benchmark, n), "grams")
    distinct = grams.select("gram").distinct()
    found = stored(hits(_read(docs, distinct, broadcast_grams), distinct, broadcast_grams), "hits")
    hit = found.where("gram is not null").select("row", "pos", "gram")
    # words that a window adds to those before it
    before = Window.partitionBy("row").orderBy("pos", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = hit.select("row", "pos", (F.col("pos") + F.size("gram")).alias("stop")).distinct().withColumn("reached", F.max("stop").over(before))
    covered = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("pos", "reached"))).cast("long").alias("n_hit"))
    items = (
        hit.select("row", "gram").distinct().join(grams, "gram").where("item_id is not null").select("row", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    )
    return found.select("row", "doc_id", "n_words").distinct().join(covered, "row", "left").join(items, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, clean_words): the documents' normalised words with all hit spans removed. Same cases as above."""
    grams = stored(benchmark_grams(benchmark, n).select("gram").distinct(), "grams")
    read = stored(tokens(docs), "words")
    spans = hits(read, grams, broadcast_grams).where("gram is not null").select("row", "pos", (F.col("pos") + F.size("gram")).alias("stop")).distinct()
    before = Window.partitionBy("row").orderBy("pos", "stop").rowsBetween(Window.unboundedPreceding, -1)
    gaps = spans.withColumn("reached", F.coalesce(F.max("stop").over(before), F.lit(1))).groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos") > F.col("reached"), F.struct(F.col("reached").alias("lo"), F.col("pos").alias("hi"))))).alias("gaps"), F.max("stop").alias("last")
    )
    kept = F.flatten(F.transform("gaps", lambda g: F.slice("w", g["lo"], g["hi"] - g["lo"])))
    rest = F.slice("w", F.col("last"), F.greatest(F.size("w") - F.col("last") + 1, F.lit(0)))
    return read.join(gaps, "row", "left").select("doc_id", F.when(F.col("gaps").isNull(), F.col("w")).otherwise(F.concat(kept, rest)).alias("clean_words"))
