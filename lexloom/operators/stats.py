"""Descriptive statistics, agreement and rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import kept


def overview(docs: DataFrame, tokens: Column, **conditions: Column) -> DataFrame:
    """One row: documents, tokens, types, type/token ratio, mean, median and deviation of length, counts of conditions."""
    sized = kept(docs.select(F.size(tokens).alias("n"), *[c.alias(k) for k, c in conditions.items()]), "sizes")
    middle = quantiles(sized.select("n", F.lit(0).alias("all")), "all", "n", [0.5]).agg(F.max("value")).scalar()
    types = docs.select(F.explode(tokens).alias("t")).agg(F.count_distinct(F.lower("t"))).scalar()
    out = sized.agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.avg("n").alias("mean_tokens"), middle.alias("median_tokens"),
        F.stddev("n").alias("sd_tokens"), *[F.count_if(F.col(k)).alias(k) for k in conditions],
    )
    return out.withColumn("n_types", types).withColumn("type_token_ratio", F.col("n_types") / F.col("n_tokens"))


def class_summary(docs: DataFrame, cls: str, tokens: Column) -> DataFrame:
    """Per class: documents, tokens, mean length, types, and the share of all documents in percent."""
    sized = docs.select(cls, tokens.alias("tokens")).withColumn("n", F.size("tokens"))
    counts = sized.groupBy(cls).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.avg("n").alias("mean_tokens"))
    types = sized.select(cls, F.explode("tokens").alias("t")).groupBy(cls).agg(F.count_distinct(F.lower("t")).alias("n_types"))
    total = F.sum("n_docs").over(Window.partitionBy())
    return counts.join(types, cls, "left").withColumn("percent", F.bround(100 * F.col("n_docs") / total, 1)).withColumn("n_types", F.coalesce("n_types", F.lit(0)))


def crosstab(df: DataFrame, rows: str, columns: str, total: str = "Total") -> DataFrame:
    """Counts by two columns with margins, in long form."""
    cube = df.cube(rows, columns).agg(F.count(F.lit(1)).alias("n"), F.grouping(rows).alias("gr"), F.grouping(columns).alias("gc"))
    return cube.select(
        F.when(F.col("gr") == 1, F.lit(total)).otherwise(F.col(rows).cast("string")).alias(rows),
        F.when(F.col("gc") == 1, F.lit(total)).otherwise(F.col(columns).cast("string")).alias(columns), "n",
    )


def crosstab_wide(df: DataFrame, rows: str, columns: str, values: list[str], total: str = "Total") -> DataFrame:
    """The same, one column for each of ``values`` and the total; 0 where a cell is empty."""
    return crosstab(df, rows, columns, total).groupBy(rows).pivot(columns, [*values, total]).agg(F.first("n")).fillna(0)


#: Buckets of one refinement.
BUCKETS = 1024


def quantiles(df: DataFrame, group: str, value: str, points: list[float]) -> DataFrame:
    """(group, point, value): exact quantiles of each group, interpolated between the two rows next to a point.

    By distributed selection: the range that holds a wanted rank is cut into buckets, these are counted, and the one with
    the rank is the next range, until it holds one value. A round is one aggregate over the rows still in a range; what a
    group keeps is a row a bucket, however many values it has. Null values are left out; a null group is a group.
    """
    slim = kept(df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")), "values")
    sizes = kept(slim.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    asked = sizes.select("*", F.explode(F.array(*map(F.lit, points))).alias("point")).withColumn("at", (F.col("n") - 1) * F.col("point"))
    asked = kept(asked.select("g", "point", "at", F.floor("at").alias("low"), F.ceil("at").alias("high"), "lo", "hi"), "asked")
    ranks = asked.select("g", F.explode(F.array("low", "high")).alias("rank"), "lo", "hi").distinct().withColumn("below", F.lit(0).cast("long"))
    done, open_ = ranks.where("lo = hi").select("g", "rank", F.col("lo").alias("v")), kept(ranks.where("lo < hi"), "open")
    while not open_.isEmpty():
        spans = open_.select(F.col("g").alias("s"), "lo", "hi", "below").distinct()
        # halves, as the whole range of a double is none
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        inside = slim.join(spans, F.col("g").eqNullSafe(F.col("s")) & F.col("v").between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy("g", "lo", "hi", "below", F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        run = F.sum("c").over(Window.partitionBy("g", "lo", "hi").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.select(F.col("g").alias("s"), F.col("lo").alias("l"), F.col("hi").alias("h"), (F.col("below") + run - F.col("c")).alias("from"), (F.col("below") + run).alias("to"), "least", "most")
        here = open_.join(counts, F.col("g").eqNullSafe(F.col("s")) & (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
        here = kept(here.select("g", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("from").alias("below")), "refined")
        done = done.unionByName(here.where("lo = hi").select("g", "rank", F.col("lo").alias("v")))
        open_ = here.where("lo < hi")
    done = kept(done, "ranks")
    of = lambda c: done.select(F.col("g").alias(f"g_{c}"), F.col("rank").alias(f"r_{c}"), F.col("v").alias(f"v_{c}"))
    on = lambda c: F.col("g").eqNullSafe(F.col(f"g_{c}")) & (F.col(c) == F.col(f"r_{c}"))
    both = asked.join(of("low"), on("low")).join(of("high"), on("high"))
    return both.select(F.col("g").alias(group), "point", (F.col("v_low") + (F.col("v_high") - F.col("v_low")) * (F.col("at") - F.col("low"))).alias("value"))


def describe_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per group."""
    plain = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    at = lambda p: F.max(F.when(F.col("point") == p, F.col("value")))
    quarters = quantiles(df, group, value, [0.25, 0.5, 0.75]).groupBy(F.col(group).alias("_g")).agg(at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))
    return plain.join(quarters, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "n", "mean", "sd", "min", "q25", "q50", "q75", "max")


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Equal-width bins over the range of a column, the last one closed; empty bins are there with 0."""
    spark = df.sparkSession
    values = df.where(F.col(value).isNotNull())
    low, high = (values.agg(f(value).cast("double")).scalar() for f in (F.min, F.max))
    placed = values.select(F.col(value).cast("double").alias("x"), low.alias("lo"), high.alias("hi")).select(
        F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins))).cast("long").alias("bin")
    )
    return spark.range(1, bins + 1).withColumnRenamed("id", "bin").join(placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def extremes(df: DataFrame, value: Column, position: str, keep: list[str]) -> DataFrame:
    """The rows with the least and the greatest value, the first position of each."""
    rows = df.select(value.alias("value"), position, *[k for k in keep if k != position])
    pick = F.struct(*[c for c in rows.columns])
    out = rows.agg(
        F.min_by(pick, F.struct("value", position)).alias("shortest"), F.min_by(pick, F.struct((-F.col("value")).alias("v"), F.col(position))).alias("longest")
    )
    return out.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("row")) for k in ("shortest", "longest")])).alias("x")).select("x.kind", "x.row.*")


def full_domain(df: DataFrame, value: str, domain: list[int]) -> DataFrame:
    """Counts over a whole domain, zeros kept."""
    spark = df.sparkSession
    all_values = spark.createDataFrame([(v,) for v in domain], f"{value} int")
    return all_values.join(df.groupBy(value).agg(F.count(F.lit(1)).alias("n")), value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


def confusion(df: DataFrame, truth: str, predicted: str, labels: list) -> DataFrame:
    """Counts over labels x labels, zeros kept."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[truth]
    pairs = spark.createDataFrame([(a, b) for a in labels for b in labels], f"{truth} {kind}, {predicted} {kind}")
    counts = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(counts, [truth, predicted], "left").select(truth, predicted, F.coalesce("n", F.lit(0)).alias("n"))


def kappa(df: DataFrame, a: str, b: str, labels: list[int]) -> DataFrame:
    """One row: Cohen's kappa, unweighted and with linear and quadratic weights, over the given labels."""
    joint = confusion(df, a, b, labels).select(F.col(a).alias("i"), F.col(b).alias("j"), "n")
    n = F.sum("n").over(Window.partitionBy())
    expected = F.sum("n").over(Window.partitionBy("i")) * F.sum("n").over(Window.partitionBy("j")) / n
    gap = F.abs(F.col("i") - F.col("j"))
    cells = joint.select("n", expected.alias("e"), (gap > 0).cast("int").alias("plain"), gap.alias("linear"), (gap * gap).alias("quadratic"))
    one = lambda w: (1 - F.sum(F.col(w) * F.col("n")) / F.sum(F.col(w) * F.col("e"))).alias(f"kappa_{w}")
    return cells.agg(one("plain"), one("linear"), one("quadratic"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: share of equal scores, share within one, mean absolute difference."""
    gap = F.abs(F.col(a) - F.col(b))
    return df.agg(F.avg((gap == 0).cast("double")).alias("exact"), F.avg((gap <= 1).cast("double")).alias("within_one"), F.avg(gap).alias("mean_difference"))


def average_rank(df: DataFrame, value: str, splits: int = 32) -> DataFrame:
    """(value, rank): average rank of each distinct value of the whole table, without sorting it in one task.

    Distinct values are dealt to ranges by approximate quantiles; a range's offset is the count of what lies before it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    cuts = sorted(set(counts.agg(F.percentile_approx("x", [i / splits for i in range(1, splits)], 10_000)).first()[0] or []))
    bucket = F.lit(0)
    for cut in cuts:
        bucket = bucket + (F.col("x") > cut).cast("int")
    placed = counts.withColumn("b", bucket)
    offsets = placed.groupBy("b").agg(F.sum("c").alias("held")).select(
        "b", F.coalesce(F.sum("held").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    within = F.sum("c").over(Window.partitionBy("b").orderBy("x"))
    return placed.join(F.broadcast(offsets), "b").select(F.col("x").alias(value), (F.col("before") + within - (F.col("c") - 1) / 2).alias("rank"))


def ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``rank_<column>``, average ranks over all rows."""
    for c in columns:
        r = average_rank(df, c).withColumnsRenamed({c: "_x", "rank": f"rank_{c}"})
        df = df.join(r, F.col(c).cast("double") == F.col("_x")).drop("_x")
    return df


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Spearman's rank correlation with average ranks, and the number of rows with both values."""
    both = ranked(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b), [a, b])
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr(f"rank_{a}", f"rank_{b}").alias("spearman"))


def rank_disagreement(df: DataFrame, key: str, a: str, b: str, k: int = 3) -> DataFrame:
    """The k rows whose ranks under a and b differ most (ties: smaller key)."""
    both = ranked(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, a, b), [a, b])
    return both.withColumn("difference", F.abs(F.col(f"rank_{a}") - F.col(f"rank_{b}"))).orderBy(F.col("difference").desc(), key).limit(k)


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a ratio has no denominator."""
    counts = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    of_truth = counts.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    of_predicted = counts.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("claimed"))
    both = of_truth.join(of_predicted, "label", "full").fillna(0, ["support", "hit", "claimed"])
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    both = both.withColumn("precision", ratio(F.col("hit"), F.col("claimed"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    return both.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support")


def macro_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: macro F1 and accuracy."""
    accuracy = df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double"))).scalar()
    return class_report(df, truth, predicted).agg(F.avg("f1").alias("macro_f1")).withColumn("accuracy", accuracy)


def pair_scores(pairs: DataFrame, notes: DataFrame, annotators: tuple[str, str], tag: str = "humana") -> DataFrame:
    """Join two annotators' scores to their pairs, with mean, median, range and a review flag.

    notes: pair_id, annotator, score. Raises when a pair lacks a score of one of them.
    """
    of = lambda who, i: notes.where(F.col("annotator") == who).select("pair_id", F.col("score").alias(f"score_{i}"))
    out = pairs.join(of(annotators[0], 1), "pair_id", "left").join(of(annotators[1], 2), "pair_id", "left")
    checked = F.col("score_1").isNotNull() & F.col("score_2").isNotNull()
    gap = F.abs(F.col("score_1") - F.col("score_2"))
    mean = (F.col("score_1") + F.col("score_2")) / 2
    return out.where(F.when(checked, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no score of every annotator for pair "), F.col("pair_id").cast("string"))).isNull())).select(
        *pairs.columns, F.lit(tag).alias("annotation"), F.lit(annotators[0]).alias("annotator_1"), "score_1", F.lit(annotators[1]).alias("annotator_2"), "score_2",
        mean.alias("mean_score"), mean.alias("median_score"), gap.alias("amplitude"), F.when(gap >= 2, "sim").otherwise("nao").alias("review"),
    )


def mode_first(df: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """The most frequent value per group; ties go to the value seen first."""
    counts = df.groupBy(group, value).agg((-F.count(F.lit(1))).alias("_fewer"), F.min(position).alias("_first"))
    return counts.groupBy(group).agg(F.min_by(F.col(value), F.struct("_fewer", "_first")).alias("mode"))


def with_notes(scores: DataFrame, notes: DataFrame, keys: list[str], note: str) -> DataFrame:
    """``scores`` with the note of the same keys, null where there is none. Raises when a key has several notes."""
    single = notes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(note).alias(note))
    several = F.raise_error(F.concat_ws(" ", F.lit("several notes for"), *[F.col(k).cast("string") for k in keys])).cast(single.schema[note].dataType)
    return scores.join(single.select(*keys, F.when(F.col("_n") == 1, F.col(note)).otherwise(several).alias(note)), keys, "left")


def compared_scores(df: DataFrame, model: str, humans: list[str]) -> DataFrame:
    """(human, n, n_noted, n_equal, mean_human, mean_model), a row for each of ``humans``: rows, rows with a model score,
    rows with the human's very score, and both means."""
    each = df.select(F.col(model).alias("m"), F.explode(F.array(*[F.struct(F.lit(h).alias("human"), F.col(h).cast("double").alias("h")) for h in humans])).alias("x"))
    return each.groupBy(F.col("x.human").alias("human")).agg(
        F.count(F.lit(1)).alias("n"), F.count("m").alias("n_noted"), F.count_if(F.col("m") == F.col("x.h")).alias("n_equal"),
        F.avg("x.h").alias("mean_human"), F.avg("m").alias("mean_model"),
    )


def error_report(missed: DataFrame, texts: DataFrame, key: str, text: str, n: int = 120) -> DataFrame:
    """``missed`` with the beginning of each row's text, ``n`` characters, as ``preview``; null where there is no text."""
    return missed.join(texts.select(key, F.substring(text, 1, n).alias("preview")), key, "left")
