"""Operator 5, URL filters: a character language-model ratio, in DataFrame functions only.

Rules decide what they fit. The URLs they decide train two smoothed variable-order Markov models, of accepted and of
rejected URLs: the probability of a character after its longest context is interpolated with that after each shorter
one, down to single characters. A URL that no rule fits is judged by the difference of its log-likelihoods under the
two models, divided by its length, against a threshold calibrated on decided URLs that the models have not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm._tables import ascii_lower, stored

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
ORDER = 5  # characters: the last one and a context of up to four
WEIGHT = 4.0  # of the shorter context's estimate, in observations
ALPHABET = 256.0


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none or the url is null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return ascii_lower(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1))


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (ties: the rule listed first), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(text: Column, order: int) -> Column:
    padded = F.concat(F.lit("^" * (order - 1)), text)
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(padded, i, F.lit(order)))


def markov_ratio(counts: DataFrame, order: int, weight: float) -> DataFrame:
    """(gram, ratio): log P(last character | context) under accepted minus rejected. counts: gram, a, r."""
    model = None
    for k in range(1, order + 1):
        own = counts.groupBy(F.substring("gram", -k, k).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        if k == 1:
            scored = own.select("g", "a", "r", own.agg(F.sum("a")).scalar().alias("ta"), own.agg(F.sum("r")).scalar().alias("tr"))
            below_a = below_r = F.lit(1.0 / ALPHABET)
        else:
            total = own.groupBy(F.substring("g", 1, k - 1).alias("c")).agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
            scored = own.join(total, F.substring(own["g"], 1, k - 1) == total["c"]).join(
                model.select(F.col("g").alias("b"), F.col("pa").alias("ba"), F.col("pr").alias("br")), F.substring(own["g"], 2, k - 1) == F.col("b")
            )
            below_a, below_r = F.col("ba"), F.col("br")
        model = stored(
            scored.select(
                "g", ((F.col("a") + weight * below_a) / (F.col("ta") + weight)).alias("pa"), ((F.col("r") + weight * below_r) / (F.col("tr") + weight)).alias("pr")
            ),
            f"order{k}",
        )
    return model.select(F.col("g").alias("gram"), (F.log("pa") - F.log("pr")).alias("ratio"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row (t): what best separates accepted from rejected in ``scored`` (score, accepted).

    Scores are counted in hundredths; t lies midway between the best cut's bin and the next one below that holds rows.
    """
    bins = scored.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(
        F.sum(F.when(F.col("accepted"), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("accepted"), 0).otherwise(1)).alias("r")
    )
    down = Window.orderBy(F.col("bin").desc())  # a row per bin: thousands at most
    above, total = down.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    gain = bins.select(
        "bin", F.coalesce(F.lead("bin").over(down) + 1, F.col("bin")).alias("low"), F.sum("a").over(above).alias("a"), F.sum("r").over(above).alias("r"),
        F.sum("a").over(total).alias("ta"), F.sum("r").over(total).alias("tr"),
    ).where("ta > 0 and tr > 0")
    best = gain.agg(F.max(F.struct((F.col("a") * F.col("tr") - F.col("r") * F.col("ta")).alias("gain"), F.col("bin"), F.col("low"))).alias("x"))
    return best.select(F.coalesce((F.col("x.bin") + F.col("x.low")) / 200.0, F.lit(0.0)).alias("t"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, order: int = ORDER, weight: float = WEIGHT) -> DataFrame:
    """Judge every url by rule, else by the character language-model ratio.

    pages: page_id, url and any other columns, which are ignored. Returns page_id, host, path, rule, verdict, score,
    one row per input row. Urls that are null or without ``://`` have empty host and path and a score of 0; so has
    every url if the rules decide none, or only one way (the threshold is then 0, and scores of 0 or more are
    allowed). Rows that repeat, or have no page_id, are all judged and all counted in training. Ties between rules of
    one length go to the rule listed first; a score equal to the threshold is allowed. Urls of any length are judged
    whole; the grams of one are held in one row. An empty table gives an empty result.
    """
    rest = rest_of(F.col("url"))
    read = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", F.col("url").isNull().alias("none"), rest.alias("rest")).select(
        "row", "page_id", host_of(F.col("rest")).alias("host"), path_of(F.col("rest")).alias("path"), ascii_lower(F.col("rest")).alias("text")
    )
    read = stored(read.withColumn("by", rule_of(F.col("host"), F.col("path"), rules)), "urls")
    # a fifth of the decided urls calibrate, the others train
    decided = F.col("by").isNotNull()
    calibrates = F.substring(F.md5(F.col("text").cast("binary")), 1, 1).isin("0", "1", "2")
    accepted = F.col("by.verdict") == "allow"
    trains = decided & ~calibrates
    # counted before they are shuffled: the grams of a url that many rows hold are a row a task by then
    counted = read.select(F.when(trains & accepted, 1).otherwise(0).alias("a"), F.when(trains & ~accepted, 1).otherwise(0).alias("r"), F.explode_outer(grams(F.col("text"), order)).alias("gram"))
    counts = stored(counted.where("gram is not null").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "grams")
    model = markov_ratio(counts, order, weight)
    # dealt anew: Spark would join the small distinct urls in few tasks, which would then hold them many times over as grams;
    # one part more than it takes itself, or it would see nothing to do
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    each = read.select("text").distinct().repartition(parts, "text").select("text", F.explode_outer(grams(F.col("text"), order)).alias("gram")).where("gram is not null")
    scores = stored(each.groupBy("text", "gram").agg(F.count(F.lit(1)).alias("n")).join(model, "gram").groupBy("text").agg((F.sum(F.col("ratio") * F.col("n")) / F.sum("n")).alias("score")), "scores")
    judged = read.join(scores, "text", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    t = threshold(judged.where(decided & calibrates).select("score", accepted.alias("accepted")))
    return judged.select(
        "page_id", "host", "path", F.col("by.rule").alias("rule"),
        F.coalesce(F.col("by.verdict"), F.when(F.col("score") >= t.scalar(), "allow").otherwise("block")).alias("verdict"), "score",
    )
