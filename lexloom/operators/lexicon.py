"""Weighted-lexicon scoring.

A lexicon is a DataFrame (area, area_ord, weight, term) and a parameter everywhere; ``stopword_lexicon`` is one for four
languages. Terms are words or phrases, with or without signs; whole terms count, in the normalised text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.session import kept

#: Area, strong terms (weight 2), weak terms (weight 1); areas in tie order.
LANGUAGES = [
    ("en", ["the", "and", "that", "with"], ["of", "to", "is", "in"]),
    ("fr", ["les", "une", "dans", "pour"], ["le", "est", "que", "un"]),
    ("de", ["und", "der", "das", "nicht"], ["die", "ist", "mit", "ein"]),
    ("es", ["los", "una", "para", "por"], ["el", "las", "que", "con"]),
]
#: Fixed value: a network term that contains a security term is rewritten before scoring.
REWRITES = {"controle de acesso ao meio": "mac_camada_enlace csma/cd"}


def lexicon(spark: SparkSession, areas: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    rows = [(a, i, w, t) for i, (a, strong, weak) in enumerate(areas) for w, terms in ((2, strong), (1, weak)) for t in terms]
    return spark.createDataFrame(rows, "area string, area_ord int, weight int, term string")


def stopword_lexicon(spark: SparkSession) -> DataFrame:
    return lexicon(spark, LANGUAGES)


def prepared(text: Column, rewrites: dict[str, str] = REWRITES) -> Column:
    out = T.norm(text)
    for a, b in rewrites.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


#: Atoms of a text and of a term: runs of word characters, and every other character alone.
ATOM = f"{T.W}+|[^\\p{{L}}\\p{{N}}_]"
#: Terms up to which a lexicon is broadcast and sifts the grams of a text by their first atom; a larger one is joined.
BROADCAST_TERMS = 50_000


def _word(atom: Column) -> Column:
    return F.coalesce(F.rlike(atom, F.lit(f"^{T.W}")), F.lit(False))


def term_hits(docs: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """(key, term, n): how often each normalised term occurs in normalised texts as a whole term. terms: term.

    Text and terms are cut into atoms, and a text's atom runs of the terms' lengths are joined with the terms by value, so
    that a text is read once, however many terms there are. Word atoms are maximal, so a run of atoms is a whole term, but
    for a term that begins or ends with a sign: it may not touch a word there. Occurrences of one term do not overlap;
    the first counts, then the next that begins after it.
    """
    atoms = F.regexp_extract_all("term", F.lit(ATOM), F.lit(0))
    every_term = kept(terms.where("term <> ''").select("term", atoms.alias("a")).distinct(), "terms")
    small = every_term.count() <= BROADCAST_TERMS
    one_word = (F.size("a") == 1) & _word(F.get("a", F.lit(0)))
    # terms of one word need no runs
    single, cut = every_term.where(one_word).select("term"), every_term.where(~one_word)
    words = T.words(text)
    if small:
        words = F.filter(words, lambda x: x.isin([r[0] for r in single.collect()]))
    alone = docs.select(key, F.explode(words).alias("term")).join(F.broadcast(single) if small else single, "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    sizes = sorted(r[0] for r in cut.select(F.size("a")).distinct().collect())
    if not sizes:
        return alone
    first = {n: [r[0] for r in cut.where(F.size("a") == n).select(F.get("a", F.lit(0))).distinct().collect()] for n in sizes} if small else {}
    base = docs.select(key, F.regexp_extract_all(text, F.lit(ATOM), F.lit(0)).alias("a"))
    # one look at each atom: only where a term may begin are runs put together
    every = sorted({x for some in first.values() for x in some})
    starts = F.array_compact(F.transform("a", lambda x, i: F.when(x.isin(every), i))) if small else F.transform("a", lambda x, i: i)

    def runs(i: Column) -> Column:
        x = F.get("a", i)
        opens = _word(x) | ~_word(F.get("a", i - 1))

        def run(n: int) -> Column:
            closes = _word(F.get("a", i + (n - 1))) | ~_word(F.get("a", i + n))
            begins = x.isin(first[n]) if small else F.lit(True)
            whole = F.array_join(F.slice("a", i + 1, F.lit(n)), "") if n > 1 else x
            return F.when(begins & (i + n <= F.size("a")) & opens & closes, F.struct(i.alias("i"), whole.alias("term")))

        return F.array_compact(F.array(*[run(n) for n in sizes]))

    met_runs = F.flatten(F.transform(starts, runs))
    grams = base.select(key, F.explode(met_runs).alias("g")).select(key, "g.i", "g.term")
    # a term may overlap itself if an end of it is a beginning of it
    ends = F.exists(F.sequence(F.lit(1), F.greatest(F.size("a") - 1, F.lit(1))), lambda m: (F.size("a") > 1) & (F.slice("a", 1, m) == F.slice("a", F.size("a") - m + 1, m)))
    listed = cut.select("term", F.size("a").alias("size"), ends.alias("bordered"))
    met = grams.join(F.broadcast(listed) if small else listed, "term")
    plain = met.where("not bordered").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    step = lambda s, i: F.when(i >= s["free"], F.struct((s["n"] + 1).alias("n"), (i + F.col("size")).alias("free"))).otherwise(s)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("free"))
    places = met.where("bordered").groupBy(key, "term").agg(F.array_sort(F.collect_list("i")).alias("at"), F.first("size").alias("size"))
    return alone.unionByName(plain).unionByName(places.select(key, "term", F.aggregate("at", start, step)["n"].alias("n")))


def scores(docs: DataFrame, key: str, text: Column, lex: DataFrame, rewrites: dict[str, str] = REWRITES) -> DataFrame:
    """(key, area, area_ord, score, strong): areas with a hit. strong: distinct terms of weight 2 that occur.

    A term of weight 2 counts 2 x min(occurrences, 3), one of weight 1 counts once. Terms may be words, phrases, and hold
    signs.
    """
    rows = kept(lex.withColumn("w", T.norm("term")), "lexicon")
    found = term_hits(docs, key, prepared(text, rewrites), rows.select(F.col("w").alias("term"))).withColumnRenamed("term", "w")
    points = F.when(F.col("weight") == 2, 2 * F.least("n", F.lit(3))).otherwise(F.lit(1))
    small = rows.count() <= BROADCAST_TERMS
    return found.join(F.broadcast(rows) if small else rows, "w").groupBy(key, "area", "area_ord").agg(
        F.sum(points).cast("long").alias("score"), F.count_if(F.col("weight") == 2).alias("strong")
    )


def combined(a: DataFrame, b: DataFrame, key: str, times: int = 2) -> DataFrame:
    """``times`` x the scores of one text plus those of another."""
    both = a.withColumn("score", F.col("score") * times).unionByName(b)
    return both.groupBy(key, "area", "area_ord").agg(F.sum("score").alias("score"), F.max("strong").alias("strong"))


def decide(scored: DataFrame, key: str, margin: int = 4) -> DataFrame:
    """Best and second area (ties: area order), and whether the lead is ``margin`` or more. Unscored rows are not there."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "area_ord")
    top = scored.withColumn("r", F.row_number().over(w)).where("r <= 2")
    at = lambda i, c: F.max(F.when(F.col("r") == i, F.col(c)))
    out = top.groupBy(key).agg(at(1, "area").alias("area"), at(1, "score").alias("score"), at(1, "strong").alias("strong"), F.coalesce(at(2, "score"), F.lit(0)).alias("runner_up"))
    return out.withColumn("confident", F.col("score") - F.col("runner_up") >= margin)


def in_domain(decided: DataFrame, least: int = 3, special: Column | None = None, least_special: int = 2) -> DataFrame:
    """Add ``in_domain``: a strong term and enough points, fewer where ``special`` holds."""
    bar = F.lit(least) if special is None else F.when(special, least_special).otherwise(least)
    return decided.withColumn("in_domain", (F.col("strong") >= 1) & (F.col("score") >= bar))


#: Patterns of section titles, as fixed values; matched anywhere, in any case.
OTHER_SUBJECT = (
    "portugu|ingl|direito|legisla|racioc|matem|atualidad|hist[oó]ria|geografia|[ée]tica|sustentab|administra[cç][aã]o p[uú]blica"
    "|administra[cç][aã]o financeira|contab|auditoria governamental|controle externo|banc[aá]rio|sus(?![\\p{L}\\p{N}_])|normas espec"
    "|organiza[cç][aã]o do minist|filosofia|estat[ií]stica|conhecimentos gerais|conhecimentos b[aá]sicos|c onhecimentos (g|b)"
)
COMPUTING = "inform[aá]|tecnolog|(?<![\\p{L}\\p{N}_])ti(?![\\p{L}\\p{N}_])|t\\. ?i\\.|seguran[cç]a da informa|dados|sistemas de informa|governan[cç]a"
LANGUAGE = "l[íi]ngua|portugu|ingl"
SPECIFIC = "espec[ií]fic"


def section_is(section: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(section, F.lit(f"(?iu){pattern}")), F.lit(False))


def domain_reason(section: Column, score: Column, strong: Column, rescue: int = 8) -> Column:
    """Why a record lies outside the domain, or null: its section first, then its terms."""
    special = section_is(section, COMPUTING) | section_is(section, SPECIFIC)
    by_section = section_is(section, LANGUAGE) | (section_is(section, OTHER_SUBJECT) & ~section_is(section, COMPUTING) & (score < rescue))
    fits = (strong >= 1) & (score >= F.when(special, 2).otherwise(3))
    return F.when(by_section, "fora_de_computacao_secao").when(~fits, "fora_de_computacao_sem_termos_de_TI")
