"""Exam texts to question records: what depends on earlier accepted lines runs per exam in Python, the rest in the JVM."""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from itertools import groupby, takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import lines as L

RAW = "exam string, number int, line_no int, statement array<string>, options map<string,array<string>>, merged boolean, context array<string>"
LOOK_AHEAD = 399
#: How a passage shared by the next questions begins.
CONTEXT = re.compile(
    r"^(READ THE TEXT|Read the text|Leia o texto|Texto\s+(\d+|[IVX]+)\b|Tabela\s+\d+\b|Considere .{0,80}\b(nas|para as|às) (duas|tr[êe]s|quatro|pr[óo]ximas) quest"
    r"|As quest[õo]es \d+|Utilize .{0,60}quest|Com base no texto a seguir|Atenção:)"
)
BULLETS = re.compile(r"[•▪±·\s]+")
OPTION = re.compile(r"\(([A-E])\)\s*(.*)", re.S)
#: Marks of an answer key, and what its lines hold besides headers.
ANSWER = re.compile(r"([A-EX*]|NULA|ANULADA)", re.I)
KEY_NOISE = re.compile(r"pcimark|\(?\*|P[áa]gina|\(?[A-Z]?\)?\s*[–-]?\s*Quest")
KEY_NOISE_ANYWHERE = re.compile(r"pciconcursos|(?i:GABARITO|CONCURSO|EDITAL|APLICAD|PROVIMENTO|QUADRO DE PESSOAL|^\d{2}/\d{2}/\d{4}$)")
SHIFTS = {"manha": re.compile(r"\bMANH[AÃ]\b", re.I), "tarde": re.compile(r"\bTARDE\b", re.I)}


def numbered(texts: list[str]) -> list[int]:
    """Places of the lines that begin a question.

    Candidates are the lines that are one number. Each has a horizon: the next line that is the number after it, or
    ``LOOK_AHEAD`` lines. Those without a line of option A before their horizon are out; of the rest the chain is taken
    in which every number is the one due or up to two later.
    """
    at = [i for i, x in enumerate(texts) if x.isdecimal()]
    value = {i: int(texts[i]) for i in at}
    places: dict[int, list[int]] = defaultdict(list)
    for i in at:
        places[value[i]].append(i)
    firsts = [i for i, x in enumerate(texts) if x.startswith("(A)")]

    def has_options(i: int) -> bool:
        later = places.get(value[i] + 1, [])
        k = bisect.bisect_right(later, i)
        horizon = min(later[k] if k < len(later) else len(texts), i + 1 + LOOK_AHEAD)
        k = bisect.bisect_right(firsts, i)
        return k < len(firsts) and firsts[k] < horizon

    chain: list[int] = []
    for i in filter(has_options, at):
        if 0 <= value[i] - (value[chain[-1]] + 1 if chain else 1) <= 2:
            chain.append(i)
    return chain


def letters_due(marks: list[str | None]) -> list[int]:
    """Places of the marks A, B, C, ... in turn; a mark out of turn is none."""
    found: list[int] = []
    for letter in "ABCDE":
        k = next((i for i in range(found[-1] + 1 if found else 0, len(marks)) if marks[i] == letter), None)
        if k is None:
            break
        found.append(k)
    return found


def split_body(body: list[str]) -> dict:
    """One question's lines to statement, options, a merged flag, and a passage that belongs to the next question.

    The lines that open an option in turn cut the body into the statement and the options' segments; another option's
    mark inside a segment tells that two questions were merged.
    """
    matches = [OPTION.fullmatch(x) for x in body]
    cuts = letters_due([m and m[1] for m in matches])
    if not cuts:
        return {"statement": body, "options": {}, "merged": False, "context": []}
    segments = [body[lo:hi] for lo, hi in zip(cuts, [*cuts[1:], len(body)])]
    merged = any(m for i, m in enumerate(matches) if i > cuts[0] and i not in cuts)
    options = [[x for x in (matches[lo][2],) if x] + segment[1:] for lo, segment in zip(cuts, segments)]
    at = next((i for i, x in enumerate(options[-1]) if CONTEXT.match(x)), len(options[-1]))
    options[-1], context = options[-1][:at], options[-1][at:]
    if len(options[-1]) > 1 and _subtitle(*options[-1][-2:]):
        del options[-1][-1]
    kept = [x[: len(x) - sum(1 for _ in takewhile(BULLETS.fullmatch, reversed(x)))] for x in options]
    return {"statement": body[: cuts[0]], "options": dict(zip("ABCDE", kept)), "merged": merged, "context": context}


def _subtitle(before: str, line: str) -> bool:
    """Whether the last line of the last option is a heading that the conversion left there."""
    return before[-1:] in (".", ";") and line[:1].isupper() and len(line.split()) <= 7 and re.fullmatch(r"[A-Za-zÀ-ÿ0-9 &/–-]+", line) is not None


def _questions(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("line_no")
    texts, title = group["text"].tolist(), group["in_title"].tolist()
    found = numbered(texts)
    rows = []
    for i, end in zip(found, [*found[1:], len(texts)]):
        body = [texts[k] for k in range(i + 1, end) if texts[k] != L.PAGE and not title[k]]
        rows.append({"exam": group["exam"].iloc[0], "number": int(texts[i]), "line_no": int(group["line_no"].iloc[i]), **split_body(body)})
    return pd.DataFrame(rows, columns=["exam", "number", "line_no", "statement", "options", "merged", "context"])


def exam_lines(exams: DataFrame) -> DataFrame:
    """(exam, line_no, text) of (exam, text): mapped, cleaned of headers, numbered in order."""
    return L.renumbered(L.without_headers(L.page_lines(exams, "exam"), "exam"), "exam", "line_no")


def questions(exams: DataFrame) -> DataFrame:
    """Questions of (exam, text): number, section, statement and option lines, merged, received_context."""
    titled = L.titled(L.split_glued_numbers(exam_lines(exams), "exam"), "exam")
    sections = L.forward_filled(titled, "exam", F.col("title").isNotNull(), F.col("title"), "section").select("exam", "line_no", "section")
    raw = titled.select("exam", "line_no", "text", "in_title").groupBy("exam").applyInPandas(_questions, RAW)
    order = Window.partitionBy("exam").orderBy("line_no")
    passed = F.coalesce(F.lag("context").over(order), F.array().cast("array<string>"))
    out = raw.withColumn("passed", passed).join(sections, ["exam", "line_no"], "left")
    return out.select("exam", "number", "line_no", "section", F.concat("passed", "statement").alias("statement"), "options", "merged", (F.size("passed") > 0).alias("received_context"))


def key_blocks(keys: DataFrame) -> DataFrame:
    """Answer blocks of (exam, text): header, shift, and answers by number; one row per block, in order."""

    def parse(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text in group["text"]:
            rows += [{"exam": group["exam"].iloc[0], "block_no": i, **b} for i, b in enumerate(blocks(text or ""))]
        return pd.DataFrame(rows, columns=["exam", "block_no", "header", "shift", "answers"])

    return keys.select("exam", "text").groupBy("exam").applyInPandas(parse, "exam string, block_no int, header string, shift string, answers map<int,string>")


def blocks(text: str) -> list[dict]:
    """Answer blocks of one key: header, shift, answers by number.

    Every line is classified first: a row of numbers that the next filled line answers, that line itself, noise, or header
    text. Runs of neighbouring header lines are headers. A block begins at a row of answers that has a header since the row
    before it, the last one; further rows belong to it. Its shift is the last one that a line above it names.
    """
    lines = pd.Series([x.strip() for x in text.splitlines()], dtype=object)
    filled = [i for i, x in enumerate(lines) if x]
    after = dict(zip(filled, filled[1:]))
    rows: dict[int, dict[int, str]] = {}
    spent: set[int] = set()
    for i in filled:
        numbers, marks = lines[i].split(), lines[after[i]].split() if i in after else []
        if i not in spent and all(map(str.isdecimal, numbers)) and len(numbers) == len(marks) and all(map(ANSWER.fullmatch, marks)):
            rows[i] = {int(n): m.upper() if m.upper() in "ABCDE" else "ANULADA" for n, m in zip(numbers, marks)}
            spent |= {i, *range(i, after[i] + 1)}
    titles = [i for i in filled if i not in spent and len(lines[i]) > 3 and not KEY_NOISE.match(lines[i]) and not KEY_NOISE_ANYWHERE.search(lines[i])]
    runs = [[i for _, i in group] for _, group in groupby(enumerate(titles), lambda x: x[1] - x[0])]
    named = [(i, name) for i in filled for name, word in SHIFTS.items() if "turno" not in lines[i].lower() and word.search(lines[i])]
    out: list[dict] = []
    before = -1
    for i, answers in rows.items():
        above = [run for run in runs if before < run[-1] < i]
        if above:
            out.append({"header": " ".join(lines[above[-1]]), "shift": next((name for k, name in reversed(named) if k < i), None), "answers": {}})
        if out:
            out[-1]["answers"] |= answers
        before = i
    return out


#: Words that say nothing about the post.
HEADER_STOP = "de da do das dos e em a o fgv prova tipo".split()
HEADER_STOP_BLOCK = [*HEADER_STOP, *map(str, range(10)), "manha", "tarde", "turno", "branca"]


def best_match(left: DataFrame, right: DataFrame, key: str, a: Column, b: Column, order: str, bonus: Column | None = None) -> DataFrame:
    """For each key, the row of ``right`` whose token set is most like that of ``left`` (ties: the first in ``order``)."""
    score = T.jaccard(a, b) + (bonus if bonus is not None else F.lit(0.0))
    both = left.join(right, key).withColumn("similarity", score)
    best = Window.partitionBy(key).orderBy(F.col("similarity").desc(), order)
    return both.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def choose_key(exams: DataFrame, keys: DataFrame) -> DataFrame:
    """The answer block of each exam. exams: exam, title, type, shift, n_questions; keys as of ``key_blocks``."""
    target = F.array_except(T.ascii_tokens("title"), F.array(*map(F.lit, HEADER_STOP)))
    header = F.array_except(T.ascii_tokens("header"), F.array(*map(F.lit, HEADER_STOP_BLOCK)))
    named = T.header_type("header")
    blocks_ = keys.withColumn("named_type", named).withColumn("header_set", header).where(F.size("header_set") > 0).withColumnRenamed("shift", "block_shift")
    left = exams.withColumn("target_set", target)
    fits = blocks_.join(exams.select("exam", "type", "n_questions"), "exam").where((F.col("named_type").isNull() | (F.col("named_type") == F.col("type"))) & (F.size("answers") == F.col("n_questions")))
    bonus = F.when(F.col("shift") == F.col("block_shift"), 0.05).otherwise(0.0)
    return best_match(left, fits.drop("type", "n_questions"), "exam", F.col("target_set"), F.col("header_set"), "block_no", bonus).select("exam", "header", "answers", "similarity")


def records(exams: DataFrame, keys: DataFrame, invalid: list[str] | None = None, manual: DataFrame | None = None) -> DataFrame:
    """Question records with answers and flags. exams: exam (NN), slug, text; keys, manual: exam, text.

    A manual key replaces the extracted one of its exam; exams in ``invalid`` get no answers.
    """
    from lexloom.operators import quality

    if manual is not None:
        keys = keys.join(manual.withColumnRenamed("text", "manual"), "exam", "full").select("exam", F.coalesce("manual", "text").alias("text"))
    found = questions(exams)
    counted = exam_lines(exams).groupBy("exam").agg(F.count_if(F.startswith("text", F.lit("(A)"))).cast("int").alias("n_questions"))
    described = exams.select("exam", T.exam_title("slug").alias("title"), T.exam_type("text").alias("type"), T.exam_shift("slug").alias("shift")).join(counted, "exam")
    chosen = choose_key(described, key_blocks(keys)).where(~F.col("exam").isin(invalid or []))
    usual = _usual_options(found)
    out = found.join(chosen, "exam", "left").join(usual, "exam", "left")
    out = out.withColumn("answer", F.try_element_at("answers", F.col("number"))).withColumn("n_options", F.coalesce("n_options", F.lit(5)))
    return quality.flagged(out).select(
        T.question_id("exam", "number").alias("id"), "exam", "number", "section", T.without_footer(T.fold_lines("statement")).alias("statement"),
        F.transform_values("options", lambda k, v: T.without_footer(T.fold_lines(v))).alias("options"), "answer", "problems",
    )


def _usual_options(found: DataFrame) -> DataFrame:
    """The most frequent number of options of each exam; ties go to the first seen."""
    from lexloom.operators.stats import mode_first

    return mode_first(found.select("exam", F.size("options").alias("n"), "line_no"), "exam", "n", "line_no").withColumnRenamed("mode", "n_options")


def extraction_report(exams: DataFrame, keys: DataFrame, found: DataFrame) -> DataFrame:
    """Per exam: questions in the text, questions separated, the key block used and how like the title it is; ``alert`` where they differ or no key was used."""
    described = exams.select("exam", T.exam_title("slug").alias("title"), T.exam_type("text").alias("type"), T.exam_shift("slug").alias("shift"))
    counted = exam_lines(exams).groupBy("exam").agg(F.count_if(F.startswith("text", F.lit("(A)"))).cast("int").alias("n_questions"))
    chosen = choose_key(described.join(counted, "exam"), key_blocks(keys))
    got = found.groupBy("exam").agg(F.count(F.lit(1)).alias("separated"))
    out = counted.join(got, "exam", "left").join(chosen, "exam", "left").select(
        "exam", "n_questions", F.coalesce("separated", F.lit(0)).alias("separated"), "header", F.bround("similarity", 2).alias("similarity"), F.col("answers").isNotNull().alias("key_used")
    )
    return out.withColumn("alert", (F.col("n_questions") != F.col("separated")) | ~F.col("key_used"))
