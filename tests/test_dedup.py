import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexloom.operators import dedup, sequence


def edited(text, times, rng, alphabet):
    out = list(text)
    for _ in range(times):
        i, what = rng.randrange(len(out) + 1), rng.random()
        if what < 0.4 and i < len(out):
            del out[i]
        elif what < 0.8:
            out.insert(i, rng.choice(alphabet))
        else:
            j = rng.randrange(len(out) + 1)
            out[j:j] = out[i : i + rng.randint(1, 15)]
    return "".join(out)


@pytest.mark.parametrize("small", [0, 400, sequence.SMALL])
def test_the_ratio_is_that_of_the_standard_library(monkeypatch, small):
    monkeypatch.setattr(sequence, "SMALL", small)
    rng = random.Random(2)
    for _ in range(300):
        alphabet = rng.choice(["ab", "abcd", "abcdefghijklmnop", "é𝔘x"])
        a = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 30, 120, 300])))
        b = edited(a, rng.randint(0, max(1, len(a) // 6)), rng, alphabet) if rng.random() < 0.8 else "".join(rng.choice(alphabet) for _ in range(len(a)))
        want = SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert sequence.ratio(a, b) == want
        for least in (0.6, 0.9, 1.0):
            assert sequence.ratio(a, b, least) == (want if want >= least else None)


def test_hashes_that_mislead_change_nothing(monkeypatch):
    monkeypatch.setattr(sequence, "SMALL", 0)
    monkeypatch.setattr(sequence, "_BASE", sequence.np.uint64(2))  # grams of more than 64 characters lose their ends
    rng = random.Random(3)
    for _ in range(40):
        a = "".join(rng.choice("abc") for _ in range(200))
        b = edited(a, 12, rng, "abc")
        assert sequence.ratio(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio()


def records(n, rng):
    """(position, statement, options): families of near copies, texts that share only a key, copies, empty ones."""
    words = ["rede", "banco", "dados", "chave", "teste", "valor", "linha", "campo", "senha", "porta"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    heads, tails = [text(8) for _ in range(4)], [text(10) for _ in range(5)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.55:
            _, s, o = rng.choice(rows)
            s = s[:20] + edited(s[20:], rng.choice([0, 1, 3, 8, 14]), rng, "abcdrs ") if rng.random() < 0.8 else text(12)
            o = edited(o, rng.choice([0, 0, 0, 2]), rng, "abc ")
        else:
            s, o = rng.choice(heads) + " " + text(rng.choice([4, 14, 30])), rng.choice([*tails, "", text(9)])
        rows.append((i * 7 % 1009, s, o))
    return rows + [(2000 + i, "", "") for i in range(3)]


def squash(t):
    return "".join(c for c in t if c.isalnum())


def greedy(rows, prefix):
    """The greedy pass over rows in order: (position, leader), and all pairs above the ratio that share a key."""
    kept, led, pairs = {}, {}, set()
    every = []
    for p, s, o in sorted(rows):
        whole, keys = squash(s + " " + o), [("e", squash(s)[:prefix]), ("a", squash(o))]
        ratio = lambda other, whole=whole: SequenceMatcher(None, whole, other, autojunk=False).ratio()
        for q, other, others in every:
            if set(keys) & set(others) and ratio(other) >= 0.9:
                pairs.add((p, q))
        every.append((p, whole, keys))
        leader = next((q for k in keys for q, other in kept.get(k, []) if ratio(other) >= 0.9), None)
        if leader is None:
            for k in keys:
                kept.setdefault(k, []).append((p, whole))
        else:
            led[p] = leader
    return led, pairs


def keyed(spark, rows, prefix=12):
    df = spark.createDataFrame(rows, "position long, s string, o string")
    return dedup.block_keys(df, F.col("s"), F.col("o"), prefix=prefix)


@pytest.mark.parametrize("wide", [dedup.WIDE, 2])
def test_pairs_and_leaders_match_the_greedy_pass(spark, monkeypatch, wide):
    monkeypatch.setattr(dedup, "WIDE", wide)
    monkeypatch.setattr(dedup, "CHUNK_TEXTS", 5)
    rows = records(80, random.Random(wide))
    led, pairs = greedy(rows, 12)
    df = keyed(spark, rows)
    got = dedup.similar_pairs(df, "position").collect()
    texts = {p: squash(s + " " + o) for p, s, o in rows}
    first = {}
    for p in sorted(texts):
        first.setdefault(texts[p], p)
    assert {(r.new, r.old) for r in got if r.kind != "="} == {(p, q) for p, q in pairs if texts[p] != texts[q] and p == first[texts[p]] and q == first[texts[q]]}
    assert all(abs(r.ratio - SequenceMatcher(None, texts[r.new], texts[r.old], autojunk=False).ratio()) < 1e-12 for r in got)
    assert {(r.new, r.old) for r in got if r.kind == "="} == {(p, first[t]) for p, t in texts.items() if p != first[t]}
    assert {r.position: r.leader for r in dedup.greedy_leaders(df, "position").collect()} == led
    assert {r.position: r.leader for r in dedup.leaders(dedup.similar_pairs(df, "position")).collect()} == led


def plain_states(pairs):
    state = {}
    for p in sorted({x for pair in pairs for x in pair}):
        state[p] = not any(state[o] for n, o in pairs if n == p)
    return state


def test_a_chain_of_500_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(dedup, "kept", lambda df, label="kept", real=dedup.kept: (rounds.append(label), real(df, label))[1])
    pairs = [(i + 1, i) for i in range(500)] + [(1000 + i, 1000 + j) for i in range(12) for j in range(i) if (i * j) % 3]
    got = {r.p: r.leads for r in dedup.first_independent(spark.createDataFrame(pairs, "new long, old long")).collect()}
    assert got == plain_states(pairs)
    assert rounds.count("rules") <= 10 and rounds.count("doubled") <= 30


def test_random_graphs(spark):
    rng = random.Random(8)
    pairs = {(g * 100 + b, g * 100 + a) for g in range(6) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.12}
    got = {r.p: r.leads for r in dedup.first_independent(spark.createDataFrame(sorted(pairs), "new long, old long")).collect()}
    assert got == plain_states(pairs)


def test_empty_tables(spark):
    assert dedup.greedy_leaders(keyed(spark, []), "position").count() == 0
    assert dedup.first_independent(spark.createDataFrame([], "new long, old long")).count() == 0


def test_queries_against_the_greedy_pass(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.s) for r in dedup.block_keys(spark.read.parquet(f"{d}/documents.parquet").fillna("", "text"), F.col("text")).select("doc_id", F.col("squashed").alias("s")).collect()]
    led, kept = {}, {}
    for p, s in sorted(rows):
        leader = next((q for q, t in kept.get(s[:150], []) if s == t or (min(len(s), len(t)) * 2 >= 0.9 * (len(s) + len(t)) and sequence.ratio(s, t, 0.9) is not None)), None)
        if leader is None:
            kept.setdefault(s[:150], []).append((p, s))
        else:
            led[p] = leader
    assert {r.position: r.leader for r in entry.queries()["dedup_leaders"](spark, d).collect()} == led and led


@pytest.mark.parametrize("least", [0.6, 0.9])
def test_the_sieve_loses_no_pair_and_turns_down_most(least):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = ["", "a", "ab" * 400]
    for _ in range(40):
        base = "".join(rng.choice(words) for _ in range(rng.choice([1, 20, 80])))
        texts += [base] + [edited(base, rng.randint(0, max(1, len(base) // 8)), rng, "abcé") for _ in range(2)]
    sieve, met, alike = sequence.Sieve(least), set(), set()
    for i, t in enumerate(texts):
        counts = sieve.counts(t)
        met |= {(i, int(j)) for j in sieve.passed(counts)}
        sieve.add(counts)
        alike |= {(i, j) for j in range(i) if sequence.ratio(t, texts[j], least) is not None}
    assert alike <= met and len(alike) > 20
    assert least < 0.9 or len(met) < len(alike) + 0.2 * len(texts) ** 2 / 2


def test_only_grams_whose_first_bits_occur_are_searched_for(monkeypatch):
    looked, real = [], np.searchsorted
    monkeypatch.setattr(sequence.np, "searchsorted", lambda known, some: (looked.append(len(some)), real(known, some))[1])
    r = random.Random(3)
    a, b = ("".join(r.choices("abcdefgh", k=3000)) for _ in range(2))
    grams = sequence._Grams(sequence._points(a), sequence._points(b + a[500:540]))
    for length in (3, 8, 40, 41):
        found = grams.shared(0, len(a), 0, len(b) + 40, length)[0]
        held = {(b + a[500:540])[i : i + length] for i in range(len(b) + 41 - length)}
        assert found.tolist() == [a[i : i + length] in held for i in range(len(a) - length + 1)]
    assert looked[2] < len(a) / 2  # one gram of 40 is shared, and some first bits by chance
