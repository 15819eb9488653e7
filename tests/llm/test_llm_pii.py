import hashlib
import itertools
import math
import random
import re
import time

import pytest

from lexloom.llm import pii as P
from lexloom.llm import queries


def plain_base(text):
    """The base patterns as they are written, with the checks after."""
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def checked(s):
        d = digits(s)[::-1]
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", checked),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(k, *m.span()) for k, r, ok in rules for m in re.finditer(r, text) if ok(m[0])]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(1)
    for alphabet in ("a1@.-", "0123456789 -", "+0 ().-19", "ab@.c@_%", "12.é ", "4 \n+(2)a@b.c"):
        for _ in range(2_000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert P.base_spans(text) == plain_base(text), text
    for kind in P.KINDS:
        for _ in range(200):
            text = f"é {P.drawn(kind, rng)} {P.drawn(rng.choice(P.KINDS), rng)}, x"
            assert P.base_spans(text) == plain_base(text)


def segmentations(lat, i=0):
    """Every list of (first atom, label, feature names) that covers the atoms."""
    n = len(lat.cuts) - 1
    if i == n:
        yield []
        return
    for rest in segmentations(lat, i + 1):
        yield [(i, i + 1, P.OUT, [lat.outside[i]])] + rest
    for j in range(i + 1, n + 1):
        for first, k, names in lat.ends[j]:
            if first == i:
                for rest in segmentations(lat, j):
                    yield [(i, j, k, names)] + rest


@pytest.fixture(scope="module")
def field():
    f = P.Field()
    f.train(P.examples([]))
    return f


def test_dynamic_programmes_match_enumeration(field):
    for text in ("+1 (222) 333-4444 1.2.3.4", "al@ex.org 5500 0000 0000 0004", "tel 212-555-0199 or x[at]y.de"):
        for region in P.regions(text):
            lat = P.Lattice(text, region, [])
            every = list(segmentations(lat))
            assert 1 < len(every) < 200_000

            def score(seg, w):
                total, before = 0.0, P.OUT
                for _, _, k, names in seg:
                    total += w.get(f"{before}>{k}", 0.0) + sum(w.get(f, 0.0) for f in names)
                    before = k
                return total

            values = [score(s, field.weights) for s in every]
            found = {(k, i, j) for k, i, j in field.best(lat)}
            best = max(zip(values, range(len(every))))[1]
            assert found == {(k, i, j) for i, j, k, _ in every[best] if k != P.OUT}
            gold = [(k, i, j) for i, j, k, _ in every[len(every) // 2] if k != P.OUT]
            norm = math.log(sum(math.exp(v - max(values)) for v in values)) + max(values)
            value, grad = field.gradient(lat, gold)
            assert abs(value - (values[len(every) // 2] - norm)) < 1e-9
            for f in itertools.islice(grad, 0, None, 7):
                moved = P.Field(dict(field.weights))
                moved.weights[f] = moved.weights.get(f, 0.0) + 1e-5
                assert abs((moved.gradient(lat, gold)[0] - value) / 1e-5 - grad[f]) < 1e-3


def test_held_out_spans_are_found_and_decoys_left(field):
    hit = wrong = total = 0
    for text, spans in P.examples([], seed=99, each=100):
        base = P.base_spans(text)
        got = set(base) | set(field.added(text, base))
        hit += len(got & set(spans))
        wrong += len(got - set(spans) - set(base))
        total += len(spans)
    assert hit >= 0.95 * total and wrong <= 0.03 * total


def test_added_spans_overlap_nothing(field):
    rng = random.Random(4)
    for text, _ in P.examples([], seed=5, each=60):
        base = P.base_spans(text)
        closed = sorted((s, e) for _, s, e in base)
        for k, s, e in field.added(text, base):
            assert not any(a < e and s < b for a, b in closed)
    assert field.added("", []) == [] and rng


DOCS = [
    (1, "Write to jo.doe@mail.example.com, or +1 (826) 555-4081 190.137.223.204."),
    (2, "Ref 6625883203433323, v1.2.3, from 2019-2020 on; 12.11.2020 at noon; 300.1.2.3"),
    (3, None), (4, ""), (5, "é" * 10 + " 10.0.0.1 " + "z" * 3_000 + " a@b.co"), (5, "é" * 10 + " 10.0.0.1"), (None, "card 4929 3483 8514 6306"),
    (6, "mail bob (at) example (dot) com"), (7, "4845168114407329 4845168114407329"),
]


def test_query_against_the_plain_patterns(spark, tmp_path):
    spark.createDataFrame(DOCS * 3, "doc_id long, text string").selectExpr("*", "1 AS n_email", "'x' AS spans").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op11_pii(spark, str(tmp_path)).collect()
    assert len(rows) == 3 * len(DOCS)
    want = []
    for doc_id, text in DOCS * 3:
        base = plain_base(text or "")
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        want.append((str(doc_id), *(sum(b[0] == k for b in base) for k in P.KINDS), hashlib.sha256(listed.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == sorted(want)
    spans = {r.doc_id: r.spans for r in rows}
    assert spans[1] == "email:9:32,ip:55:70,phone:37:54"
    assert spans[2] == spans[3] == spans[4] == ""
    assert spans[6] == "email:5:31" and spans[7] == "card:0:16,card:17:33"
    listed = P.find_pii(spark.createDataFrame(DOCS, "doc_id long, text string"), P.Field()).where("base").count()
    assert listed == sum(len(plain_base(t or "")) for _, t in DOCS)


def test_empty_table(spark):
    assert P.pii_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_take_time_in_proportion(field):
    for unit in ("1", "a", "1.", "a@", "+1 ", "12 ", "4-", "a.b@c.d ", "at dot "):
        text = unit * (100_000 // len(unit))
        began = time.process_time()
        base = P.base_spans(text)
        field.added(text, base)
        assert time.process_time() - began < 20, unit
