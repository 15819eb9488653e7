import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexloom.operators import stats, tfidf


@pytest.mark.parametrize("buckets", [16, 1024])
def test_quantiles_are_exact(spark, monkeypatch, buckets):
    monkeypatch.setattr(stats, "BUCKETS", buckets)
    rng = random.Random(buckets)
    rows = [("a", float(rng.randint(0, 9))) for _ in range(300)] + [("b", rng.random() * 10 ** rng.randint(-3, 6)) for _ in range(157)] + [("c", 4.0)] + [("d", 7.0)] * 50 + [(None, -float(i)) for i in range(10)]
    rows += [("e", 1e300), ("e", -1e300), ("e", 0.0), ("f", None), ("a", None)]
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r.g, r.point): r.value for r in stats.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", points).collect()}
    want = {(g, p): float(np.quantile([v for h, v in rows if h == g and v is not None], p)) for g in {g for g, v in rows if v is not None} for p in points}
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) <= 1e-9 * max(1, abs(want[x])) for x in want)


def test_describe_by_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "g string, v int")
    got = {r.g: (r.n, r.q50, r.max) for r in stats.describe_by(df, "g", "v").collect()}
    assert got == {"a": (2, 1.5, 2), "b": (0, None, None)}
    assert stats.quantiles(df.limit(0), "g", "v", [0.5]).count() == 0


def test_forms_that_are_as_frequent_go_by_first_occurrence(spark):
    rng = random.Random(1)
    rows = [(d, i, rng.choice("xyz"), rng.choice(["F", "f", "ff", "Ff", "fF", "FF", "g"])) for d in range(30) for i in range(6)]
    counts, frequency = defaultdict(Counter), Counter()
    for _, _, lemma, form in sorted(rows):
        counts[lemma][form] += 1
        frequency[lemma] += 1
    rng.shuffle(rows)
    got = {r.lemma: (r.frequency, r.forms) for r in tfidf.forms(spark.createDataFrame(rows, "doc long, i long, lemma string, form string"), ["doc", "i"]).collect()}
    assert got == {x: (frequency[x], " | ".join(f for f, _ in c.most_common(5))) for x, c in counts.items()}
