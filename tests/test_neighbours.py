import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import neighbours as N

DENSE = "id long, v array<float>, label int"


def brute(train, test, k):
    """{id: [(distance, neighbour)]} by all distances."""
    x = np.array([np.float32(v) for _, v, _ in train], float)
    out = {}
    for i, v, _ in test:
        d = np.sqrt(((x - np.array(np.float32(v), float)) ** 2).sum(1))
        out[i] = sorted((d[j], t[0]) for j, t in enumerate(train))[:k]
    return out


@pytest.mark.parametrize("part", [4, 2048])
def test_dense_neighbours_match_all_distances(spark, monkeypatch, part):
    monkeypatch.setattr(N, "PART_ROWS", part)
    rng = np.random.default_rng(part)
    centres = rng.normal(size=(6, 5)) * 4
    train = [(i * 3 % 401, [float(c) for c in centres[i % 6] + rng.normal(size=5) * 0.6], i % 4) for i in range(160)]
    train += [(500 + i, train[7][1], 1) for i in range(80)]  # a third are one vector
    test = [(1000 + i, [float(c) for c in centres[i % 6] + rng.normal(size=5) * (0.5 if i % 3 else 4)], 0) for i in range(50)] + [(2000, train[7][1], 0), (2001, None, 0)]
    got = N.nearest(spark.createDataFrame(train + [(999, None, 1)], DENSE), spark.createDataFrame(test, DENSE), "id", "v", "label", 3).collect()
    want = brute(train, [t for t in test if t[1] is not None], 3)
    assert {(r.id, r.rank): r.neighbour for r in got} == {(i, j + 1): n for i, near in want.items() for j, (_, n) in enumerate(near)}
    labels = {t[0]: t[2] for t in train}
    assert all(r.label == labels[r.neighbour] and abs(r.distance - want[r.id][r.rank - 1][0]) < 1e-9 for r in got)


def test_balls_out_of_reach_are_not_visited(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(N, "_visits", lambda balls, asked, parts, k, real=N._visits: (seen.append(asked.count()), real(balls, asked, parts, k))[1])
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=4) * 0.1 + 50 * (i % 20)], 0) for i in range(400)]
    df = spark.createDataFrame(rows, DENSE)
    got = N.nearest(df.where("id % 5 > 0"), df.where("id % 5 = 0"), "id", "v", "label", 2).collect()
    assert len(got) == 160 and seen[0] == 80 and seen[1] < 80 * 6  # of 17 other balls
    want = brute([r for r in rows if r[0] % 5], [r for r in rows if r[0] % 5 == 0], 2)
    assert all(want[r.id][r.rank - 1][1] == r.neighbour for r in got)


def test_dense_edges(spark):
    some = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, [1.0, 0.0], 4)], DENSE)
    none = spark.createDataFrame([], DENSE)
    assert N.nearest(none, some, "id", "v", "label").count() == 0
    assert N.nearest(some, none, "id", "v", "label").count() == 0
    assert [(r.neighbour, r.rank) for r in N.nearest(some, spark.createDataFrame([(9, [0.0, 0.0], 0)], DENSE), "id", "v", "label", 5).orderBy("rank").collect()] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("probe", [1, 256])
def test_sparse_neighbours_match_all_dots(spark, monkeypatch, probe):
    monkeypatch.setattr(N, "PROBE", probe)
    rng = random.Random(probe)
    vocabulary = [f"t{i}" for i in range(120)]

    def vector():
        terms = {rng.choice(vocabulary[: rng.choice([6, 30, 120])]): rng.random() + 0.05 for _ in range(rng.randint(1, 14))}
        norm = math.sqrt(sum(w * w for w in terms.values()))
        return {t: w / norm for t, w in terms.items()}

    train = {f"d{i}": vector() for i in range(90)} | {"d95": {}, "d96": {"only": 1.0}}
    train |= {f"e{i}": train["d3"] for i in range(40)}
    test = {f"q{i}": vector() for i in range(30)} | {"q90": {}, "q91": {"unseen": 1.0}, "q92": {"only": 1.0}}
    table = lambda x: spark.createDataFrame([(i, t, w) for i, v in x.items() for t, w in v.items()], "id string, term string, weight double")
    keys = lambda x: spark.createDataFrame([(i,) for i in x], "id string")
    got = N.sparse_nearest(table(train), table(test), "id", 3, keys(train), keys(test)).collect()
    want = {}
    for q, v in test.items():
        dots = sorted((-round(math.fsum(v[t] * x[t] for t in v if t in x), 12), d) for d, x in train.items())[:3]
        want |= {(q, r + 1): d for r, (_, d) in enumerate(dots)}
    assert {(r.id, r["rank"]): r.neighbour for r in got} == want
    assert all(abs(r.distance - math.sqrt(max(0, 2 - 2 * sum(w * train[r.neighbour].get(t, 0) for t, w in test[r.id].items())))) < 1e-6 for r in got)


def test_vote_goes_to_the_smallest_label(spark):
    df = spark.createDataFrame([(1, 5), (1, 2), (2, 7), (2, 7), (2, 1)], "id long, label int")
    assert {r.id: r.predicted for r in N.vote(df, "id").collect()} == {1: 2, 2: 7} and F is not None


def test_copies_meet_once_and_chunks_lose_no_neighbour(spark, monkeypatch):
    for name, value in (("CHUNK_TRAIN", 20), ("CHUNK_TEST", 9), ("CHUNK_POSTINGS", 150), ("SLICE_SUMS", 40), ("DENSE_TERMS", 3)):
        monkeypatch.setattr(N, name, value)
    rng = random.Random(5)
    met = []
    monkeypatch.setattr(N, "_classes", lambda v, k, real=N._classes: (lambda out: (met.append(out[0].count()), out)[1])(real(v, k)))

    def vector():
        terms = {f"t{min(int(rng.expovariate(0.15)), 60)}": rng.random() + 0.05 for _ in range(rng.randint(1, 12))}
        norm = math.sqrt(sum(w * w for w in terms.values()))
        return {t: w / norm for t, w in terms.items()}

    base = [vector() for _ in range(60)]
    train = {i: base[i % 60 if i < 60 else 4] for i in range(160)}  # 101 rows are one vector
    test = {1000 + i: vector() if i < 30 else base[4] for i in range(60)}
    table = lambda x: spark.createDataFrame([(i, t, w) for i, v in x.items() for t, w in v.items()], "id long, term string, weight double")
    got = {(r.id, r["rank"]): r.neighbour for r in N.sparse_nearest(table(train), table(test), "id", 3).collect()}
    want = {}
    for q, v in test.items():
        dots = sorted((-round(math.fsum(v[t] * x[t] for t in v if t in x), 12), d) for d, x in train.items())[:3]
        want |= {(q, r + 1): d for r, (_, d) in enumerate(dots)}
    assert got == want and met[0] <= 60 and met[1] <= 31
