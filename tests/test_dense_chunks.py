import numpy as np
import pytest
from test_neighbours import DENSE, brute

from lexloom import queries
from lexloom.operators import neighbours as N


@pytest.mark.parametrize("cells", [64, 1 << 21])
def test_even_distances_meet_by_chunks(spark, monkeypatch, cells):
    monkeypatch.setattr(N, "CHUNK_DENSE", 70)
    monkeypatch.setattr(N, "MATRIX_CELLS", cells)
    visits = []
    monkeypatch.setattr(N, "_visits", lambda *a, real=N._visits: (visits.append(a), real(*a))[1])
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24))
    train = [(i * 7 % 2003, [float(c) for c in x[i if i < 250 else 5]], i % 3) for i in range(300)]  # 50 copies of one vector
    test = [(5000 + i, [float(c) for c in x[300 + i]], 0) for i in range(90)] + [(6000, train[5][1], 0), (6001, None, 0)]
    got = N.nearest(spark.createDataFrame(train, DENSE), spark.createDataFrame(test, DENSE), "id", "v", "label", 3).collect()
    want = brute(train, [t for t in test if t[1] is not None], 3)
    assert {(r.id, r.rank): r.neighbour for r in got} == {(i, j + 1): n for i, near in want.items() for j, (_, n) in enumerate(near)}
    assert all(abs(r.distance - want[r.id][r.rank - 1][0]) < 1e-9 for r in got)
    assert len(visits) == 1  # own balls alone


def test_products_turn_down_no_neighbour():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(50, 8)) * 1e-7 + 1000, np.full((5, 8), 1000.0)])
    near = rng.permutation(55)
    for v in (x[:20], rng.normal(size=(3, 8)), np.array([[np.nan] * 8, [1000.0] * 8])):
        d = N._distances(v, x)
        order = np.lexsort((np.broadcast_to(near, d.shape), d), axis=1)[:, :4]
        r, c, e = (np.concatenate(p) for p in zip(*N._nearest_rows(v, x, near, 4)))
        assert c.reshape(-1, 4).tolist() == order.tolist()
        assert np.array_equal(e.reshape(-1, 4), np.take_along_axis(d, order, 1), equal_nan=True)


def test_both_models_share_one_split(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "_split", lambda *a, real=queries._split: (seen.append(a), real(*a))[1])
    assert queries.errors_all_models(spark, "/root/testdata/sf0.001").columns == ["vec_id", "predicted", "truth", "logreg"] and len(seen) == 1
