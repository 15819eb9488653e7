import math

import numpy as np
import pytest

from lexloom.llm import queries, whitening
from lexloom.llm.whitening import fit_basis, whiten

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=16):
    """(rows, n, whitened, deviation, explained) by a dense eigendecomposition."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in good])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    dev = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(v, s)) for v in x]
    return [i for i, _ in good], n, (x - s / n) @ vectors / np.sqrt(values), dev, values / np.trace(centred.T @ centred / n)


def test_query_matches_brute_force(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24)) * np.linspace(2, 0.2, 24)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # one vector holds a third of the rows
    rows += [(5, rows[9][1]), (None, rows[4][1]), (200, None), (201, []), (202, [None] * 24), (203, [math.nan] * 24), (204, [math.inf] + [0.0] * 23)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS component", "1 AS x", "2 AS n")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_whitening(spark, str(tmp_path)).collect()
    ids, n, white, dev, explained = brute(rows)
    assert len(got) == len(ids) * 16 and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 17))
    assert sorted((r.vec_id is None, r.vec_id, r.deviation) for r in got if r.component == 1) == sorted((i is None, i, d) for i, d in zip(ids, dev))
    assert max(r.identity_error for r in got) < 1e-9
    for c in range(1, 17):
        mine = sorted((r.deviation, r.whitened) for r in got if r.component == c)
        want = sorted(zip(dev, white[:, c - 1]))
        sign = np.sign(sum(a[1] * b[1] for a, b in zip(mine, want)))
        assert max(abs(a[1] * sign - b[1]) for a, b in zip(mine, want)) < 1e-9
        assert all(abs(r.explained - explained[c - 1]) < 1e-12 for r in got if r.component == c)


def test_flat_spectra_wider_than_the_block_converge_in_few_passes(spark):
    x = np.random.default_rng(0).integers(-60, 60, (1500, 120))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(4).cache()
    basis = fit_basis(df, 120, 6)
    c = x - x.mean(0)
    assert 2 < basis.passes < 120
    assert np.abs(np.linalg.eigvalsh(c.T @ c / 1500)[::-1][:6] - basis.values).max() < 1e-8
    assert np.abs(basis.vectors.T @ basis.vectors - np.eye(6)).max() < 1e-12
    with pytest.raises(RuntimeError):
        fit_basis(df, 120, 6, most=2)


def test_defined_cases(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert whiten(none).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten(none).count() == 0
    one = [(1, [1.0, 2.0])]
    assert whiten(spark.createDataFrame(one, SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame(one * 5, SCHEMA)).count() == 0
    # two dimensions, one of them constant: one component; shorter vectors are left out, too great entries too
    flat = [(i, [float(i), 3.0]) for i in range(10)] + [(50, [1.0]), (51, [1e30, 1.0])]
    got = whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and {r.vec_id for r in got} == set(range(10))
    assert abs(sum(r.whitened**2 for r in got) / 10 - 1) < 1e-9 and abs(got[0].explained - 1) < 1e-12


def test_a_deviation_that_fits_no_long_is_null(spark):
    far = [(i, [float(v), 0.0]) for i, v in enumerate([0, 1, 2, 3, 2**40])]
    got = {r.vec_id: r for r in whiten(spark.createDataFrame(far, SCHEMA), k=1).collect()}
    assert got[4].deviation is None
    x = [64 * v + 1_000_000 for v in (0, 1, 2, 3, 2**40)]
    assert all(got[i].deviation in (None, (5 * x[i] - sum(x)) ** 2) for i in range(5))
    assert whitening.FITS < 2**63
