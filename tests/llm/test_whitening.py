import math
import random

import numpy as np
import pytest

from tarnflow.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x long, component string, n string"


def rows_of(vectors):
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], None, None, None, None, None) for i, v in enumerate(vectors)]


def run(spark, vectors, **settings):
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(4)
    return whitening.digest(whitening.whiten(df, **settings)).collect()


def check(got, vectors, k=4):
    """Against numpy's full decomposition: values row by row up to a component's sign."""
    sound = [(i, v) for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in sound), default=0)
    x = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (d - len(v)) for _, v in sound]
    fit = np.array(sorted({tuple(v) for v in x}))
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    m = min(k, int((values > 1e-10 * values[0]).sum())) if values[0] > 0 else 0
    assert len(got) == len(sound) * m
    by = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(m):
        want = {i: (np.array(v) - s / n) @ vecs[:, c] / math.sqrt(values[c]) for (i, _), v in zip(sound, x)}
        sign = np.sign(sum(by[i, c + 1]["whitened"] * w for i, w in want.items()))
        for (i, _), v in zip(sound, x):
            r = by[i, c + 1]
            assert r["n"] == n and r["deviation"] == sum((n * a - int(b)) ** 2 for a, b in zip(v, s))
            assert r["whitened"] * sign == pytest.approx(want[i], abs=1e-8)
            assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
            assert r["identity_error"] < 1e-9


def test_matches_full_decomposition(spark):
    rng = random.Random(1)
    vectors = [[rng.gauss(0, 1 / (1 + j)) + (j == 3) for j in range(24)] for _ in range(700)]
    vectors += [vectors[5]] * 300 + [None, [float("nan")] * 24, [None] * 24, [float("inf")] + [0.0] * 23, [], [1.0]]
    check(run(spark, vectors), vectors)
    check(run(spark, vectors, block=2), vectors)


def test_low_rank_and_equal_values(spark):
    rng = random.Random(2)
    plane = [[a, b, a + b, 0.0, 0.0] for a, b in ((rng.gauss(0, 1), rng.choice((0.5, 1.0))) for _ in range(200))]
    got = run(spark, plane)
    assert max(r["component"] for r in got) <= 4
    corners = [[s * (j == i) for j in range(6)] for i in range(6) for s in (-1.0, 1.0)]  # all eigenvalues equal
    got = run(spark, corners)
    assert len(got) == 12 * 4 and all(r["identity_error"] < 1e-9 and r["explained"] == pytest.approx(1 / 6) for r in got)


def test_defined_cases(spark):
    assert run(spark, []) == []
    assert run(spark, [None, []]) == []
    assert run(spark, [[1.0, 2.0]] * 3) == []
    line = [[0.0, 0.0], [1.0, 1.0], [1.0, 1.0], [3.0, 3.0]]
    got = run(spark, line)
    assert {r["component"] for r in got} == {1} and len(got) == 4
    check(got, line)


@pytest.mark.parametrize("spread", [1.0, 1e-3])
def test_lanczos(spread):
    """Close, equal and zero eigenvalues; breakdown in the first block."""
    rng = np.random.default_rng(4)
    d = 60
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    for values in (np.r_[[5, 5, 5, 5 - spread, 4], rng.random(d - 5)], np.r_[[3, 3], np.zeros(d - 2)], np.zeros(d), np.ones(d)):
        a = (q * values) @ q.T
        found, vectors = whitening.lanczos(lambda v: a @ v, d, 4)
        assert found == pytest.approx(np.sort(values)[::-1][:4], abs=1e-12)
        assert np.abs(a @ vectors - vectors * found).max() < 1e-12 and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_deviations_beyond_longs():
    x = np.array([[3, -2], [10**6, 5]])
    n, s = 10**10, [7, -9]
    assert [int(v) for v in whitening._deviations(x, n, s).to_pylist()] == [sum((n * int(a) - b) ** 2 for a, b in zip(r, s)) for r in x]
