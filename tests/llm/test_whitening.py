"""Whitening against a plain eigendecomposition of the exact covariance, and the rank-one updates themselves."""

import math

import numpy as np

from lakejobs.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, dims string, at string, n string, `my col` string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", "x", "x", "x", "x") for i, e in rows], SCHEMA)


def expected(rows, components=4):
    """By row: (vec_id, component, n, deviation, explained) and the whitened value, whose sign is open."""
    good = []
    for i, e in rows:
        if e is not None and all(c is not None and math.isfinite(c) for c in e):
            good.append((i, tuple(math.floor(256 * float(np.float32(c))) for c in e)))
    out = []
    for dims in {len(x) for _, x in good} - {0}:
        fit = sorted({x for _, x in good if len(x) == dims})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        apart = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
        values, basis = np.linalg.eigh(apart.T @ apart / n)
        values, basis = values[::-1], basis[:, ::-1]
        kept = [k for k in range(min(components, dims)) if values[k] > 1e-12 * values.sum()]
        for i, x in good:
            if len(x) == dims:
                exact = [n * c - s for c, s in zip(x, sums)]
                deviation = sum(v * v for v in exact)
                own = np.array([v / n for v in exact]) @ basis[:, kept] / np.sqrt(values[kept])
                out += [(i, k + 1, n, deviation if deviation < 1 << 63 else None, values[k] / values.sum(), own[j]) for j, k in enumerate(kept)]
    return out


def check(got, want):
    key = lambda r: (str(r[0]), r[1], r[2], str(r[3]), abs(r[5]))
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, r.explained, r.whitened) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for column in (4, 5):
        a, b = (np.abs([r[column] for r in rows]) for rows in (got, want))
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-10)


def signs_agree(got, want):
    """One sign for all rows of a component and length."""
    ours = {}
    for r in got:
        ours.setdefault((r.vec_id, r.component, r.n, r.deviation), []).append(r.whitened)
    signs = {}
    for i, component, n, deviation, _, value in want:
        found = ours[i, component, n, deviation]
        if len(found) == 1 and abs(value) > 1e-6:
            signs.setdefault((n, component), set()).add(np.sign(found[0] / value))
    assert signs and all(len(s) == 1 for s in signs.values())


def make(n, dims, seed):
    rng = np.random.default_rng(seed)
    shape = rng.normal(size=(dims, dims)) * np.geomspace(1, 0.1, dims)[:, None]
    return [(k, [float(c) for c in (rng.normal(size=dims) @ shape).astype(np.float32)]) for k in range(n)]


def test_against_plain_decomposition(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TASK_VECTORS", 40)
    rows = make(700, 16, 1)
    one = rows[0][1]
    rows += [(1000 + k, one) for k in range(300)]
    rows += [(2000, None), (2001, [float("nan"), *one[1:]]), (2002, [None, *one[1:]]), (2003, [float("-inf"), *one[1:]]), (2004, []), (None, one), (5, rows[5][1])]
    rows += [(2005, [0.0] * 16), (2006, [-0.0] * 16)]
    rows += [(3000 + i, e) for i, e in make(60, 3, 2)] + [(4000, [1.0] * 5)]
    got = whitening.op11_whitening(vectors(spark, rows).repartition(5)).collect()
    want = expected(rows)
    check(got, want)
    signs_agree(got, want)
    assert {r.component for r in got if r.n > 60} == {1, 2, 3, 4} and max(r.identity_error for r in got) < 1e-9


def test_few_directions(spark):
    rng = np.random.default_rng(3)
    basis = rng.integers(-4, 5, size=(2, 10))
    rows = [(k, [float(v) for v in (rng.integers(-9, 9, size=2) @ basis)]) for k in range(200)]
    got = whitening.op11_whitening(vectors(spark, rows)).collect()
    check(got, expected(rows))
    assert {r.component for r in got} == {1, 2}


def test_large_entries(spark):
    rows = [(k, [float(np.float32((-1) ** k * 10.0 ** (8 + k % 3) + k)), float(k), float(k % 7) ** 2]) for k in range(50)]
    check(whitening.whiten(vectors(spark, rows), 1).collect(), expected(rows, 1))
    far = [(0, [3e38, 1.0]), (1, [1.0, 2.0]), (2, [-3e38, 1.0])]
    assert {r.deviation for r in whitening.op11_whitening(vectors(spark, far)).collect()} == {None, 525313}


def test_nothing_to_fit(spark):
    assert whitening.op11_whitening(vectors(spark, [])).collect() == []
    assert whitening.op11_whitening(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).collect() == []


def test_rank_one_updates():
    rng = np.random.default_rng(5)
    for k in (1, 2, 7, 64):
        for spread in (0, 3, 9):
            d = np.sort(10.0 ** rng.uniform(-spread, spread, k))
            z = rng.normal(size=k) * 10.0 ** rng.uniform(-spread, 0, k)
            z /= np.linalg.norm(z)
            found = whitening.Spectrum(2, np.zeros(k), d, np.eye(k))
            found.update(z, 2.0)
            values, basis = found.values, found.vectors
            whole = np.diag(d) + 2.0 * np.outer(z, z)
            most = np.linalg.norm(whole, 2)
            assert np.abs(basis.T @ basis - np.eye(k)).max() < 1e-13
            assert np.abs(whole @ basis - basis * values).max() < 1e-13 * most


def test_spectra_combine():
    rng = np.random.default_rng(6)
    points = np.vstack((rng.normal(size=(300, 12)) * np.geomspace(1e3, 1e-3, 12), np.eye(12) * 5, np.zeros((5, 12)), np.ones((40, 12))))
    whole = whitening.Spectrum.empty(12)
    for part in np.array_split(points, 6):
        own = whitening.Spectrum.empty(12)
        for x in part:
            own.add(x)
        whole.merge(own)
    apart = points - points.mean(axis=0)
    scatter = apart.T @ apart
    assert whole.n == len(points)
    np.testing.assert_allclose(whole.mean, points.mean(axis=0), atol=1e-11)
    assert np.abs((whole.vectors * whole.values) @ whole.vectors.T - scatter).max() < 1e-12 * np.linalg.norm(scatter, 2)
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(12)).max() < 1e-12
