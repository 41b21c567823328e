import numpy as np
from llm.test_simhash import slow_components

from lakejobs.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, weight string, cell string, at string, rep string"


def vectors(rows, spark):
    return spark.createDataFrame([(i, e, label, "x", "x", "x", "x") for i, e, label in rows], SCHEMA)


def expected(rows):
    unit = {}
    for k, (_, e, label) in enumerate(rows):
        if e and label is not None and None not in e:
            v = np.array(e, np.float32).astype(float)
            if np.isfinite(v).all() and v.any():
                v = v / np.abs(v).max()
                unit[k] = (label, v / np.linalg.norm(v))
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.98]
    roots = slow_components(range(len(rows)), links)
    out = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in roots if roots[j] == roots[k] and rows[j][0] is not None]
        low = min(ids) if ids and i is not None or len(ids) else None
        out.append((i, sum(k in pair for pair in links), low, i == low))
    return sorted(out, key=str)


def make(n, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = []
    for k in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice(spread)
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "ENTRIES_PER_PIVOT", 20)
    monkeypatch.setattr(embeddings, "LEAST_UNIT", 30)
    rows = make(700, [0.02, 0.1, 0.15, 0.2, 1.0], 1)
    one = rows[0][1]
    rows += [(1000 + k, one, rows[0][2]) for k in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan"), *one[1:]], 1), (2003, [float("inf"), *one[1:]], 1), (2004, one, None)]
    rows += [(2005, [None, *one[1:]], 1), (2006, [], 1), (2007, one[:8], rows[0][2]), (2008, [x * 1e-30 for x in one], rows[0][2]), (5, rows[5][1], rows[5][2])]
    got = embeddings.op9_embedding_range_join(vectors(rows, spark)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_doubles_are_not_rounded(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "ENTRIES_PER_PIVOT", 4)
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=4)], 1) for k in range(60)]
    # As floats these are zero, infinite, or a little below the bound.
    rows += [(100, [1e-300, 0.0, 0.0, 0.0], 2), (101, [1e300, 0.0, 0.0, 0.0], 2)]
    near = [0.98 + 1e-12, float(np.sqrt(1 - (0.98 + 1e-12) ** 2)), 0.0, 0.0]
    rows += [(102, [1.0, 0.0, 0.0, 0.0], 3), (103, near, 3), (104, [0.98 - 1e-9, float(np.sqrt(1 - (0.98 - 1e-9) ** 2)), 0.0, 0.0], 4), (105, [1.0, 0.0, 0.0, 0.0], 4)]
    unit = {k: np.array(e) / np.abs(e).max() for k, e, _ in rows}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    label = {k: x for k, _, x in rows}
    want = {k: sum(label[j] == label[k] and j != k and unit[j] @ unit[k] >= 0.98 for j in unit) for k in unit}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.op9_embedding_range_join(df).collect()}
    assert got == want
    assert [want[k] for k in range(100, 106)] == [1, 1, 1, 1, 0, 0]


def test_no_rows(spark):
    assert embeddings.op9_embedding_range_join(vectors([], spark)).collect() == []


def test_copies_reach_every_cell_they_must():
    rng = np.random.default_rng(3)
    points = embeddings.matrix(__import__("pyarrow").array([list(r) for r in rng.normal(size=(400, 3))]))
    pivots, reach = points[::25], float(np.sqrt(2 - 2 * 0.98))
    cells = [set() for _ in points]
    home = np.zeros(len(points), int)
    for i, cell, own in embeddings.cells_of(points, pivots, reach):
        for a, b, c in zip(i, cell, own):
            cells[a].add(b)
            if c:
                home[a] = b
    for a, b in np.argwhere(points @ points.T >= 0.98):
        assert home[a] in cells[b]
    assert sum(map(len, cells)) < len(points) * len(pivots) / 2


def met(spark, rows, monkeypatch):
    """The result, and how many rows went into each step that compares or deals out vectors."""
    df = vectors(rows, spark)
    steps, plain = [], type(df).mapInArrow
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, *a, **b: (steps.append(self), plain(self, *a, **b))[1])
        got = sorted((tuple(r) for r in embeddings.op9_embedding_range_join(df).collect()), key=str)
    return got, {tuple(s.columns): s.count() for s in steps}, steps


def test_vectors_that_pivots_do_not_part_are_copied_little(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "ENTRIES_PER_PIVOT", 20)
    monkeypatch.setattr(embeddings, "LEAST_UNIT", 30)
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.normal(size=64).astype(np.float32)], k % 2) for k in range(800)]
    rows += [(1000 + k, [float(np.float32(x + d)) for x, d in zip(rows[k][1], rng.normal(size=64) * 0.1)], k % 2) for k in range(0, 800, 5)]
    got, counts, _ = met(spark, rows, monkeypatch)
    assert got == expected(rows)
    assert max(counts.values()) <= 2.5 * len(rows)


def test_every_two_pieces_meet_once(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAST_UNIT", 20)
    rows = make(500, [0.02, 0.1, 0.15, 0.2, 1.0], 4)
    rows += [(1000 + k, rows[k % 7][1], rows[k % 7][2]) for k in range(40)] + [(None, rows[9][1], rows[9][2]), (None, rows[50][1], rows[50][2])]
    want = expected(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for most in (4000, 2200, 1300):
            monkeypatch.setattr(embeddings, "PIECE_BYTES", most)
            got, _, steps = met(spark, rows, monkeypatch)
            assert got == want
            pieces = steps[-1].select("unit").distinct().count()
            assert pieces >= 10_000 // most
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_vectors_in_clusters_are_parted_into_cells(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "ENTRIES_PER_PIVOT", 6)
    monkeypatch.setattr(embeddings, "LEAST_UNIT", 50)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 16))
    rows = [(k, [float(x) for x in (centres[k % 8] + rng.normal(size=16) * rng.choice([0.03, 0.1])).astype(np.float32)], 1) for k in range(600)]
    got, counts, steps = met(spark, rows, monkeypatch)
    assert got == expected(rows)
    assert steps[-1].select("cell").distinct().count() > 3
    assert max(counts.values()) <= 2.5 * len(rows)


def test_pairs_of_blocks(monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", (16, 32))
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 48))
    a, b = (np.where(rng.random((n, 1)) < 0.3, centres[rng.integers(6, size=n)] + rng.normal(size=(n, 48)) * 0.12, rng.normal(size=(n, 48))) for n in (150, 90))
    # Some are nearer to the bound than single precision tells.
    at = rng.normal(size=(40, 48))
    at -= (at @ a[0])[:, None] * a[0] / (a[0] @ a[0])
    at /= np.linalg.norm(at, axis=1)[:, None]
    cos = 0.98 + np.linspace(-1e-7, 1e-7, 40)[:, None]
    b = np.concatenate([b, cos * a[0] / np.linalg.norm(a[0]) + np.sqrt(1 - cos**2) * at])
    for least in (32, 1000):
        monkeypatch.setattr(embeddings, "LEAST_HEADED", least)
        for x, y, same in ((a, b, False), (a, a, True), (b, b, True)):
            found = [(i.start + p, j.start + q) for i, j, ps, qs in embeddings.near_pairs(x, y, 0.98, same) for p, q in zip(ps.tolist(), qs.tolist())]
            near = embeddings.unit(x) @ embeddings.unit(y).T >= 0.98
            want = np.argwhere(np.triu(near, 1) if same else near).tolist()
            assert sorted(found) == sorted(map(tuple, want))
            assert len(found) > 20
