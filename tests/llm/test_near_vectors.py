import numpy as np
import pytest

from millrace.llm import near_vectors
from millrace.llm.components import connected_components


def brute(rows, least=0.98):
    ids = [r[0] for r in rows]
    n = len(rows)
    units = []
    for _, e, label in rows:
        e = None if e is None or any(x is None for x in e) else np.array(e, float)
        ok = label is not None and e is not None and len(e) and np.isfinite(e).all() and (e != 0).any()
        units.append((label, e / np.linalg.norm(e)) if ok else None)
    near = np.zeros((n, n), bool)
    for label in {u[0] for u in units if u}:
        for dim in {len(u[1]) for u in units if u and u[0] == label}:
            at = [i for i, u in enumerate(units) if u and u[0] == label and len(u[1]) == dim]
            m = np.stack([units[i][1] for i in at])
            near[np.ix_(at, at)] = m @ m.T >= least
    np.fill_diagonal(near, False)
    comp = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))])
            changed |= low < comp[i]
            comp[i] = low
    return {ids[i]: (int(near[i].sum()), comp[i], comp[i] == ids[i]) for i in range(n)}


def table(spark, rows):
    return spark.createDataFrame([(i, e, l, 0) for i, e, l in rows], "vec_id long, embedding array<float>, label int, copies int")


def got(spark, rows):
    out = near_vectors.near_duplicates(table(spark, rows)).collect()
    assert len(out) == len(rows)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, base = [], rng.standard_normal((60, 16))
    for i in range(700):
        e = base[rng.integers(60)] + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.15, 0.3])
        rows.append((i, [float(x) for x in e.astype(np.float32)], int(rng.integers(3))))
    rows += [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] + [1.0] * 15, 1), (703, [float("inf")] * 16, 1), (704, [None] + [1.0] * 15, 1), (705, rows[0][1], None), (706, [], 1), (707, [1.0, 2.0], 1), (708, [2.0, 4.0], 1), (709, [2.0, 4.0], 1)]
    rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], l) for i, e, l in rows]
    assert got(spark, rows) == brute(rows)


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 64)
    rng = np.random.default_rng(2)
    hot = rng.standard_normal(8)
    rows = [(i, [float(x) for x in (hot + rng.standard_normal(8) * 0.12).astype(np.float32)], 5) for i in range(500)]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert near_vectors.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 400])
def test_components_of_paths_and_stars(spark, n):
    links = [(i, i + 1) for i in range(0, n)] + [(1000, 1000 + i) for i in range(1, n + 1)] + [(5000, 5000), (None, 3), (1001, 1000)]
    out = {r.id: r.component_id for r in connected_components(spark.createDataFrame(links, "x long, y long").repartition(7)).collect()}
    assert out == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(n + 1)}


def test_one_id_with_several_vectors(spark):
    a, b, c = [1.0, 0.0, 0.05], [1.0, 0.0, 0.0], [1.0, 0.04, 0.0]
    rows = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (3, a, "y"), (1, a, "y"), (0, a, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(table).collect())
    assert out == [(0, 0, 0, True), (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False)]
