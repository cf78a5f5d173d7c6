import numpy as np
import pytest

from epitide.llm.vptree import Router, Tree, distance, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, cid long, shard int, size int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA)


def expected(rows, k=5, every=50):
    """The k nearest of every query by all cosines, as {(query row, rank): (id, score)}; rows as (id, vector)."""
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
          if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, (i, v) in enumerate(ok):
        if i is None or i % every:
            continue
        near = [(-v @ w / np.sqrt((v @ v) * (w @ w)), j is None, j or 0) for r, (j, w) in enumerate(ok) if r != q and len(w) == len(v)]
        out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(sorted(near)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)


def same(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=0, atol=1e-12)


def clustered(rng, n, d, groups=20, noise=0.3):
    centres = rng.normal(size=(groups, d))
    return (centres[rng.integers(groups, size=n)] + noise * rng.normal(size=(n, d))).astype(np.float32)


@pytest.mark.parametrize("d, noise", [(3, 0.3), (16, 0.2), (40, 5.0)])
def test_factor_one_is_exact(spark, d, noise):
    rng = np.random.default_rng(d)
    rows = [(int(i), v.tolist()) for i, v in enumerate(clustered(rng, 1500, d, noise=noise))]
    same(found(nearest(table(spark, rows), every=25, factor=1.0, shard_rows=100)), expected(rows, every=25))


def test_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    base = clustered(rng, 300, 8)
    vectors = [v.tolist() for v in base] + [base[0].tolist()] * 400 + [(base[1] * 2).tolist()] * 3 + [base[2].tolist()] * 4
    rows = [(7 * i % 997, v) for i, v in enumerate(vectors)]
    same(found(nearest(table(spark, rows), every=10, factor=1.0, shard_rows=64)), expected(rows, every=10))


def test_recall_with_the_fitted_factor(spark):
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(6000, 24)).astype(np.float32)
    for name, vectors in (("uniform", unit), ("clusters", clustered(rng, 6000, 24))):
        rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
        got, want = found(nearest(table(spark, rows), shard_rows=500)), expected(rows)
        assert len(got) == len(want)
        recall = len({x[:1] + x[2:3] for x in got} & {x[:1] + x[2:3] for x in want}) / len(want)
        assert recall >= 0.93, name


def test_factor_prunes(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 4000, 12).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree, order = Tree.build(x)
    assert np.array_equal(tree.points, x[order])
    work = []
    for factor in (1.0, 2.0, 8.0):
        got, cosines, compared = tree.search(x[:200], 5, factor)
        work.append(compared)
        if factor == 1.0:
            assert np.allclose(np.sort(cosines, axis=1), np.sort(x[:200] @ x.T, axis=1)[:, -5:])
    assert work[0] < 200 * 4000 and work[0] > work[1] > work[2]


def test_router_bounds_hold_outside_the_sample():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    router = Router.fit(x[:500], 16, 6, 0.98)
    rows, home = router.shards(x)
    assert sorted(rows) == list(range(3000)) and len(set(home)) == 16
    shard = np.empty(3000, int)
    shard[rows] = home
    q = x[:50]
    reach = np.sort(distance(q @ x.T), axis=1)[:, 10]
    of, visited = router.shards(q, reach, 1.0)
    seen = set(zip(of.tolist(), visited.tolist()))
    for i in range(50):
        assert all((i, shard[j]) in seen for j in np.flatnonzero(distance(q[i] @ x.T) <= reach[i]))
    assert len(seen) < 50 * 16


def test_edge_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (50, v), (None, v), (1, None), (100, [0.0] * 3), (2, [1.0, None, 3.0]), (150, [1.0, float("nan"), 3.0]),
            (3, [float("inf"), 0.0, 0.0]), (200, [1.0, 1.0]), (250, []), (300, [4.0]), (4, [-2.0]), (-50, [3.0, 2.0, 1.0]), (5, [2.0, 4.0, 6.0]), (0, v)]
    same(found(nearest(table(spark, rows))), expected(rows))
    assert nearest(table(spark, [])).count() == 0
    assert nearest(table(spark, [(50, v)])).count() == 0
    assert found(nearest(table(spark, [(1, v), (2, v)]))) == []
