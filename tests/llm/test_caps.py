import numpy as np
import pytest
from helpers import union_find

from epitide.llm.caps import Caps, embedding_groups, first_common, roots

SCHEMA = "vec_id long, embedding array<float>, label int, cid long, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 0, 0) for i, v, lab in rows], SCHEMA)


def expected(rows, threshold=0.93):
    ok = lambda v, lab: lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    vectors = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v, lab in rows if ok(v, lab)}
    labels = {i: lab for i, _, lab in rows}
    ids, close = sorted(vectors), []
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            u, v = vectors[a], vectors[b]
            if labels[a] == labels[b] and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                close.append((a, b))
    n = {i: 0 for i in labels}
    for a, b in close:
        n[a] += 1
        n[b] += 1
    groups = union_find(list(labels), close)
    return {i: (n[i], groups[i], groups[i] == i) for i in labels}


def cluster(rng, center, n, noise):
    return [(center + rng.normal(0, noise, len(center))).astype(np.float32).tolist() for _ in range(n)]


@pytest.mark.parametrize("block", [8, 512])
def test_links_against_all_pairs(spark, block):
    rng = np.random.default_rng(1)
    vectors = [v for _ in range(6) for v in cluster(rng, rng.normal(size=32), 12, 0.08)]
    vectors += cluster(rng, rng.normal(size=32), 70, 0.05) + rng.normal(size=(150, 32)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 25 + [[x * 3 for x in vectors[1]]]
    rows = [(1000 - i, v, i % 2) for i, v in enumerate(vectors)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_groups(table(spark, rows), block=block).collect()}
    want = expected(rows)
    assert sum(x[0] for x in want.values()) > 1000
    assert got == want


def test_recall_near_the_threshold():
    """At least 99.5 in 100 pairs of cosine 0.93 share a filter; unrelated vectors hardly ever."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(axis=1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93 ** 2) * n
    caps = Caps.of(64, 0.93)
    assert 0.45 < caps.height < 0.56 and caps == Caps.of(64, 0.93)
    lists = []
    for x in (a, b):
        rows, filters = caps.decode(x)
        lists.append([set(filters[rows == i]) for i in range(len(x))])
    assert np.mean([bool(p & q) for p, q in zip(*lists)]) >= 0.995
    assert np.mean([bool(p & q) for p, q in zip(lists[0], lists[1][1:])]) < 0.02


def test_edge_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [0.0] * 3, 0), (6, [1.0, None, 3.0], 0), (7, [1.0, float("nan"), 3.0], 0),
            (8, [1.0, float("inf"), 0.0], 0), (9, v, 1), (10, [1.0, 2.0], 0), (11, [], 0), (12, [2.0], 3), (13, [5.0], 3)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_groups(table(spark, rows)).collect()}
    assert got == {i: (1, 1, i == 1) if i in (1, 2) else (1, 12, i == 12) if i in (12, 13) else (0, i, True) for i, _, _ in rows}
    twice = embedding_groups(table(spark, [(1, v, 0), (1, v, 0), (None, v, 0)])).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in twice) == [
        ("1", 2, 1, True), ("1", 2, 1, True), ("None", 2, 1, False)]
    assert embedding_groups(table(spark, [])).count() == 0


def test_helpers():
    flat = np.array([1, 4, 9, 2, 4, 9, 9])
    assert first_common(flat, np.array([0, 2]), np.array([3, 6])).tolist() == [4, 9]
    assert roots(6, np.array([5, 4, 1]), np.array([4, 3, 0])).tolist() == [0, 0, 2, 3, 3, 3]
