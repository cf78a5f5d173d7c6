import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epitide.operators import fits, waiting
from epitide.operators.spread import lay_out

KEYS, ORDER = ["key"], ["t0"]
COUNTS = [3.0, 5, 9, 14, 22, 30, 33, 28, 19, 11, 6, 3]


def series(spark, counts, nmax=1000.0, key="a"):
    return spark.createDataFrame([(key, i, float(x), nmax) for i, x in enumerate(counts)],
                                 "key string, t0 int, dS double, Nmax double")


def fold(gamma, counts):
    i = r = 0.0
    out = []
    for x in counts:
        i, r = max(1 - gamma, 0) * i + x, r + min(gamma, 1) * i
        out.append((i, r))
    return out


def brute_sir(counts, nmax, gamma, t, points):
    states = fold(gamma, counts)
    low = sum(states[0]) + 1
    best = None
    cmax = max(i + r for i, r in states[: t - 1])
    for g in range(points):
        n = low * (nmax / low) ** (g / (points - 1))
        if n <= cmax:
            continue
        pairs = [(states[j][0] * (1 - sum(states[j]) / n), counts[j + 1]) for j in range(t - 1)]
        weight = sum(w for w, _ in pairs)
        if weight == 0 or any(x > 0 and w <= 0 for w, x in pairs):
            continue
        beta = sum(x for _, x in pairs) / weight
        llh = sum((x * math.log(beta * w) if x > 0 else 0) - beta * w for w, x in pairs)
        if best is None or round(llh, 8) > round(best[2], 8):
            best = (n, beta, llh)
    return best


@pytest.mark.parametrize("gamma", [0.24, 1.68])
def test_every_prefix_equals_brute_force(spark, gamma):
    got = fits.profile_fit_sir(series(spark, COUNTS), KEYS, ORDER, gamma, points=60).orderBy("t").collect()
    assert [r.t for r in got] == list(range(2, len(COUNTS) + 1))
    for r in got:
        n, beta, llh = brute_sir(COUNTS, 1000.0, gamma, r.t, 60)
        assert (r.N, r.beta, r.llh) == pytest.approx((n, beta, llh), rel=1e-8)
        assert r.m == sum(COUNTS[: r.t])


def test_zero_counts(spark):
    counts = [4.0, 0, 3, 0, 0, 2]
    got = {r.t: r for r in fits.profile_fit_sir(series(spark, counts), KEYS, ORDER, 1.0, points=30).collect()}
    assert got[2].beta == 0.0 and got[2].llh == 0.0
    # at gamma 1 nobody is infected before the third count: no finite optimum from there on
    assert all(got[t].N is None and got[t].llh is None for t in (3, 4, 5, 6))
    spread = {r.t: r for r in fits.profile_fit_sir(series(spark, counts), KEYS, ORDER, 0.24, points=30).collect()}
    for t in range(2, 7):
        assert (spread[t].N, spread[t].llh) == pytest.approx(brute_sir(counts, 1000.0, 0.24, t, 30)[::2], rel=1e-8)


def test_known_size_gives_the_same_fit(spark):
    s = series(spark, COUNTS)
    free = fits.profile_fit_sir(s, KEYS, ORDER, 0.24, samples=1)
    known = fits.fit_known_size(s, fits.last_size(free, KEYS), KEYS, ORDER, 0.24, samples=1).first()
    f = free.first()
    assert (known.t, known.N, known.beta, known.llh) == pytest.approx((f.t, f.N, f.beta, f.llh), rel=1e-9)


def test_poisson_llh_at_the_fit(spark):
    from epitide.operators.ensemble import observed_states

    s = series(spark, COUNTS)
    f = fits.profile_fit_sir(s, KEYS, ORDER, 0.24, samples=1).first()
    pairs = fits.lagged_pairs(observed_states(s, KEYS, ORDER, 0.24), KEYS, ORDER)
    llh = fits.poisson_llh(pairs, KEYS, F.lit(0.0), F.lit(f.beta), F.lit(f.N)).first().llh
    assert llh == pytest.approx(f.llh, rel=1e-9)


def test_partitions_do_not_matter(spark):
    s = series(spark, COUNTS).unionByName(series(spark, COUNTS[::-1], key="b"))
    a = sorted(map(tuple, fits.profile_fit_sir(s, KEYS, ORDER, 0.24, points=40).collect()))
    b = sorted(map(tuple, fits.profile_fit_sir(s.repartition(7), KEYS, ORDER, 0.24, points=40).collect()))
    assert a == b


def test_known_parameters_are_recovered(spark):
    n, beta, gamma = 5000.0, 2.2, 1.68
    counts, i, r = [10.0], 10.0, 0.0
    for _ in range(30):
        new = beta * i * (1 - (i + r) / n)
        r, i = r + i, new
        counts.append(new)
    got = fits.profile_fit_sir(series(spark, counts, 1e5), KEYS, ORDER, gamma, samples=1, points=400).first()
    step = (1e5 / 11) ** (1 / 399)
    assert n / step < got.N < n * step
    assert got.beta == pytest.approx(beta, rel=0.01)
    assert not got.is_ub_binding and not got.is_lb_binding


def test_refinement_comes_closer(spark):
    s = series(spark, COUNTS)
    coarse = {r.t: r for r in fits.profile_fit_sir(s, KEYS, ORDER, 0.24, points=40).collect()}
    df = fits.refined_fit_sir(s, KEYS, ORDER, 0.24, points=40, fine_points=15)
    fine = {r.t: r for r in df.collect()}
    assert fine.keys() == coarse.keys()
    ratio = (1000.0 / 4) ** (1 / 39)
    for t, r in fine.items():
        assert r.llh >= coarse[t].llh - 1e-8
        assert coarse[t].N / ratio - 1e-6 <= r.N <= coarse[t].N * ratio + 1e-6
    dense = brute_sir(COUNTS, 1000.0, 0.24, len(COUNTS), 4001)
    assert fine[len(COUNTS)].N == pytest.approx(dense[0], rel=0.03)


def test_bass_equals_brute_force(spark):
    counts, gamma = [2.0, 0, 5, 9, 4, 0, 1], 0.1
    got = fits.profile_fit_bass(series(spark, counts, 500.0), KEYS, ORDER, gamma, 15, 6).first()
    states = fold(gamma, counts)[:-1]
    xs = counts[1:]
    mean = sum(i for i, _ in states) / len(states)
    low = max(i + r for i, r in states) + 1
    best = None
    for g in range(15):
        n = low * (500.0 / low) ** (g / 14)
        for k in range(6):
            rho = k / 5
            w = [(rho + (1 - rho) * i / mean) * (1 - (i + r) / n) for i, r in states]
            scale = sum(xs) / sum(w)
            llh = sum((x * math.log(scale * m) if x > 0 else 0) - scale * m for x, m in zip(xs, w))
            if best is None or round(llh, 8) > round(best[0], 8):
                best = (llh, n, scale * rho, scale * (1 - rho) / mean)
    assert (got.llh, got.N, got.a, got.beta) == pytest.approx(best, rel=1e-8)
    assert fits.profile_fit_bass(series(spark, [5.0]), KEYS, ORDER).count() == 0


SIR = {"alpha": 0.0, "beta": 0.3, "gamma": 0.1, "N": 1000.0}


@pytest.fixture(scope="module")
def pairs(spark):
    """A key with 300 states and some short ones, in several ranges."""
    data = []
    for key, n in ((0, 300), (1, 14), (2, 3), (3, 1)):
        for k in range(1, n + 1):
            data.append((key, k, 1.0 + (k * 7) % 13, float(k // 3), None if k == 1 else float((k * 13) % 40) / 10))
    states = spark.createDataFrame(data, "user_id int, k long, I double, R double, wait double")
    laid = lay_out(states, ["user_id"], ["k"])
    return data, waiting.next_state_pair(laid, ["user_id"])


def brute_llh(data, key, theta):
    mine = [d for d in data if d[0] == key]
    out = []
    for a, b in zip(mine, mine[1:]):
        lam = (a[2] * theta) * (1000 - a[2] - a[3]) / 1000 + 0.1 * a[2]
        out.append(math.log(lam) - lam * b[4] if lam > 0 else -math.inf)
    return out


def test_grid_search_after_every_transition(pairs):
    data, df = pairs
    grid = np.linspace(0, 3.0, 31)
    got = {(r.user_id, r.k): r for r in waiting.grid_search_mle(df, ["user_id"], SIR, points=31).collect()}
    assert len(got) == 299 + 13 + 2
    for key, n in ((0, 300), (1, 14), (2, 3)):
        llh = np.array([brute_llh(data, key, t) for t in grid])
        means = np.round(np.cumsum(llh, axis=1) / np.arange(1, n), 8)
        for k in range(1, n):
            j = int(np.argmax(means[:, k - 1]))
            r = got[(key, k)]
            assert r.estimate == pytest.approx(grid[j]), (key, k)
            assert r.llh == pytest.approx(llh[j, k - 1])
            assert (r.is_lb_binding, r.is_ub_binding) == (j == 0, j == 30)


def test_log_prefixes(pairs):
    data, df = pairs
    grid = np.linspace(0, 3.0, 31)
    got = {(r.user_id, r.k): r for r in waiting.log_prefix_mle(df, ["user_id"], SIR, points=31).collect()}
    want = set()
    for key, n in ((0, 300), (1, 14), (2, 3), (3, 1)):
        points = {math.floor(math.exp(j * math.log(1000) / n) + 1e-9) for j in range(n + 1)}
        llh = np.array([brute_llh(data, key, t) for t in grid])
        for k in sorted(p for p in points if 10 < p < n):
            want.add((key, k))
            sums = llh[:, : k - 1].sum(axis=1)
            j = int(np.argmax(np.round(sums, 6)))
            assert got[(key, k)].estimate == pytest.approx(grid[j])
            assert got[(key, k)].llh == pytest.approx(sums[j])
    assert set(got) == want


def bass_series(spark, n, a, b, gamma=0.1, steps=60, key="a"):
    """Expected counts of a known Bass model."""
    counts, i, r = [20.0], 20.0, 0.0
    for _ in range(steps):
        new = (a + b * i) * (1 - (i + r) / n)
        i, r = (1 - gamma) * i + new, r + gamma * i
        counts.append(new)
    return series(spark, counts, 1e5, key)


def test_refined_bass_finds_the_known_model(spark):
    s = bass_series(spark, 5000.0, 12.0, 0.25).unionByName(bass_series(spark, 700.0, 2.0, 0.4, key=None))
    got = {r.key: r for r in fits.refined_fit_bass(s, KEYS, ORDER).collect()}
    coarse = {r.key: r for r in fits.profile_fit_bass(s, KEYS, ORDER).collect()}
    for key, (n, a, b) in {"a": (5000.0, 12.0, 0.25), None: (700.0, 2.0, 0.4)}.items():
        assert got[key].N == pytest.approx(n, rel=0.01) and got[key].beta == pytest.approx(b, rel=0.02)
        assert got[key].a == pytest.approx(a, rel=0.1) and got[key].llh >= coarse[key].llh
        assert (got[key].t, got[key].m) == (coarse[key].t, pytest.approx(coarse[key].m))


def test_bass_without_further_levels_is_the_grid(spark):
    s = series(spark, COUNTS).unionByName(series(spark, [2.0, 0, 5, 9, 4, 0, 1], 500.0, "b")).unionByName(series(spark, [5.0], key="c"))
    a, b = (sorted(map(tuple, df.select("key", "t", F.round("N", 6), F.round("a", 8), F.round("beta", 8), F.round("llh", 6), "m").collect()))
            for df in (fits.refined_fit_bass(s, KEYS, ORDER, levels=0), fits.profile_fit_bass(s, KEYS, ORDER)))
    assert a == b and len(a) == 2


def test_bass_prefixes_see_no_later_rows(spark):
    full = fits.refined_fit_bass(series(spark, COUNTS), KEYS, ORDER, samples=100).collect()
    assert [r.t for r in sorted(full, key=lambda r: r.t)] == list(range(2, len(COUNTS) + 1))
    short = {r.t: r for r in fits.refined_fit_bass(series(spark, COUNTS[:7]), KEYS, ORDER, samples=100).collect()}
    for r in full:
        if r.t <= 7:
            assert short[r.t] == r
        cases = fold(0.1, COUNTS[:r.t - 1])
        assert r.N is None or r.N > max(i + x for i, x in cases)


def test_series_streams_in_small_batches(spark):
    s = series(spark, COUNTS).unionByName(series(spark, COUNTS[::-1], key=None)).unionByName(series(spark, [4.0], key="c"))
    whole = sorted(map(str, fits.refined_fit_sir(s, KEYS, ORDER, 0.24).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert sorted(map(str, fits.refined_fit_sir(s, KEYS, ORDER, 0.24).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == 22
    one = fits.refined_fit_sir(s, KEYS, ORDER, 0.24, samples=1).where("key = 'c'").first()
    assert (one.t, one.N, one.llh, one.m) == (1, None, None, 4.0)
    assert fits.refined_fit_sir(s.limit(0), KEYS, ORDER, 0.24).count() == 0


def test_series_searched_together_are_those_searched_alone(monkeypatch):
    from epitide.operators import search

    rng = np.random.default_rng(5)
    alone, rows, starts, figures = [], [], [], []
    for n, high in ((1, 1e5), (2, 1e5), (7, 30.0), (40, 1e5), (5, 3.0), (300, 1e5), (3, np.nan)):
        new = rng.integers(0, 6, n).astype(float)
        infected, cases = 1 + rng.random(n) * 9, 1 + np.cumsum(rng.integers(0, 4, n)).astype(float)
        low, norm = cases.max() + 1, infected.mean()
        alone.append(search.search(search.Pairs(infected, cases, new), np.array([n]), low, high, norm, 12, 6, 5, 2))
        starts.append(sum(len(r[0]) for r in rows))
        rows.append((infected, cases, new))
        figures.append((low, high, norm))
    infected, cases, new = (np.concatenate([r[c] for r in rows]) for c in range(3))
    low, high, norm = (np.array([f[c] for f in figures]) for c in range(3))
    for together in (1, 18 * 8, 1 << 16):
        monkeypatch.setattr(search, "TOGETHER", together)
        got = search.search_together(search.Stack(infected, cases, new, np.array(starts), low, high, norm), 12, 6, 5, 2)
        for name, values in got.items():
            assert values == pytest.approx(np.concatenate([a[name] for a in alone]), rel=1e-9, nan_ok=True)
    assert np.isnan(got["N"]).tolist() == [False, False, False, False, True, False, True]


def test_whole_series_cut_by_batches(spark):
    from functools import reduce

    counts = {None: COUNTS, "b": [2.0, 0, 5], "c": [4.0], "d": COUNTS[::-1], "e": [1.0, 1]}
    s = reduce(lambda a, b: a.unionByName(b), [series(spark, v, 500.0, k) for k, v in counts.items()])
    found = []
    for size in (10_000, 5, 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found.append([sorted(map(tuple, f(s.coalesce(1), KEYS, ORDER).collect()), key=str) for f in (fits.profile_fit_bass, fits.refined_fit_bass)])
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2]
    assert [[r[0] for r in x] for x in found[0]] == [["b", "d", "e", None]] * 2


def test_bass_grid_is_not_laid_out_as_rows(spark):
    plan = fits.profile_fit_bass(series(spark, COUNTS), KEYS, ORDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_no_outside_rate_without_an_estimate(spark):
    s = series(spark, [4.0, 0, 3, 0, 0, 2])
    fitted = [f(s, KEYS, ORDER, 1.0).orderBy("t") for f in (fits.profile_fit_sir, fits.refined_fit_sir)]
    assert fitted[0].columns == fitted[1].columns
    assert [[(r.t, r.a) for r in df.collect() if r.N is None] for df in fitted] == [[(t, 0.0) for t in (3, 4, 5, 6)]] * 2
