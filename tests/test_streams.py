"""Grid sums in sorted streams, whatever the ranges, and the weighted fit."""

import math

import numpy as np
import pytest

from epitide.operators import spread, streams, waiting

SIR = {"alpha": 0.0, "beta": 0.3, "gamma": 0.1, "N": 1000.0}
SCHEMA = "user string, k long, I double, R double, wait double"


def log(spark, sizes, parts=None):
    """States of some users, laid out in ranges; a user of None is a user."""
    rows = [(u, k, 1.0 + (k * 7) % 13, float(k // 3), None if k == 1 else float((k * 13) % 40) / 10)
            for u, n in sizes.items() for k in range(1, n + 1)]
    size = spread.RANGE_ROWS * parts if parts else 0
    return rows, spread.lay_out(spark.createDataFrame(rows, SCHEMA), ["user"], ["k"], size=size)


def ranges(df):
    return df.select("_part").distinct().count()


SIZES = {"hot": 1500, "b": 3, None: 40, "c": 1, "d": 200}


def test_number_of_ranges_follows_the_rows(spark):
    assert [ranges(log(spark, SIZES, n)[1]) for n in (None, 40)] == [8, 40]


def test_running_grids_do_not_depend_on_the_ranges(spark):
    found = []
    for parts in (None, 60, 400):
        pairs = waiting.next_state_pair(log(spark, SIZES, parts)[1], ["user"])
        grid = waiting.grid_search_mle(pairs, ["user"], SIR, points=31).collect()
        prefixes = waiting.log_prefix_mle(pairs, ["user"], SIR, points=31).collect()
        found.append([sorted(((r.user or "", r.k, r.estimate, round(r.llh, 6)) for r in x)) for x in (grid, prefixes)])
    assert found[0] == found[1] == found[2]
    assert len(found[0][0]) == sum(n - 1 for n in SIZES.values())


@pytest.mark.parametrize("block", [31, 31 * 7, 1 << 20])
def test_blocks_and_batches_do_not_show(spark, monkeypatch, block):
    monkeypatch.setattr(streams, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        rows, states = log(spark, SIZES, 30)
        pairs = waiting.next_state_pair(states, ["user"])
        got = {(r.user, r.k): r for r in waiting.grid_search_mle(pairs, ["user"], SIR, "gamma", points=31).collect()}
        mle = {r.user: r for r in waiting.weighted_llh(states, ["user"], *map(waiting.F.lit, (0.0, 0.1, 1000.0)), (0.0, 3.0, 31)).collect()
               if r.beta == 3.0}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    grid = np.linspace(0, 1.0, 31)
    for user in SIZES:
        mine = [r for r in rows if r[0] == user]
        lam = np.array([(r[2] * 0.3) * (1000 - r[2] - r[3]) / 1000 + grid * r[2] for r in mine[:-1]]).reshape(-1, 31)
        llh = np.log(lam) - lam * np.array([r[4] for r in mine[1:]])[:, None]
        for k, means in enumerate(np.cumsum(llh, axis=0) / np.arange(1, len(mine))[:, None]):
            j = int(np.argmax(np.rint(means * 1e8)))
            assert got[(user, k + 1)].estimate == pytest.approx(grid[j])
            assert got[(user, k + 1)].llh == pytest.approx(llh[k, j])
        terms = [(math.log(3 * i * (1 - (i + r) / 1000) + 0.1 * i) - t * 3 * i * (1 - (i + r) / 1000) + 0.1 * i) * i
                 for _, _, i, r, t in mine if t is not None]
        if terms:
            assert mle[user].llh == pytest.approx(sum(terms))


def test_plans_hold_no_grid_rows(spark):
    _, states = log(spark, SIZES)
    grid = waiting.grid_search_mle(waiting.next_state_pair(states, ["user"]), ["user"], SIR)
    weighted = waiting.weighted_llh(states, ["user"], *map(waiting.F.lit, (0.0, 0.1, 1000.0)), (0.0, 3.0, 1000))
    for df in (grid, weighted):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and "Generate" not in plan and "MapInArrow" in plan


def expected_log(spark, users, parts=None, gamma=0.0):
    """States whose waiting times are the expected ones of a known model, so that its parameters are the best."""
    rows = []
    for user, (n, b, a, events) in users.items():
        r, i = 0.0, 1.0
        for k in range(1, events + 1):
            rate = (a + b * i) * (1 - (i + r) / n)
            rows.append((user, k, i, r, None if k == 1 else 1 / rate))
            i, r = (i + 1, r) if k % 3 else (max(i - 1, 1.0), r + 1)
    return spread.lay_out(spark.createDataFrame(rows, SCHEMA), ["user"], ["k"], size=spread.RANGE_ROWS * (parts or 0))


def test_known_size_and_rate_are_found(spark):
    users = {"hot": (9000.0, 0.4, 0.0, 5000), "small": (700.0, 0.05, 0.0, 600), None: (60000.0, 2.5, 0.0, 3000)}
    states = expected_log(spark, users, 50)
    got = {r.user: r for r in waiting.weighted_mle(states, ["user"], a=0.0, gamma=0.0).collect()}
    assert got.keys() == users.keys()
    for user, (n, b, _, events) in users.items():
        step = math.log(1e5 / 2) / (12 * 6 ** 3)
        assert abs(math.log(got[user].N / n)) < 3 * step, user
        assert got[user].beta == pytest.approx(b, rel=0.01)
        assert not any(got[user][f"{x}_is_{end}"] for x in waiting.AXES for end in ("ub", "lb"))


def test_outside_rate_is_found(spark):
    states = expected_log(spark, {"u": (5000.0, 0.3, 150.0, 3000)})
    r = waiting.weighted_mle(states, ["user"], gamma=0.0, points={"a": 17}, levels=6).first()
    assert (r.N, r.beta, r.a) == pytest.approx((5000, 0.3, 150.0), rel=0.1)
    full = waiting.weighted_mle(states, ["user"], gamma_max=0.5, points={"N": 7, "beta": 7}).first()
    assert full.gamma_is_ub and full.gamma == pytest.approx(0.5)


def test_ends_and_impossible_keys(spark):
    # more cases than any size allows; no waiting time; waits of zero length
    rows = [("big", k, 2e5, 0.0, 1.0) for k in range(1, 4)] + [("one", 1, 1.0, 0.0, None)] + [("zero", k, 1.0, 0.0, 0.0) for k in range(1, 5)]
    states = spread.lay_out(spark.createDataFrame(rows, SCHEMA), ["user"], ["k"])
    got = {r.user: r for r in waiting.weighted_mle(states, ["user"], a=0.0, gamma=0.1).collect()}
    assert set(got) == {"big", "zero"} and got["big"].N is None and got["big"].llh is None
    assert got["zero"].beta == 1000.0 and got["zero"].beta_is_ub
    assert waiting.weighted_mle(states.limit(0), ["user"], a=0.0, gamma=0.1).count() == 0
    fixed = waiting.weighted_mle(states, ["user"], a=0.0, beta=0.2, gamma=0.1, size=5e5).where("user = 'big'").first()
    assert (fixed.N, fixed.beta, fixed.N_is_ub) == (5e5, 0.2, False)


def test_keys_of_a_batch_are_given_block_by_block(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(streams, "BLOCK", 6 * 10)
    names = np.repeat([f"k{i:03}" for i in range(200)], [1 + i % 3 for i in range(200)])
    batch = pa.RecordBatch.from_pydict({"key": pa.array(names), "x": pa.array(np.arange(len(names), dtype=float))})
    given = []

    def finish(heads, sums):
        given.append(len(sums))
        return streams.with_sums(heads, sums)

    run = streams.fold(["key"], ["key", "x"], 10, lambda b: np.repeat(streams.column(b, "x")[:, None], 10, axis=1), finish)
    for batches in ([batch], [batch.slice(0, 7), batch.slice(7, 0), batch.slice(7, 100), batch.slice(107)]):
        given.clear()
        got = [r for out in run(iter(batches)) for r in out.to_pylist()]
        assert sum(given) == 200 and max(given) <= 2 * 6
        assert [r["key"] for r in got] == sorted(set(names))
        for r in got:
            at = np.flatnonzero(names == r["key"])
            assert r["x"] == at[0] and r["sums"] == [float(at.sum())] * 10


def test_lattice_works_out_logarithms_only(spark, monkeypatch):
    """Terms that are linear in the parameters come from a key's sums, and the likelihood is the whole one."""
    monkeypatch.setattr(waiting, "_weighted_terms", None)
    rows, states = log(spark, SIZES)
    found = waiting.weighted_mle(states, ["user"], gamma_max=1.0, points={"N": 3, "beta": 3, "a": 3, "gamma": 3}, levels=2).collect()
    assert len(found) == len(SIZES) - 1  # a user of one state has no waiting time
    for r in found:
        i, c, wait = (np.array(x) for x in zip(*((x[2], x[2] + x[3], x[4]) for x in rows if x[0] == r.user and x[4] is not None)))
        rate = (r.a + r.beta * i) * (1 - c / r.N)
        assert r.llh == pytest.approx(float((i * (np.log(rate + r.gamma * i) - wait * rate + r.gamma * i)).sum()), rel=1e-9)
