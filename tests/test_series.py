import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from epitide.operators import series as se

KEYS, ORDER = ["key"], ["t0"]


def series(spark, **counts):
    data = [(k, i, float(x), 1000.0) for k, xs in counts.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(data, "key string, t0 int, dS double, Nmax double")


def fold(gamma, counts):
    i = r = 0.0
    out = []
    for x in counts:
        i, r = max(1 - gamma, 0) * i + x, r + min(gamma, 1) * i
        out.append((i, r))
    return out


def test_state_fold_by_hand(spark):
    got = se.state_fold(series(spark, a=[10, 20, 30]), KEYS, ORDER, 0.24).orderBy("t0").collect()
    assert [r.I for r in got] == pytest.approx([10, 27.6, 50.976])
    assert [r.R for r in got] == pytest.approx([0, 2.4, 9.024])


@pytest.mark.parametrize("gamma", [0.0, 0.1, 0.24, 0.9, 0.999, 1.0, 1.68])
def test_state_fold_equals_the_recursion_over_many_blocks(spark, gamma):
    counts = [((i * 37) % 11) * (0 if 100 < i < 190 else 1) for i in range(400)]
    got = se.state_fold(series(spark, a=counts, b=[5]), KEYS, ORDER, gamma)
    a = got.where("key = 'a'").orderBy("t0").collect()
    for r, (i, removed) in zip(a, fold(gamma, counts)):
        assert r.I == pytest.approx(i, rel=1e-9, abs=1e-300)
        assert r.R == pytest.approx(removed, rel=1e-9)
    total = 0.0
    for r in a:
        total += r.dS
        assert r.I + r.R == pytest.approx(total, rel=1e-9)
    b = got.where("key = 'b'").first()
    assert (b.I, b.R) == (5.0, 0.0)


def brute_points(counts, samples):
    n, total = len(counts), sum(counts)
    if samples <= 1:
        return [n]
    if samples >= n:
        return [t for t in range(1, n + 1) if t > 1]
    out = set()
    for j in range(samples):
        level, m, first = 0.4 + 0.6 * j / (samples - 1), 0, 1
        for t, x in enumerate(counts, 1):
            m += x
            if m > 0 and total > 1 and math.log(m) / math.log(total) >= level - 1e-12:
                first = t
                break
        out.add(first)
    return sorted(t for t in out if t > 1)


@pytest.mark.parametrize("samples", [1, 2, 5, 10, 12, 100])
def test_prefix_points(spark, samples):
    counts = {"a": [1, 0, 2, 5, 9, 20, 40, 20, 8, 2, 1, 0], "b": [0, 0, 3], "c": [7], "z": [0] * 14, "o": [0, 1] + [0] * 12}
    got = se.prefix_points(series(spark, **counts), KEYS, ORDER, samples)
    want = sorted((k, t) for k, xs in counts.items() for t in brute_points(xs, samples))
    assert rows(got, "key", "t") == want


def test_week_53_and_week_1_keep_their_order(spark):
    ili = spark.createDataFrame(
        [("Region 2", 2014, 53, 7, 10), ("Region 2", 2015, 1, 9, 20), ("Region 2", 2014, 40, 1, 30)],
        "region string, year int, week int, ilitotal long, total_patients long",
    )
    got = se.season_series(ili)
    assert rows(got, "yw", "region", "year", "week", "dS", "Nmax") == [
        (201440, 2, 2015, 8, 1.0, 40.0), (201453, 2, 2015, 21, 7.0, 40.0), (201501, 2, 2015, 21, 9.0, 20.0)]
    total = se.running_total(got, ["region", "year"], ["yw"])
    assert rows(total, "yw", "m") == [(201440, 1.0), (201453, 8.0), (201501, 17.0)]


def test_first_maximum_on_ties(spark):
    df = spark.createDataFrame([(1, 1, 3, 201503, 5.0), (1, 1, 2, 201502, 5.0), (1, 1, 4, 201504, 1.0)],
                               "region int, year int, week int, yw int, dS double")
    assert rows(se.observed_peak(df, ["region", "year"]), "peak_t", "peak_dS") == [(2, 5.0)]


def test_valid_products_is_strict(spark):
    horizon = 1000
    events = spark.createDataFrame(
        [("a", 0), ("a", 10), ("a", 999), ("a", 1001), ("b", 5), ("b", 6), ("b", 7), ("b", 1005), ("c", 0), ("c", 2000)],
        "id string, ts long",
    )
    got = se.valid_products(events, 2, horizon)
    assert rows(got, "id", "reviews_4y", "last_review_ts") == [("a", 3, 1001)]


def test_season_ids(spark):
    asked = spark.createDataFrame([(1997,), (57,), (2017,), (1960,)], "year int")
    there = spark.createDataFrame([(37,), (57,), (58,)], "id int")
    assert [r.id for r in se.season_ids(asked, there).collect()] == [37, 57]
    none = spark.createDataFrame([(1,)], "year int")
    assert [r.id for r in se.season_ids(none, there).collect()] == [58]


def test_key_grid(spark):
    bounds = spark.range(1).select(F.lit(2011).alias("a"), F.lit(2012).alias("b"))
    got = se.key_grid(bounds, year=F.sequence("a", "b"), kind=F.array(F.lit("x"), F.lit("y")))
    assert rows(got, "year", "kind") == [(2011, "x"), (2011, "y"), (2012, "x"), (2012, "y")]


def test_prefixes_are_slices_of_their_series(spark):
    """The rows up to ``t``, as a join by range gives them, without one; lengths beyond both ends, NULL keys."""
    seen = spark.createDataFrame([(k, s, float(s * 7 % 5), s % 3) for k in ("a", "b", None) for s in range(1, 13)],
                                 "k string, step int, I double, R int").repartition(5)
    asked = [(k, t, t * 0.5) for k in ("a", None, "c") for t in (1, 5, 12)] + [("b", 40, 1.0), ("b", 0, 2.0), ("b", -1, 3.0), ("b", None, 4.0)]
    estimates = spark.createDataFrame(asked, "k string, t long, beta double")
    got = se.prefix_rows(estimates, seen, ["k"])
    assert got.columns == ["k", "t", "beta", "step", "I", "R"]
    want = [(k, t, beta, s, float(s * 7 % 5), s % 3) for k, t, beta in asked if k != "c" and t is not None
            for s in range(1, 13) if s <= t]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "<= t" not in plan and "step#" not in next(x for x in plan.splitlines() if "Join" in x)
    assert se.prefix_rows(estimates, seen.limit(0), ["k"]).count() == 0
