import pytest
from pyspark.sql import functions as F

from conftest import rows
from epitide.operators import ensemble as en
from epitide.operators import reports
from epitide.operators.spread import exact_median

KEYS = ["region", "year"]


@pytest.fixture(scope="module")
def tables(spark):
    observed = spark.createDataFrame(
        [(1, 2012, s, i, 0.0) for s, i in enumerate([2.0, 7.0, 7.0, 4.0], 1)], "region int, year int, step int, I double, R double"
    )
    estimates = spark.createDataFrame([(1, 2012, 2), (1, 2012, 4)], "region int, year int, t int")
    # seed 1 goes on after t = 2, seed 2 dies at once; after t = 4 both die
    continuations = spark.createDataFrame(
        [(1, 2012, 2, 1, 1, 9.0, 0.0, 1.0), (1, 2012, 2, 1, 2, 12.0, 0.0, 1.0), (1, 2012, 2, 1, 3, 12.0, 0.0, 1.0)],
        "region int, year int, t int, seed int, step int, I double, R double, wait double",
    )
    return estimates, observed, continuations


def test_replicates_that_die_at_once_still_count(tables):
    got = en.stitched_peak(*tables, KEYS, seeds=2)
    assert rows(got, "t", "seed", "peak_t", "peak_I") == [(2, 1, 4.0, 12.0), (2, 2, 2.0, 7.0), (4, 1, 2.0, 7.0), (4, 2, 2.0, 7.0)]


def test_peaks_equal_those_of_the_stitched_rows(tables):
    stitched = en.stitched_series(*tables, KEYS, seeds=2)
    assert stitched.count() == 2 * (2 + 4) + 3
    top = stitched.groupBy(*KEYS, "t", "seed").agg(
        F.max_by("clock", F.struct("I", -F.col("step"))).alias("peak_t"), F.max("I").alias("peak_I"))
    got = en.stitched_peak(*tables, KEYS, seeds=2)
    columns = ("t", "seed", "peak_t", "peak_I")
    assert rows(got, *columns) == rows(top, *columns)


def test_peak_report(tables):
    got = en.peak_report(*tables, KEYS, seeds=2)
    assert rows(got, "t", "peak_t", "peak_I", "seed", "actual_peak_I", "actual_peak_t") == [
        (2, 3.0, 9.5, 1.5, 7.0, 2), (4, 2.0, 7.0, 1.5, 7.0, 2)]


def test_take_while_active(spark):
    steps = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 2.0), ("a", 3, 1.0), ("a", 4, 5.0), ("b", 1, 0.5)],
                                  "key string, t int, I double")
    assert rows(en.take_while_active(steps, ["key"]), "key", "t") == [("a", 1), ("a", 2)]


def test_leftovers_count_only_replicates_past_the_horizon(spark):
    t = spark.createDataFrame([(1, 2012, 1, 53, 4.0), (1, 2012, 1, 54, 2.0), (1, 2012, 2, 52, 9.0)],
                              "region int, year int, seed int, t int, I double")
    assert rows(en.leftovers(t, KEYS), "region", "year", "m_leftover") == [(1, 2013, 6.0)]


def test_histogram_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(0.5,), (0.6,), (1.5,), (-0.5,), (None,)], "x double")
    assert rows(reports.hist_share(df, F.col("x")), "bin", "n", "share") == [(-1.0, 1, 0.25), (0.0, 1, 0.25), (1.0, 2, 0.5)]


def test_joint_share_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 1)] + [(2, 2)] * 7 + [(3, i) for i in range(192)], "a int, b int")
    got = {(r.a, r.b): r.pct for r in reports.joint_share(df, "a", "b").collect()}
    assert got[(1, 1)] == 0.0 and got[(2, 2)] == 0.04


def test_median_ratio(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (5, 2), (4, 0)], "a int, b int")
    assert reports.median_ratio(df, "a", "b").first().median_ratio == 1.5


def test_median_of_one_value(spark):
    df = spark.createDataFrame([("k", 3.0)], "k string, x double")
    assert exact_median(df, ["k"], ["x"]).first().x == 3.0
