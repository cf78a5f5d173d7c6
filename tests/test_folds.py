import pytest
from pyspark.sql import functions as F

from epitide.operators import series as se
from epitide.operators.folds import state_fold_ranges
from test_series import KEYS, ORDER, fold, series


@pytest.mark.parametrize("gamma", [0.0, 0.002, 0.24, 0.999, 1.0, 1.68])
def test_one_key_over_many_ranges(spark, gamma):
    counts = [((i * 37) % 11) * (0 if 100 < i < 390 else 1) for i in range(900)]
    data = series(spark, a=counts, b=[5], c=[1, 2]).withColumn("key", F.expr("nullif(key, 'c')"))
    got = state_fold_ranges(data, KEYS, ORDER, gamma).orderBy("t0").collect()
    assert len(got) == 903
    for name, own in (("a", counts), ("b", [5]), (None, [1, 2])):
        for r, (i, removed) in zip([r for r in got if r.key == name], fold(gamma, own), strict=True):
            assert r.I == pytest.approx(i, rel=1e-9, abs=1e-12)
            assert r.R == pytest.approx(removed, rel=1e-9, abs=1e-9)


def test_equals_the_fold_of_whole_keys(spark, monkeypatch):
    """A key of 60,000 rows, a third of the table, in ranges of 5,000 rows."""
    from epitide.operators import spread
    monkeypatch.setattr(spread, "RANGE_ROWS", 5_000)
    data = spark.range(180_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("key"),
        F.col("id").alias("t0"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("double").alias("dS"))
    cut = state_fold_ranges(data, KEYS, ORDER, 0.1, size=180_000)
    whole = se.state_fold(data, KEYS, ORDER, 0.1).select("key", "t0", F.col("I").alias("whole_i"), F.col("R").alias("whole_r"))
    both = cut.join(whole, ["key", "t0"])
    rows = both.select(F.abs(F.col("I") - F.col("whole_i")).alias("x"), (F.abs(F.col("R") - F.col("whole_r")) / (F.col("whole_r") + 1)).alias("y"))
    off = rows.agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x"), F.max("y").alias("y")).first()
    assert off.n == 180_000 and off.x < 1e-9 and off.y < 1e-9


def test_empty_and_null_counts(spark):
    schema = "key string, t0 int, dS double"
    assert state_fold_ranges(spark.createDataFrame([], schema), KEYS, ORDER, 0.24).count() == 0
    rows = [("a", 0, None), ("a", 1, 3.0), ("a", 2, None), ("a", 3, 1.0)]
    got = state_fold_ranges(spark.createDataFrame(rows, schema), KEYS, ORDER, 0.5).orderBy("t0").collect()
    assert [x for r in got for x in (r.I, r.R)] == pytest.approx([0, 0, 3, 0, 1.5, 1.5, 1.75, 2.25])
    assert [r.dS for r in got] == [None, 3.0, None, 1.0]
