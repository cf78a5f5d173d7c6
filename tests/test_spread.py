"""The skew-safe steps against plain windows, on data in which one key holds most rows."""

import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from epitide.operators import reports
from epitide.operators import series as se
from epitide.operators.spread import attach_key_stats, exact_median, lay_out, running


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows, two thirds of them with key 0."""
    return spark.createDataFrame(
        [(0 if i % 3 < 2 else i % 17 + 1, (i * 7919) % 100_000, i, float((i * 31) % 50)) for i in range(3000)],
        "key int, ts long, id long, x double",
    )


@pytest.mark.parametrize("small_key_rows", [100, 10**9])
def test_key_stats_with_and_without_large_keys(skewed, small_key_rows):
    got = attach_key_stats(skewed, ["key"], {"first": F.min("ts"), "n": F.count(F.lit(1))}, small_key_rows)
    w = Window.partitionBy("key")
    want = skewed.withColumns({"first": F.min("ts").over(w), "n": F.count(F.lit(1)).over(w)})
    assert rows(got, "key", "ts", "id", "first", "n") == rows(want, "key", "ts", "id", "first", "n")


@pytest.mark.parametrize("small_key_rows", [100, 10**9])
def test_weekly_counts_of_large_keys(spark, skewed, small_key_rows):
    events = skewed.select(F.col("key").cast("string").alias("id"), (F.col("ts") * 100).alias("ts"))
    got = se.weekly_counts(events, small_key_rows=small_key_rows)
    week = F.expr("(ts - min(ts) OVER (PARTITION BY id)) DIV 604800")
    want = events.select("id", week.alias("week")).groupBy("id", "week").agg(F.count(F.lit(1)).alias("dS"))
    assert rows(got, "id", "week", "dS") == rows(want, "id", "week", "dS")


def test_running_equals_windows_and_cuts_large_keys(skewed):
    laid = lay_out(skewed, ["key"], ["ts", "id"])
    assert laid.where("key = 0").select("_part").distinct().count() > 2
    got = running(laid, ["key"], ["ts", "id"], sums={"k": F.lit(1), "s": F.col("x")}, totals={"n": F.lit(1)},
                  previous={"before": "ts"}, following={"after": "ts"})
    w = Window.partitionBy("key").orderBy("ts", "id")
    want = skewed.withColumns({
        "k": F.row_number().over(w),
        "s": F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "n": F.count(F.lit(1)).over(Window.partitionBy("key")),
        "before": F.lag("ts").over(w), "after": F.lead("ts").over(w),
    })
    columns = ("key", "id", "k", "s", "n")
    assert rows(got, *columns) == rows(want, *columns)
    for c in ("before", "after"):
        a = {r.id: r[c] for r in got.select("id", c).collect()}
        assert a == {r.id: r[c] for r in want.select("id", c).collect()}


def test_median_is_exact(skewed):
    got = {r.key: (r.x, r.ts) for r in exact_median(skewed, ["key"], ["x", "ts"]).collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.key, []).append(r)
    want = {k: (statistics.median(r.x for r in v), statistics.median(r.ts for r in v)) for k, v in groups.items()}
    assert got == want


@pytest.mark.parametrize("by", [[], ["key"]])
def test_both_ways_to_an_ecdf(skewed, by):
    slow = reports.ecdf(skewed, "x", by)
    fast = reports.ecdf(skewed, "x", by, whole=True)
    w = Window.partitionBy(*by).orderBy("x") if by else Window.orderBy("x")
    want = skewed.withColumn("ecdf", F.cume_dist().over(w)).select(*by, "x", "ecdf").distinct()
    for got in (slow, fast):
        assert rows(got, *by, "x", "ecdf") == rows(want, *by, "x", "ecdf")


def test_sample_does_not_depend_on_partitions(skewed):
    ids = skewed.select(F.col("id").cast("string").alias("id"))
    a = rows(se.sample_rows(ids, "id", 20), "id")
    assert len(a) == 20 and a == rows(se.sample_rows(ids.repartition(5), "id", 20), "id")
    assert a != rows(se.sample_rows(ids, "id", 20, seed=43), "id")


def test_hot_rows_are_not_shuffled_for_key_stats(skewed):
    """Rows of large keys meet their figures in a broadcast join."""
    events = skewed.select(F.col("key").cast("string").alias("id"), "ts")
    plan = se.since_first(events)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan


def test_more_values_make_more_ranges(spark, monkeypatch):
    """Medians and distributions go by as many ranges as their values ask for, with the same rows."""
    from epitide.operators import spread

    df = spark.createDataFrame([(i % 2, float(i * 7919 % 4001)) for i in range(4000)], "key int, x double")
    want = rows(exact_median(df, ["key"], ["x"]), "key", "x"), rows(reports.ecdf(df, "x", ["key"]), "key", "x", "ecdf")
    made = []
    real = spread.lay_out

    def counted(*args, **named):
        out = real(*args, **named)
        made.append(out.select("_part").distinct().count())
        return out

    monkeypatch.setattr(spread, "RANGE_ROWS", 100)
    monkeypatch.setattr(spread, "lay_out", counted)
    monkeypatch.setattr(reports, "lay_out", counted)
    assert want == (rows(exact_median(df, ["key"], ["x"]), "key", "x"), rows(reports.ecdf(df, "x", ["key"]), "key", "x", "ecdf"))
    assert len(made) == 2 and min(made) > 8
