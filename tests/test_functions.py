import datetime
import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from epitide.functions import calendar as cal
from epitide.functions import model, text
from epitide.operators import series as se
from epitide.sources import readers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_to_num(spark):
    df = spark.createDataFrame([("1,234%",), ("X",), ("< 5",), (None,), ("",), ("> 1.5 ",)], "s string")
    got = [r[0] for r in df.select(text.to_num("s")).collect()]
    assert got == [1234.0, None, 5.0, None, None, 1.5]


def test_clean_names(spark):
    names = ["REGION TYPE", "% WEIGHTED ILI", "AGE 0-4", "Age.0.4", "X1", "x_y", "_a__b_", "age 0 4"]
    df = spark.createDataFrame([tuple(range(8))], names).transform(text.clean_names)
    assert df.columns == ["region_type", "weighted_ili", "age_0_4", "age_0_4_1", "x1", "y", "a_b", "age_0_4_2"]


@pytest.mark.parametrize("year, week, day", [
    (2010, 1, (2010, 1, 3)), (2014, 53, (2014, 12, 28)), (2015, 1, (2015, 1, 4)), (2012, 1, (2012, 1, 1)),
])
def test_mmwr_week_start(spark, year, week, day):
    assert one(spark, d=cal.mmwr_week_start(F.lit(year), F.lit(week))).d == datetime.date(*day)


def test_season_rekey(spark):
    df = spark.createDataFrame([(2014, 31), (2014, 32), (2014, 53), (2015, 1)], "y int, w int")
    got = [(r.a, r.b) for r in df.select(cal.season_year(F.col("y"), F.col("w")).alias("a"),
                                         cal.season_week(F.col("w")).alias("b")).collect()]
    assert got == [(2014, 51), (2015, 0), (2015, 21), (2015, 21)]


def test_relabel_and_types(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([("a", "7"), ("z", "x")], "k string, v string")
    assert [r[0] for r in df.select(text.relabel(F.col("k"), {"a": "A"})).collect()] == ["A", "z"]
    schema = T.StructType([T.StructField("v", T.IntegerType()), T.StructField("new", T.DoubleType())])
    assert rows(text.convert_types(df, schema).where("v IS NOT NULL"), "v", "new") == [(7, None)]


def brute_threshold(n, beta, gamma, thresh):
    total = 0.0
    for x in range(1, math.floor(n) + 1):
        left = n - x
        total += math.inf if left == 0 else x * x / (left * n**2 * (left + n * gamma / beta))
        if 1 / total / n**2 < math.sqrt(thresh):
            return x
    return 1


@pytest.mark.parametrize("n, beta", [(2.0, 1.0), (10.0, 2.0), (57.3, 0.5), (1000.0, 1.9), (43817.0, 0.124), (1.5, 3.0),
                                     (99999.5, 0.9), (5.0, 0.001)])
def test_sample_threshold_equals_the_full_scan(spark, n, beta):
    got = one(spark, a=model.sample_threshold(F.lit(n), F.lit(beta), F.lit(0.24)),
              b=model.sample_threshold(F.lit(n), F.lit(beta), F.lit(0.24), 0.5))
    assert (got.a, got.b) == (brute_threshold(n, beta, 0.24, 1), brute_threshold(n, beta, 0.24, 0.5))


def brute_points(total, samples):
    if samples >= total:
        return list(range(1, total + 1))
    return sorted({math.floor(math.exp(j * math.log(total) / samples) + 1e-9) for j in range(samples + 1)})


@pytest.mark.parametrize("total, samples", [(1000, 67), (1000, 5), (10, 20), (10, 10), (50, 49), (7, 2), (1000, 999)])
def test_log_spaced_points(spark, total, samples):
    points = brute_points(total, samples)
    got = one(spark, p=model.log_spaced(F.lit(total), F.lit(samples))).p
    assert got == points
    df = spark.range(1, total + 2).withColumn("p", model.next_log_spaced(F.col("id"), F.lit(float(total)), F.lit(samples)))
    for r in df.collect():
        assert r.p == next((p for p in points if p >= r.id), None), r


def test_terms_at_the_edges(spark):
    zero, one_, two = F.lit(0.0), F.lit(1.0), F.lit(2.0)
    got = one(
        spark,
        nothing=model.count_term(zero, zero, one_),
        impossible=model.count_term(zero, two, one_),
        no_rate=model.waiting_logpdf(zero, one_),
        usual=model.waiting_logpdf(two, F.lit(3.0)),
        at_size=model.fisher_bound(F.lit(10.0), one_, one_, F.lit(10.0)),
        by_zero=model.ratio(F.lit(3), F.lit(0)),
    )
    assert (got.nothing, got.impossible, got.no_rate) == (0.0, -math.inf, -math.inf)
    assert got.usual == pytest.approx(math.log(2) - 6)
    assert got.at_size is None and got.by_zero is None


def test_first_crossing_defaults(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0), ("a", 2, 5.0), ("a", 3, 9.0), ("b", 1, 1.0), ("b", 2, 2.0), ("c", 1, None)],
        "k string, t int, m double",
    )
    cond = F.col("m") > 4
    got = df.groupBy("k").agg(
        se.first_crossing(cond, F.col("t")).alias("one"),
        se.first_crossing(cond, F.col("t"), "null").alias("none"),
        se.first_crossing(cond, F.col("t"), 52).alias("late"),
    )
    assert rows(got, "k", "one", "none", "late") == [("a", 2, 2, 2), ("b", 1, None, 52), ("c", None, None, None)]


def test_keys_from_both_path_layouts(spark):
    df = spark.createDataFrame([("file:/x/2014/3.csv",), ("s3://b/9/year=2014/region=10/part-0-a.csv",)], "p string")
    year, region = readers.keys_from_path(F.col("p"))
    assert [tuple(r) for r in df.select(year, region).collect()] == [(2014, 3), (2014, 10)]


def test_read_files_named_by_key(spark, tmp_path):
    for year, region in ((2011, 1), (2012, 2)):
        (tmp_path / str(year)).mkdir()
        (tmp_path / str(year) / f"{region}.csv").write_text("week,dS,Nmax\n0,5.0,100.0\n1,6.0,100.0\n")
    got = readers.read_keyed_series(spark, f"{tmp_path}/*/*.csv")
    assert rows(got, "year", "region", "week", "dS") == [
        (2011, 1, 0, 5.0), (2011, 1, 1, 6.0), (2012, 2, 0, 5.0), (2012, 2, 1, 6.0)]


def test_preamble_is_dropped(spark, tmp_path):
    (tmp_path / "a.csv").write_text('SOME TITLE, 2014\n"YEAR","WEEK","%ILI"\n"2014","40","1,5"\n2014,41,X\n')
    got = readers.read_skip_preamble(spark, str(tmp_path), ["YEAR", "WEEK", "%ILI"])
    assert rows(got, "year", "week", "ili") == [("2014", "40", "1,5"), ("2014", "41", "X")]


def test_scratch_follows_the_cluster_setting(spark):
    from types import SimpleNamespace

    from epitide.session import cut, scratch_path

    shared = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: "/shared/scratch/"))
    a, b = scratch_path(shared, "x"), scratch_path(shared, "x")
    assert a.startswith("/shared/scratch/x-") and a != b
    assert cut(spark.range(3)).count() == 3
