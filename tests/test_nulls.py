"""Rows without a key, without a value or malformed are not lost silently."""

import math
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epitide.operators import reports, waiting
from epitide.operators.series import since_first, valid_products, weekly_counts
from epitide.operators.spread import attach_key_stats, exact_median, lay_out, running
from epitide.schemas import ILI
from epitide.sources import readers, writers

EVENTS = "id string, ts long"


@pytest.mark.parametrize("small_key_rows", [1, 10**9])
def test_a_null_key_is_a_key(spark, small_key_rows):
    log = spark.createDataFrame([("a", 5), (None, 7), (None, 9), ("a", 6)], EVENTS)
    got = attach_key_stats(log, ["id"], {"first": F.min("ts")}, small_key_rows=small_key_rows)
    assert sorted(got.select("id", "ts", "first").collect(), key=str) == sorted(
        [("a", 5, 5), ("a", 6, 5), (None, 7, 7), (None, 9, 7)], key=str)
    assert since_first(log).count() == 4
    assert weekly_counts(log).agg(F.sum("dS")).first()[0] == 4


def test_counts_of_products_keep_null_times(spark):
    log = spark.createDataFrame([("a", 0), ("a", 0), ("a", 3), ("a", 99), ("a", None), ("b", None)], EVENTS)
    got = valid_products(log, min_reviews=2, horizon=50)
    assert [tuple(r) for r in got.collect()] == [("a", 3, 99)]


def test_running_figures_of_a_null_key(spark):
    log = spark.createDataFrame([(None, i, i * 1.0) for i in range(20)] + [("a", 1, 2.0)], "u string, k long, x double")
    got = running(lay_out(log, ["u"], ["k"]), ["u"], ["k"], sums={"s": F.col("x")}, following={"next": "x"})
    by = {(r.u, r.k): (r.s, r.next) for r in got.collect()}
    assert len(by) == 21 and by[None, 19] == (190.0, None) and by[None, 3] == (6.0, 4.0)


def test_medians_of_empty_groups(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 1.0), (None, 4.0)], "k string, x double")
    assert sorted(map(tuple, exact_median(df, ["k"], ["x"]).collect()), key=str) == sorted([("a", None), (None, 2.5)], key=str)
    none = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert [tuple(r) for r in reports.median_ratio(none, "a", "b").collect()] == [(None,)]


def test_both_ecdf_forms_agree_on_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", None)], "g string, x int")
    a, b = (sorted(map(tuple, reports.ecdf(df, "x", ["g"], whole).collect()), key=str) for whole in (True, False))
    assert a == b and len(a) == 3


def test_grid_search_equals_a_full_scan(spark):
    data = [(u, k, 1.0 + (k * 7) % 5, float(k % 3), 0.5 + (k * 13) % 4) for u in ("a", None) for k in range(1, 40)]
    states = lay_out(spark.createDataFrame(data, "u string, k long, I double, R double, wait double"), ["u"], ["k"])
    sir = {"alpha": 0.1, "beta": 0.3, "gamma": 0.2, "N": 50.0}
    pairs = waiting.next_state_pair(states, ["u"])
    got = {(r.u, r.k): (r.estimate, r.llh) for r in waiting.grid_search_mle(pairs, ["u"], sir, points=30).collect()}
    assert len(got) == 76
    for u in ("a", None):
        mine = [d for d in data if d[0] == u]
        sums = [0.0] * 30
        for (_, k, i, r, _), (*_, wait) in zip(mine, mine[1:]):
            own = []
            for g in range(30):
                rate = (i * g * (3.0 / 29) + 0.1) * (50 - i - r) / 50 + 0.2 * i
                own.append(math.log(rate) - rate * wait)
                sums[g] += own[-1]
            best = max(range(30), key=lambda g: (round(sums[g] / k * 1e8), -g))
            assert got[u, k] == pytest.approx((best * 3.0 / 29, own[best]))


def test_columns_go_by_name(spark, tmp_path):
    wide = "region_type,total_patients,week,year,region,age,ilitotal\nHHS,100,40,2014,Region 1,x,7\n"
    (tmp_path / "a.csv").write_text(wide)
    got = readers.read_csv_header(spark, f"{tmp_path}/*.csv", ILI)
    assert got.columns == ILI.names and [tuple(r) for r in got.collect()] == [("Region 1", 2014, 40, 7, 100)]
    with pytest.raises(ValueError, match="no column"):
        readers.read_csv_header(spark, f"{tmp_path}/*.csv", T.StructType([*ILI.fields, T.StructField("other", T.StringType())]))
    (tmp_path / "b.csv").write_text("week,region_type,total_patients,year,region,age,ilitotal\n40,HHS,100,2014,Region 1,x,7\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv_header(spark, f"{tmp_path}/*.csv", ILI).collect()


def test_malformed_numbers_are_errors(spark, tmp_path):
    (tmp_path / "log.csv").write_text("a,r,5,100\nb,r,5,soon\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_reviews(spark, str(tmp_path)).collect()
    assert rows(readers.read_reviews(spark, str(tmp_path), mode="PERMISSIVE").fillna(-1), "id", "ts") == [("a", 100), ("b", -1)]


def test_quotes_survive(spark, tmp_path):
    df = spark.createDataFrame([('x "y" z', 'back\\slash, comma')], "a string, b string")
    path = writers.write_csv(df, f"{tmp_path}/q")
    assert '"x ""y"" z"' in "".join(f.read_text() for f in (tmp_path / "q").glob("*.csv"))
    assert [tuple(r) for r in readers.read_csv_header(spark, path, df.schema).collect()] == [tuple(df.first())]


def test_only_title_and_header_are_dropped(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A TITLE\n"YEAR","WEEK","ILI"\n2014,X,1\n2014,,2\n,41,3\n')
    got = readers.read_skip_preamble(spark, str(tmp_path), ["YEAR", "WEEK", "ILI"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("2014", "X", "1"), ("2014", None, "2"), (None, "41", "3")], key=str)


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from epitide.session import scratch_path
    conf = SimpleNamespace(get=lambda *a: None)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_path(spark, "x")


def test_rows_like_a_title_stay_in_split_files(spark, tmp_path):
    """Only the first line goes by position, and the header; also where a file is read in many blocks."""
    names = ["REGION", "YEAR", "ILI"]
    body = [f"Region {i % 7},{'2010' if i % 3 else ''},{i if i % 2 else ''}" for i in range(4000)]
    for name, title in (("a", "A TITLE"), ("b", "Region 2,2010,"), ("c", "REGION,YEAR,ILI"), ("d", '"A TITLE, 2014",x')):
        (tmp_path / f"{name}.csv").write_text("\n".join([title, "REGION,YEAR,ILI", *body]) + "\n")
    (tmp_path / "only.csv").write_text("A TITLE\nREGION,YEAR,ILI\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.read_skip_preamble(spark, str(tmp_path), names)
        assert got.rdd.getNumPartitions() > 40
        assert Counter(",".join(x or "" for x in r) for r in got.collect()) == Counter(body * 4)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_joins_keep_null_keys(spark):
    from epitide.operators import ensemble, fits
    from epitide.operators.series import prefix_rows
    from epitide.plans.products import fit_products

    runs = spark.createDataFrame([(None, 1, 5.0), ("a", 1, 6.0)], "region string, t int, I double")
    final = spark.createDataFrame([(None, 9.0), ("a", 8.0)], "region string, N double")
    assert rows(ensemble.trajectories_with_estimate(runs, final, ["region"]).fillna("none"), "region", "N") == [("a", 8.0), ("none", 9.0)]
    pairs = prefix_rows(final.withColumn("t", F.lit(3)), runs.withColumnRenamed("t", "step"), ["region"])
    assert pairs.count() == 2
    sizes = fits.last_size(final.withColumn("t", F.lit(1)), ["region"])
    series = spark.createDataFrame([(r, i, x, 100.0) for r in (None, "a") for i, x in enumerate([2.0, 3.0, 4.0])],
                                   "region string, t0 int, dS double, Nmax double")
    assert fits.fit_known_size(series, sizes, ["region"], ["t0"], 0.24).select("region").distinct().count() == 2
    week = 604800
    log = spark.createDataFrame([(i, "r", 5, k * week * 9) for i in (None, "a") for k in range(40)], "id string, reviewer_id string, rating long, ts long")
    assert fit_products(log, min_reviews=5).count() == 2


def test_one_key_reads_one_bucket(spark, tmp_path):
    df = spark.range(3000).selectExpr("CASE WHEN id % 500 <> 7 THEN CAST(id % 500 AS STRING) END AS id", "id AS week", "id * 1.0 AS dS")
    path = writers.write_buckets(df, f"{tmp_path}/b", ["id"], 8)
    folders = list((tmp_path / "b" / "_buckets=8").glob("_bucket=*"))
    assert len(folders) == 8 and len(list((tmp_path / "b").rglob("*.parquet"))) == 8
    assert sorted(map(str, readers.read_buckets(spark, path).collect())) == sorted(map(str, df.collect()))
    for key, want in (("13", list(range(13, 3000, 500))), (None, list(range(7, 3000, 500))), ("none such", [])):
        got = readers.read_key(spark, path, id=key)
        assert sorted(r.week for r in got.collect()) == want
        assert len({f.rsplit("/", 2)[1] for f in got.select(F.input_file_name()).distinct().toArrow()[0].to_pylist()}) <= 1
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(_bucket" in plan and "PushedFilters: [" in plan
