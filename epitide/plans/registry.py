"""The registered queries, one per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epitide.functions import calendar as cal
from epitide.functions import model, text
from epitide.operators import ensemble as en
from epitide.operators import fits, folds, reports, waiting
from epitide.operators import series as se
from epitide.operators.spread import join_keys
from epitide.plans import products, surveillance, texts
from epitide.plans import views as v
from epitide.plans.views import GAMMA, KEYS, ORDER, SEEDS, SIR
from epitide.schemas import ILI, SERIES
from epitide.session import scratch_path
from epitide.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: thresholds of the test tables, which are shorter and smaller than the real ones
MIN_REVIEWS, HORIZON, AFTER_YEAR = 10, 40, 1996
USER = ["user_id"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined_query(fn: Query) -> Query:
    """A query over several tables that come from the same visits."""

    @wraps(fn)
    def run(spark, folder):
        with v.one_scan():
            return fn(spark, folder)

    return query(run)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round doubles, so that engines that add in another order give the same value."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# --- sources and sinks --------------------------------------------------------------

@query
def scan_reviews_csv(spark, d):
    path = writers.write_csv(v.reviews(spark, d), scratch_path(spark, "reviews"), header=False)
    return readers.read_reviews(spark, path)


@query
def scan_ili_csv(spark, d):
    path = writers.write_csv(v.ili(spark, d), scratch_path(spark, "ili"))
    return readers.read_csv_header(spark, path, ILI)


RAW_HEADER = ["WEEK", "TOTAL PATIENTS", "%WEIGHTED ILI", "NUM. OF PROVIDERS"]


@query
def scan_skip_preamble(spark, d):
    raw, none = v.ili_raw(spark, d), F.lit(None).cast("string")
    incomplete = raw.where("week % 10 = 0").select(F.concat(F.lit("Region "), "week").alias("week"), F.explode(
        F.array(F.col("num_of_providers"), none)).alias("total_patients"), none.alias("weighted_ili"), none.alias("num_of_providers"))
    path = writers.write_with_preamble(
        raw.unionByName(incomplete), scratch_path(spark, "download"), "PERCENTAGE OF VISITS FOR ILI", RAW_HEADER
    )
    return readers.read_skip_preamble(spark, path, RAW_HEADER)


LOADED_HEADER = ["REGION", "YEAR", "WEEK", "ILITOTAL", "TOTAL PATIENTS", "%UNWEIGHTED ILI"]


@query
def clean_surveillance(spark, d):
    def thousands(column):
        return F.format_number(F.col(column) * 1000, 0)

    share = F.when(F.col("ilitotal") > 0, F.concat((F.col("ilitotal") % 100).cast("string"), F.lit(" %"))).otherwise("X")
    messy = v.ili(spark, d).select("region", F.col("year").cast("string"), F.col("week").cast("string"),
                                   thousands("ilitotal"), thousands("total_patients"), share)
    path = writers.write_with_preamble(messy, scratch_path(spark, "download"), "PERCENTAGE OF VISITS", LOADED_HEADER)
    return surveillance.clean_surveillance(readers.read_skip_preamble(spark, path, LOADED_HEADER))


@query
def cleaned_season_series(spark, d):
    typed = clean_surveillance(spark, d).withColumns({c: F.col(c) / 1000 for c in ("ilitotal", "total_patients")})
    return se.season_series(typed.select(*ILI.names))


def _keyed(spark, d):
    path = writers.write_by_key(
        v.series(spark, d).select("week", "dS", "Nmax", *KEYS), scratch_path(spark, "series")
    )
    return f"{path}/year=*/region=*/*.csv"


@query
def scan_many_files(spark, d):
    rows = readers.read_many(spark, _keyed(spark, d), SERIES)
    return rows.withColumn("fname", F.regexp_extract("fname", r"(year=\d+/region=\d+)/", 1))


@query
def keys_from_path(spark, d):
    return readers.read_keyed_series(spark, _keyed(spark, d))


@query
def typed_read(spark, d):
    path = writers.write_csv(v.series(spark, d).select("week", "dS", "Nmax"), scratch_path(spark, "typed"))
    return readers.read_csv_header(spark, path, SERIES)


@query
def type_convert(spark, d):
    schema = T.StructType([
        T.StructField("week", T.IntegerType()),
        T.StructField("total_patients", T.StringType()),
        T.StructField("weighted_ili", T.DoubleType()),
        T.StructField("num_of_providers", T.DoubleType()),
    ])
    return text.convert_types(v.ili_raw(spark, d), schema)


@query
def write_csv_header(spark, d):
    path = writers.write_csv(se.weekly_counts(v.reviews(spark, d)), scratch_path(spark, "weekly"))
    return readers.read_csv_header(spark, path, T.StructType(
        [T.StructField("id", T.StringType()), T.StructField("week", T.LongType()),
         T.StructField("dS", T.LongType()), T.StructField("Nmax", T.DoubleType())]
    ))


@query
def write_by_key(spark, d):
    path = writers.write_by_key(v.series(spark, d), scratch_path(spark, "by-key"), fmt="parquet")
    return spark.read.parquet(path)


def _bucketed(spark, d):
    return writers.write_buckets(se.weekly_counts(v.reviews(spark, d)), scratch_path(spark, "products"), ["id"], 16)


@query
def write_buckets(spark, d):
    """One product's series among any number of products: buckets, not a file each."""
    return readers.read_buckets(spark, _bucketed(spark, d))


@query
def read_key(spark, d):
    return readers.read_key(spark, _bucketed(spark, d), id="7")


@query
def param_query(spark, d):
    return spark.sql(
        texts.SEASON_SQL, args={"start": cal.SEASON_START, "region": "1", "season": 1997}, ili=v.ili(spark, d)
    )


@query
def param_query_weekly(spark, d):
    return spark.sql(
        texts.WEEKLY_SQL, args={"week_seconds": cal.WEEK_SECONDS, "nmax": se.PRODUCT_NMAX, "id": "7"},
        reviews=v.reviews(spark, d),
    )


# --- projections and filters --------------------------------------------------------

@query
def season_rekey(spark, d):
    year, week = F.col("year"), F.col("week")
    return v.ili(spark, d).select(
        "region", "year", "week", cal.season_year(year, week).alias("season"), cal.season_week(week).alias("season_week")
    )


@query
def region_filter(spark, d):
    return v.ili(spark, d).where(F.col("region") == text.region_label(F.lit(3)))


@query
def season_filter(spark, d):
    return v.series(spark, d).where(F.col("year") == 1998)


@query
def id_filter(spark, d):
    return se.weekly_counts(v.reviews(spark, d).where(F.col("id") == "7"))


@query
def const_column(spark, d):
    return v.ili(spark, d).select(
        F.lit("National").alias("region"), "year", "week", "ilitotal", F.lit(se.PRODUCT_NMAX).alias("Nmax")
    )


@query
def rename_select_drop(spark, d):
    return v.series(spark, d).withColumnsRenamed({"week": "peak_t", "dS": "peak_dS"}).drop("Nmax", "yw")


@query
def year_filter(spark, d):
    return v.series(spark, d).where(F.col("year") > AFTER_YEAR)


@query
def horizon_filter(spark, d):
    return v.trajectories(spark, d).where(F.col("t") > HORIZON)


@query
def year_shift(spark, d):
    return v.trajectories(spark, d).withColumn("year", F.col("year") + 1)


VAR_LABELS = {"m_peak_t": "weeks until a quarter of the peak size", "m_star_t": "weeks until the error bound is one"}


@joined_query
def label_case(spark, d):
    long = _crossings(spark, d).unpivot(KEYS, ["m_star_t", "m_peak_t", "peak_t"], "var", "val")
    return long.withColumn("var", text.relabel(F.col("var"), VAR_LABELS))


@query
def unpivot_measures(spark, d):
    return v.series(spark, d).unpivot([*KEYS, "yw"], ["dS", "Nmax"], "var", "val")


@query
def prefix_points(spark, d):
    return se.prefix_points(v.series(spark, d), KEYS, ORDER, 100)


@query
def prefix_points_thinned(spark, d):
    return se.prefix_points(v.series(spark, d), KEYS, ORDER, 10)


def _season_ids(spark, d, shift):
    ordered = v.table(spark, d, "orders").select((F.year("o_orderdate") + shift).alias("year"))
    asked = ordered.unionByName(v.ili(spark, d).select((F.col("year") - 1959 + shift).alias("year")))
    there = v.ili(spark, d).select((F.col("year") - 1960).alias("id"))
    return se.season_ids(asked, there)


@joined_query
def season_ids(spark, d):
    return _season_ids(spark, d, 0)


@joined_query
def season_ids_fallback(spark, d):
    return _season_ids(spark, d, 500)


# --- joins --------------------------------------------------------------------------

def _final(spark, d):
    return v.estimates(spark, d, samples=1)


def _results(spark, d):
    return reports.final_results(_final(spark, d), KEYS)


def _summary(spark, d):
    joined = en.trajectories_with_estimate(v.trajectories(spark, d), _results(spark, d), KEYS)
    return en.replicate_summary(joined, KEYS)


def _season_data(spark, d):
    left = en.leftovers(v.trajectories(spark, d), KEYS, HORIZON)
    ensemble = en.ensemble_summary(_summary(spark, d), KEYS)
    return reports.data_agg_leftovers(v.series(spark, d), ensemble, left, KEYS, AFTER_YEAR)


def _crossings(spark, d):
    return reports.crossing_report(_season_data(spark, d), KEYS, ["week", *ORDER])


def _quarters(spark, d):
    joined = reports.estimates_peaks_data(_results(spark, d), v.series(spark, d), KEYS)
    return reports.quarter_crossing(joined, KEYS, ["week", *ORDER])


@joined_query
def fit_vs_data(spark, d):
    return rounded(en.fit_vs_data(v.trajectories(spark, d), v.series(spark, d), KEYS), "val")


@joined_query
def estimates_peaks_data(spark, d):
    joined = reports.estimates_peaks_data(_results(spark, d), v.series(spark, d), KEYS)
    return rounded(joined, "Ntrue", "beta", digits=4)


@joined_query
def trajectories_with_estimate(spark, d):
    joined = en.trajectories_with_estimate(v.trajectories(spark, d), _results(spark, d), KEYS)
    return rounded(joined, "Ntrue", "beta", digits=4)


@joined_query
def data_agg_leftovers(spark, d):
    return rounded(
        _season_data(spark, d), "Ntrue", "m_star_t", "m_star_50_t", "m_peak_t", "m_peak", "m_tot", "m_leftover", digits=4
    )


@query
def available_semi(spark, d):
    chosen = se.valid_products(v.reviews(spark, d), MIN_REVIEWS)
    return join_keys(v.reviews(spark, d), chosen.select("id"), ["id"], "left_semi")


@joined_query
def prefix_range_join(spark, d):
    seen = v.observed(spark, d).select(*KEYS, "step", "I", "R")
    return se.prefix_rows(v.prefixes(spark, d), seen, KEYS)


@query
def key_grid(spark, d):
    bounds = v.ili(spark, d).agg(
        F.min("year").alias("y0"), F.max("year").alias("y1"), F.max(text.region_number("region")).alias("r1")
    )
    return se.key_grid(
        bounds,
        year=F.sequence("y0", "y1"),
        region=F.sequence(F.lit(1), F.col("r1")),
        type=F.array(F.lit("estimates"), F.lit("estimates_true_N")),
    )


@joined_query
def column_append(spark, d):
    peaks = en.stitched_peak(v.prefixes(spark, d), v.observed(spark, d), v.continuations(spark, d), KEYS, SEEDS)
    means = en.mean_over_replicates(peaks, [*KEYS, "t"], ["peak_t", "peak_I"])
    est = v.estimates(spark, d).select(*KEYS, "t", "N", "beta", "m")
    return rounded(en.column_append(est, means, KEYS), "N", "beta", "peak_t", "peak_I", digits=4)


@joined_query
def last_N_lookup(spark, d):
    sizes = fits.last_size(v.estimates(spark, d), KEYS)
    return rounded(join_keys(v.series(spark, d), sizes, KEYS), "N", digits=4)


# --- aggregations -------------------------------------------------------------------

@query
def weekly_counts(spark, d):
    return se.weekly_counts(v.reviews(spark, d))


@query
def valid_products(spark, d):
    return se.valid_products(v.reviews(spark, d), MIN_REVIEWS)


@query
def mean_trajectory(spark, d):
    return rounded(en.mean_trajectory(v.trajectories(spark, d), KEYS), "I")


@joined_query
def replicate_summary(spark, d):
    return rounded(_summary(spark, d), "Ntrue", digits=4)


@joined_query
def ensemble_summary(spark, d):
    return rounded(
        en.ensemble_summary(_summary(spark, d), KEYS),
        "Ntrue", "m_star_t", "m_star_50_t", "m_peak_t", "m_peak", "m_tot", digits=4,
    )


@query
def leftover(spark, d):
    return rounded(en.leftovers(v.trajectories(spark, d), KEYS, HORIZON), "m_leftover")


@query
def observed_peak(spark, d):
    return se.observed_peak(v.series(spark, d), KEYS)


@query
def actual_peak(spark, d):
    return en.actual_peak(v.observed(spark, d), KEYS)


def _replicate_peaks(spark, d):
    return en.stitched_peak(v.prefixes(spark, d), v.observed(spark, d), v.continuations(spark, d), KEYS, SEEDS)


@joined_query
def median_over_replicates(spark, d):
    return rounded(
        en.median_over_replicates(_replicate_peaks(spark, d), [*KEYS, "t"], ["peak_t", "peak_I", "seed"]),
        "peak_t", "peak_I", "seed",
    )


@joined_query
def mean_over_replicates(spark, d):
    return rounded(
        en.mean_over_replicates(_replicate_peaks(spark, d), [*KEYS, "t"], ["peak_t", "peak_I"]), "peak_t", "peak_I"
    )


@query
def final_estimate(spark, d):
    return rounded(fits.final_estimate(v.estimates(spark, d), KEYS), "N", "beta", "llh", digits=4)


@joined_query
def first_crossing(spark, d):
    joined = en.trajectories_with_estimate(v.trajectories(spark, d), _results(spark, d), KEYS)
    cond = F.col("I") + F.col("R") > F.col("m_star")
    high = F.col("I") > F.col("Ntrue") / 50
    return joined.groupBy(*KEYS, "seed").agg(
        se.first_crossing(cond, F.col("t")).alias("m_star_t"),
        se.first_crossing(high, F.col("t"), "null").alias("high_t"),
        se.first_crossing(high, F.col("t"), 52).alias("high_or_52_t"),
    )


@joined_query
def crossing_report(spark, d):
    return _crossings(spark, d)


@joined_query
def quarter_crossing(spark, d):
    return _quarters(spark, d)


@joined_query
def joint_share(spark, d):
    return reports.joint_share(_crossings(spark, d), "m_star_t", "m_peak_t")


@joined_query
def hist_share(spark, d):
    value = F.col("m_peak_t") - F.col("m_star_t")
    return rounded(reports.hist_share(_crossings(spark, d), value), "share")


@joined_query
def hist_m_star_t(spark, d):
    return rounded(reports.hist_share(_crossings(spark, d), F.col("m_star_t")), "share")


@joined_query
def hist_ratio_to_peak(spark, d):
    value = model.ratio(F.col("m_star_t"), F.col("peak_t"))
    return rounded(reports.hist_share(_crossings(spark, d), value, 0.5), "share")


@query
def hist_product_size(spark, d):
    fitted = products.fit_products(v.reviews(spark, d), MIN_REVIEWS)
    return rounded(reports.hist_share(fitted, F.log10("N")), "share")


@joined_query
def season_report(spark, d):
    return surveillance.season_report(v.series(spark, d), _final(spark, d), v.trajectories(spark, d), HORIZON, AFTER_YEAR)


@query
def fit_products(spark, d):
    got = products.fit_products(v.reviews(spark, d), MIN_REVIEWS)
    return rounded(got, "N", "a", "beta", "llh", digits=4)


@joined_query
def median_ratio(spark, d):
    return rounded(reports.median_ratio(_quarters(spark, d), "mstar_t", "const_frac_t"), "median_ratio")


@query
def series_bounds(spark, d):
    return fits.series_bounds(v.observed(spark, d), KEYS)


# --- windows ------------------------------------------------------------------------

@query
def ts_since_first(spark, d):
    return se.since_first(v.reviews(spark, d))


@query
def season_nmax(spark, d):
    return v.series(spark, d)


@query
def running_total(spark, d):
    return se.running_total(v.series(spark, d), KEYS, ORDER)


@query
def lag_diff(spark, d):
    return se.lag_diff(v.trajectories(spark, d), [*KEYS, "seed"], ["t"])


@query
def offset_running_total(spark, d):
    return se.less_group_minimum(se.running_total(v.series(spark, d), KEYS, ORDER), KEYS)


@joined_query
def ecdf(spark, d):
    long = _quarters(spark, d).unpivot(KEYS, ["const_frac_t", "mstar_t"], "var", "val")
    return rounded(reports.ecdf(long, "val", ["var"], whole=True), "ecdf")


@joined_query
def ecdf_by_year(spark, d):
    long = _quarters(spark, d).unpivot(KEYS, ["const_frac_t", "mstar_t"], "var", "val")
    return rounded(reports.ecdf(long, "val", ["year", "var"], whole=True), "ecdf")


@query
def cum_mean(spark, d):
    return rounded(se.running_mean(v.series(spark, d), KEYS, ORDER, "dS", "mean_dS"), "mean_dS")


@query
def share_of_total(spark, d):
    counts = v.series(spark, d).groupBy(*KEYS).agg(F.sum("dS").alias("n"))
    return rounded(reports.share_of_total(counts), "share")


@query
def next_state_pair(spark, d):
    return waiting.next_state_pair(v.states(spark, d), USER).select("user_id", "k", "I", "R", "next_wait")


@query
def lagged_fit_pairs(spark, d):
    return fits.lagged_pairs(v.observed(spark, d), KEYS, ORDER).select(*KEYS, "step", "I", "R", "X")


# --- order, sampling, sets ----------------------------------------------------------

@query
def order_series(spark, d):
    return v.series(spark, d).orderBy("region", "year", "week", "yw")


@query
def sample_products(spark, d):
    return se.sample_rows(se.valid_products(v.reviews(spark, d), MIN_REVIEWS), "id", 100, 42)


@query
def log_spaced_points(spark, d):
    sizes = v.reviews(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("total"))
    return sizes.select("id", "total", F.explode(model.log_spaced(F.col("total"), F.lit(12))).alias("point"))


@query
def region_order(spark, d):
    return v.ili(spark, d).withColumn("rank", text.region_number("region")).orderBy("rank", "year", "week")


@joined_query
def append_runs(spark, d):
    mean = en.mean_trajectory(v.trajectories(spark, d), KEYS).withColumn("dataset", F.lit("predicted"))
    seen = v.observed(spark, d).select(*KEYS, F.col("step").alias("t"), "I").withColumn("dataset", F.lit("actual"))
    return rounded(reduce(DataFrame.unionByName, [mean, seen]), "I")


@query
def drop_empty_runs(spark, d):
    late = v.trajectories(spark, d).where(F.col("t") > HORIZON)
    return late.groupBy(*KEYS, "seed").agg(F.count(F.lit(1)).alias("steps"), F.sum("I").alias("total"))


# --- scalar functions ---------------------------------------------------------------

@query
def to_num(spark, d):
    raw = v.ili_raw(spark, d)
    return text.clean_numbers(raw, ["total_patients", "weighted_ili", "num_of_providers"])


@query
def clean_names(spark, d):
    raw = v.ili_raw(spark, d)
    messy = raw.select(*raw.columns, F.col("weighted_ili")).toDF(
        " WEEK ", "X TOTAL..PATIENTS", "% WEIGHTED ILI", "Num. of  Providers", "%Weighted-ILI"
    )
    return text.clean_names(messy)


@query
def mmwr_week_start(spark, d):
    return v.ili(spark, d).select(
        "region", "year", "week", cal.mmwr_week_start(F.col("year"), F.col("week")).alias("week_start")
    )


@query
def int_div_week(spark, d):
    return v.reviews(spark, d).select("id", "reviewer_id", "ts", cal.whole_weeks(F.col("ts")).alias("week"))


@joined_query
def fisher_bound(spark, d):
    joined = en.trajectories_with_estimate(v.trajectories(spark, d), _results(spark, d), KEYS)
    x = model.cumulative_infected(F.col("I"), F.col("R"))
    bound = model.fisher_bound(F.col("Ntrue"), F.col("beta"), F.col("gamma"), x)
    return joined.select(
        *KEYS, "seed", "t", F.round(bound * F.col("Ntrue") * F.col("Ntrue"), 5).alias("fisher_n2")
    )


@query
def sample_threshold(spark, d):
    return rounded(_results(spark, d), "Ntrue", "beta", digits=4)


@query
def cumulative_infected(spark, d):
    return v.trajectories(spark, d).withColumn("C", model.cumulative_infected(F.col("I"), F.col("R")))


@joined_query
def ratio(spark, d):
    a, b = F.col("m_star_t"), F.col("peak_t")
    return rounded(
        _crossings(spark, d).select(*KEYS, model.ratio(a, b).alias("ratio"), (F.col("m_peak_t") - a).alias("lead")),
        "ratio",
    )


@query
def log10_axis(spark, d):
    logged = _final(spark, d).withColumn("log_n", F.round(F.log10("N"), 6))
    return rounded(reports.ecdf(logged, "log_n"), "ecdf")


@query
def coalesce_default(spark, d):
    lagged = se.lag_diff(v.trajectories(spark, d), [*KEYS, "seed"], ["t"])
    return lagged.select(*KEYS, "seed", "t", F.coalesce(F.col("dS"), F.lit(52.0)).alias("dS"))


@joined_query
def bound_flags(spark, d):
    est = join_keys(v.estimates(spark, d), fits.series_bounds(v.observed(spark, d), KEYS), KEYS)
    ub, lb = model.at_interval_end(F.col("N"), F.col("lower"), F.col("Nmax"))
    return est.select(
        *KEYS, "t", "is_ub_binding", "is_lb_binding", ub.alias("interval_ub"), lb.alias("interval_lb")
    )


# --- state and fits -----------------------------------------------------------------

@query
def state_fold(spark, d):
    folded = se.state_fold(v.series(spark, d), KEYS, ORDER, 0.24).select(*KEYS, "yw", "dS", "I", "R")
    return rounded(folded, "I", "R")


@query
def state_fold_ranges(spark, d):
    folded = folds.state_fold_ranges(v.series(spark, d), KEYS, ORDER, 0.24).select(*KEYS, "yw", "dS", "I", "R")
    return rounded(folded, "I", "R")


@query
def state_fold_full_recovery(spark, d):
    return se.state_fold(v.series(spark, d), KEYS, ORDER, GAMMA).select(*KEYS, "yw", "dS", "I", "R")


@query
def actual_trajectories(spark, d):
    return rounded(se.actual_trajectories(v.series(spark, d), KEYS, ORDER, 0.24), "I", "R")


@joined_query
def poisson_llh(spark, d):
    pairs = join_keys(
        fits.lagged_pairs(v.observed(spark, d), KEYS, ORDER), _final(spark, d).select(*KEYS, "N", "beta"), KEYS
    )
    got = fits.poisson_llh(pairs, KEYS, F.lit(0.0), F.col("beta"), F.col("N"))
    return rounded(got, "llh", digits=4)


@joined_query
def exponential_llh(spark, d):
    pairs = join_keys(
        fits.lagged_pairs(v.observed(spark, d), KEYS, ORDER), _final(spark, d).select(*KEYS, "N", "beta"), KEYS
    )
    got = fits.poisson_llh(pairs, KEYS, F.lit(0.5), F.col("beta"), F.col("N"), form="exponential")
    return rounded(got, "llh", digits=3)


@query
def profile_fit_sir(spark, d):
    return rounded(fits.profile_fit_sir(v.series(spark, d), KEYS, ORDER, GAMMA), "N", "beta", "llh", digits=4)


@joined_query
def profile_fit_sir_refined(spark, d):
    return rounded(v.estimates(spark, d), "N", "beta", "llh", digits=4)


@joined_query
def fit_known_N(spark, d):
    series = v.series(spark, d)
    sizes = fits.last_size(_final(spark, d), KEYS)
    return rounded(fits.fit_known_size(series, sizes, KEYS, ORDER, GAMMA), "N", "beta", "llh", digits=4)


@query
def profile_fit_bass(spark, d):
    got = fits.profile_fit_bass(se.weekly_counts(v.reviews(spark, d)), ["id"], ["week"])
    return rounded(got, "N", "a", "beta", "llh", digits=4)


@query
def profile_fit_bass_refined(spark, d):
    got = fits.refined_fit_bass(se.weekly_counts(v.reviews(spark, d)), ["id"], ["week"])
    return rounded(got, "N", "a", "beta", "llh", digits=4)


@query
def profile_fit_bass_prefixes(spark, d):
    """Every prefix of every season, whose weeks are many; the products have few."""
    got = fits.refined_fit_bass(v.series(spark, d), KEYS, ORDER, samples=100)
    return rounded(got, "N", "a", "beta", "llh", digits=4)


@query
def ecdf_product_size(spark, d):
    """Distribution of the logarithm of the fitted sizes over the products."""
    got = fits.refined_fit_bass(se.weekly_counts(v.reviews(spark, d)), ["id"], ["week"]).where("N IS NOT NULL")
    logs = got.select(F.round(F.log10(F.round("N", 4)), 4).alias("log_n"))
    return rounded(reports.ecdf(logs, "log_n"), "ecdf")


@query
def interarrival_llh(spark, d):
    pairs = waiting.next_state_pair(v.states(spark, d), USER)
    alpha, beta, gamma, size = (F.lit(SIR[p]) for p in ("alpha", "beta", "gamma", "N"))
    scored = waiting.interarrival_llh(pairs, alpha, beta, gamma, size)
    return rounded(scored.select("user_id", "k", "llh"), "llh")


@query
def grid_search_mle(spark, d):
    pairs = waiting.next_state_pair(v.states(spark, d), USER)
    return rounded(waiting.grid_search_mle(pairs, USER, SIR, "beta", points=1000), "estimate", "llh")


@query
def grid_search_gamma(spark, d):
    pairs = waiting.next_state_pair(v.states(spark, d), USER)
    return rounded(waiting.grid_search_mle(pairs, USER, SIR, "gamma", points=1000), "estimate", "llh")


@query
def log_prefix_mle(spark, d):
    pairs = waiting.next_state_pair(v.states(spark, d), USER)
    got = waiting.log_prefix_mle(pairs, USER, SIR, "beta", points=1000)
    return rounded(rounded(got, "estimate"), "llh", digits=2)


@query
def weighted_llh(spark, d):
    got = waiting.weighted_llh(
        v.states(spark, d), USER, F.lit(SIR["alpha"]), F.lit(SIR["gamma"]), F.lit(SIR["N"]), (0.0, 3.0, 1000)
    )
    return rounded(rounded(got, "beta"), "llh", digits=2)


@query
def unweighted_llh(spark, d):
    got = waiting.weighted_llh(
        v.states(spark, d), USER, F.lit(SIR["alpha"]), F.lit(SIR["gamma"]), F.lit(SIR["N"]), (0.0, 3.0, 1000), False
    )
    return rounded(rounded(got, "beta"), "llh", digits=2)


def _weighted_mle(spark, d, **given):
    got = waiting.weighted_mle(v.states(spark, d), USER, **given)
    return rounded(rounded(got, "N", "beta", "a", "gamma", digits=4), "llh", digits=2)


@query
def weighted_mle(spark, d):
    return _weighted_mle(spark, d, a=SIR["alpha"], gamma=SIR["gamma"])


@query
def weighted_mle_free(spark, d):
    """All four parameters free, as where none is given."""
    return _weighted_mle(spark, d, gamma_max=SIR["gamma"] * 10, points={"N": 7, "beta": 7, "a": 5, "gamma": 5})


# --- replicates and peaks -----------------------------------------------------------

@joined_query
def stitched_series(spark, d):
    return en.stitched_series(v.prefixes(spark, d), v.observed(spark, d), v.continuations(spark, d), KEYS, SEEDS)


@joined_query
def stitched_peak(spark, d):
    return _replicate_peaks(spark, d)


@joined_query
def peak_report(spark, d):
    est = v.estimates(spark, d).drop("is_ub_binding", "is_lb_binding")
    got = en.peak_report(est, v.observed(spark, d), v.continuations(spark, d), KEYS, SEEDS)
    return rounded(got, "N", "beta", "llh", "peak_t", "peak_I", "seed", digits=4)


@joined_query
def peak_reports(spark, d):
    """Predicted and actual peaks for both kinds of estimates."""
    fitted = surveillance.fit_seasons(v.ili(spark, d))
    got = surveillance.peak_reports(fitted, v.continuations(spark, d), SEEDS)
    return rounded(got, "N", "beta", "llh", "peak_t", "peak_I", "seed", digits=4)


@query
def take_while_active(spark, d):
    return en.take_while_active(v.trajectories(spark, d), [*KEYS, "seed"], "t", level=1.0)


@query
def index_steps(spark, d):
    steps = v.weekly_visits(spark, d).groupBy(*KEYS, "seed", "week").agg(F.sum("n").alias("I"))
    return en.index_steps(steps, [*KEYS, "seed"], "week")


# --- keys that are NULL -------------------------------------------------------------

def null_key_query(fn: Query) -> None:
    """The query over tables in which region 1 and product 1 have no key: the same rows, with NULL in its place."""

    @wraps(fn)
    def run(spark, folder):
        with v.without_a_key():
            return fn(spark, folder)

    QUERIES[f"{fn.__name__}_null_key"] = run


for _query in (fit_vs_data, estimates_peaks_data, trajectories_with_estimate, data_agg_leftovers, available_semi, prefix_range_join,
               column_append, last_N_lookup, profile_fit_sir_refined, fit_known_N, poisson_llh, stitched_series, stitched_peak, peak_report):
    null_key_query(_query)
