"""The library's input tables, derived from the star-schema test tables.

Each function takes (session, folder of the parquet tables). ``FIXTURES.md`` has the list.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epitide.operators.ensemble import observed_states
from epitide.operators.fits import refined_fit_sir
from epitide.operators.series import prefix_points, season_series
from epitide.operators.spread import join_keys, lay_out, running
from epitide.schemas import GAMMA, KEYS, ORDER
from epitide.session import cut

#: replicates per estimate in the test tables
SEEDS = 5

#: model of the event-level states
SIR = {"alpha": 0.0, "beta": 0.3, "gamma": 0.1, "N": 1000.0}


_no_key: ContextVar[bool] = ContextVar("no_key", default=False)


@contextmanager
def without_a_key():
    """Inside the block the visits of region 1 have no region, and the reviews of product 1 no id."""
    token = _no_key.set(True)
    try:
        yield
    finally:
        _no_key.reset(token)


def _key(column: Column) -> Column:
    return F.nullif(column, F.lit(1).cast("string")) if _no_key.get() else column


_shared: ContextVar[dict[str, DataFrame] | None] = ContextVar("shared", default=None)


@contextmanager
def one_scan():
    """Read the visits once for all tables derived inside the block.

    Left to the optimizer, filters that differ between the branches of a query reach the
    scan, the branches share no exchange, and each scans the visits anew.
    """
    token = _shared.set({})
    try:
        yield
    finally:
        _shared.reset(token)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Event log ``id, reviewer_id, rating, ts``."""
    return table(spark, folder, "lineitem").select(
        _key(F.col("l_partkey").cast("string")).alias("id"),
        F.col("l_suppkey").cast("string").alias("reviewer_id"),
        F.col("l_linenumber").cast("long").alias("rating"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("ts"),
    )


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """One row per patient visit: region number, ISO year and week, provider, result flag.

    The joins carry no hint: small dimension tables are broadcast by size, large ones are
    shuffled, and adaptive execution splits a provider with very many visits.
    """
    line = table(spark, folder, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return line.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(
        _key((F.col("n_regionkey") + 1).cast("string")).cast("int").alias("region"),
        F.expr("extract(YEAROFWEEK FROM l_shipdate)").cast("int").alias("year"),
        F.weekofyear("l_shipdate").cast("int").alias("week"),
        "l_suppkey",
        "l_returnflag",
    )


def weekly_visits(spark: SparkSession, folder: str) -> DataFrame:
    """Visits per region, week, replicate (a fifth of the providers) and result flag.

    Every surveillance table is derived from this small aggregate. Inside :func:`one_scan`
    it is written once and read from there.
    """
    memo = _shared.get()
    if memo is not None:
        if folder not in memo:
            memo[folder] = cut(_weekly_visits(spark, folder), "weekly")
        return memo[folder]
    return _weekly_visits(spark, folder)


def _weekly_visits(spark: SparkSession, folder: str) -> DataFrame:
    seed = (F.col("l_suppkey") % 5 + 1).cast("int").alias("seed")
    return visits(spark, folder).groupBy("region", "year", "week", seed, "l_returnflag").agg(
        F.count(F.lit(1)).alias("n")
    )


def ili(spark: SparkSession, folder: str) -> DataFrame:
    """Surveillance table ``region, year, week, ilitotal, total_patients``."""
    return (
        weekly_visits(spark, folder)
        .groupBy("region", "year", "week")
        .agg(
            F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("n"))), F.lit(0)).alias("ilitotal"),
            F.sum("n").alias("total_patients"),
        )
        .withColumn("region", F.concat(F.lit("Region "), F.col("region").cast("string")))
    )


def ili_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Surveillance figures as they are downloaded: all text, with commas, percents and X."""
    counts = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return counts.select(
        F.col("l_suppkey").cast("string").alias("week"),
        F.format_number(n * 1000, 0).alias("total_patients"),
        F.concat((n % 7).cast("string"), F.lit(" %")).alias("weighted_ili"),
        F.when(n % 5 == 0, F.lit("X")).otherwise(n.cast("string")).alias("num_of_providers"),
    )


def series(spark: SparkSession, folder: str) -> DataFrame:
    """Season series ``region, year, week, yw, dS, Nmax``."""
    return season_series(ili(spark, folder))


def trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """Replicates ``region, year, seed, t, I, R, wait``: weekly visits of a fifth of the providers."""
    weekly = (
        weekly_visits(spark, folder)
        .groupBy("region", "year", "seed", "week")
        .agg(F.sum("n").cast("double").alias("I"))
    )
    placed = F.expr("row_number() OVER (PARTITION BY region, year, seed ORDER BY week)")
    removed = F.expr(
        "coalesce(sum(I) OVER (PARTITION BY region, year, seed ORDER BY week"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D)"
    )
    return weekly.select("region", "year", "seed", placed.alias("t"), "I", removed.alias("R"), F.lit(1.0).alias("wait"))


def estimates(spark: SparkSession, folder: str, samples: int = 100) -> DataFrame:
    """Refined fits of every prefix of every season; ``samples=1``: of whole seasons only."""
    return refined_fit_sir(series(spark, folder), KEYS, ORDER, GAMMA, samples)


def prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """The prefixes ``region, year, t`` that have an estimate, without fitting them."""
    return prefix_points(series(spark, folder), KEYS, ORDER)


def continuations(spark: SparkSession, folder: str) -> DataFrame:
    """What each replicate does after each prefix: ``region, year, t, seed, step, I, R, wait``."""
    runs = trajectories(spark, folder).withColumnRenamed("t", "at")
    pairs = join_keys(prefixes(spark, folder), runs, KEYS).where(F.col("at") > F.col("t"))
    step = F.expr("row_number() OVER (PARTITION BY region, year, t, seed ORDER BY at)")
    return pairs.select(*KEYS, "t", "seed", step.alias("step"), "I", "R", "wait")


def observed(spark: SparkSession, folder: str) -> DataFrame:
    """State of the observed seasons with row position ``step``."""
    return observed_states(series(spark, folder), KEYS, ORDER, GAMMA)


def states(spark: SparkSession, folder: str) -> DataFrame:
    """Event-level states ``user_id, k, I, R, wait`` in ranges (``_part``) of users and time."""
    log = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    removal = F.when(F.col("event_type").isin("error", "signup"), 1).otherwise(0)
    laid = lay_out(
        log.select("user_id", "ts", "event_id", secs.alias("secs"), removal.alias("removal")),
        ["user_id"], ["ts", "event_id"], size=log.count(),
    )
    counted = running(
        laid, ["user_id"], ["ts", "event_id"],
        sums={"k": F.lit(1), "R": F.col("removal")},
        previous={"before": "secs"},
    )
    return cut(
        counted.select(
            "user_id", "k",
            (F.lit(1) + F.col("k") - F.col("R")).cast("double").alias("I"),
            F.col("R").cast("double").alias("R"),
            (F.col("secs") - F.col("before")).cast("double").alias("wait"),
            "_part",
        ),
        "states",
    )
