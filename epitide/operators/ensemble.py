"""Replicate trajectories: summaries, stitching to observed data, peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epitide.operators.series import first_crossing, prefix_rows, state_fold, with_position
from epitide.operators.spread import join_keys


# --- summaries over replicates ------------------------------------------------------

def mean_trajectory(trajectories: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean number of infected per step over all replicates."""
    return trajectories.groupBy(*keys, "t").agg(F.avg("I").alias("I"))


def fit_vs_data(trajectories: DataFrame, series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean trajectory next to the observed counts, in long form ``week, var, val``."""
    mean = mean_trajectory(trajectories, keys).withColumnRenamed("t", "week")
    wide = join_keys(mean, series, [*keys, "week"]).select("week", "dS", "I", *keys)
    return wide.unpivot([*keys, "week"], ["dS", "I"], "var", "val")


def trajectories_with_estimate(trajectories: DataFrame, final: DataFrame, keys: Sequence[str]) -> DataFrame:
    return join_keys(trajectories, final, keys)


def replicate_summary(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per replicate: steps at which the thresholds are crossed, peak and total.

    ``joined`` has trajectories with ``Ntrue, m_star, m_star_50`` of their series.
    """
    infected = F.col("I") + F.col("R")
    first_top = F.struct(F.col("I"), -F.col("t"))
    return joined.groupBy(*keys, "Ntrue", "m_star", "m_star_50", "seed").agg(
        first_crossing(infected > F.col("m_star"), F.col("t")).alias("m_star_t"),
        first_crossing(infected > F.col("m_star_50"), F.col("t")).alias("m_star_50_t"),
        F.max_by("t", first_top).alias("m_peak_t"),
        F.max_by(infected, first_top).alias("m_peak"),
        F.sum("I").alias("m_tot"),
    )


def ensemble_summary(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means of :func:`replicate_summary` over the replicates."""
    figures = ["m_star_t", "m_star_50_t", "m_peak_t", "m_peak", "m_tot"]
    return summary.groupBy(*keys, "Ntrue", "m_star", "m_star_50").agg(*[F.avg(c).alias(c) for c in figures])


def leftovers(trajectories: DataFrame, keys: Sequence[str], horizon: int = 52, year: str = "year") -> DataFrame:
    """Infected beyond the horizon, mean over the replicates that get there, for the next season."""
    late = trajectories.where(F.col("t") > horizon)
    per_seed = late.groupBy(*keys, "seed").agg(F.sum("I").alias("n"))
    return per_seed.groupBy(*keys).agg(F.avg("n").alias("m_leftover")).withColumn(year, F.col(year) + 1)


def median_over_replicates(peaks: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact medians over the replicates of a key, of which there are no more than seeds."""
    return peaks.groupBy(*keys).agg(*[F.median(F.col(c).cast("double")).alias(c) for c in columns])


def mean_over_replicates(peaks: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return peaks.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


# --- replicates as sequences of steps -----------------------------------------------

def take_while_active(steps: DataFrame, keys: Sequence[str], order: str = "t", level: float = 1.0) -> DataFrame:
    """Keep each trajectory up to, not including, its first step with ``I <= level``.

    One row per step of a simulated season, so a trajectory is as short as the season.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.max(F.when(F.col("I") <= level, 1).otherwise(0)).over(upto)
    return steps.withColumn("_ended", ended).where("_ended = 0").drop("_ended")


def index_steps(steps: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Number the steps of each replicate from 1."""
    return with_position(steps, keys, [order], "t")


# --- observed prefix followed by a replicate ----------------------------------------

def _with_seeds(estimates: DataFrame, seeds: int) -> DataFrame:
    """Rows of estimates for every seed ``1..seeds``: a replicate may be empty and still counts."""
    return estimates.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))


def stitched_series(
    estimates: DataFrame, observed: DataFrame, continuations: DataFrame, keys: Sequence[str], seeds: int
) -> DataFrame:
    """Observed ``I`` up to ``t``, then the replicate's, with time counted on.

    estimates      keys, t
    observed       keys, step, I
    continuations  keys, t, seed, step (from 1), I, wait
    """
    head = _with_seeds(prefix_rows(estimates.select(*keys, "t"), observed.select(*keys, "step", "I"), keys), seeds)
    head = head.select(*keys, "t", "seed", "step", F.col("step").cast("double").alias("clock"), F.col("I").cast("double").alias("I"))
    along = (
        Window.partitionBy(*keys, "t", "seed").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    tail = continuations.select(
        *keys, "t", "seed",
        (F.col("t") + F.col("step")).alias("step"),
        (F.col("t") + F.sum("wait").over(along)).cast("double").alias("clock"),
        F.col("I").cast("double").alias("I"),
    )
    return head.unionByName(tail)


def stitched_peak(
    estimates: DataFrame, observed: DataFrame, continuations: DataFrame, keys: Sequence[str], seeds: int
) -> DataFrame:
    """First maximum of every stitched series: ``peak_t, peak_I`` per keys, t, seed.

    The observed part is the same for every seed, so its maximum is found once per prefix
    with a running first-maximum; the stitched rows are never laid out.
    """
    along = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.max(F.struct(F.col("I").cast("double").alias("I"), (-F.col("step")).cast("long").alias("back"))).over(along)
    head = observed.select(*keys, F.col("step").alias("t"), top.alias("_head"))

    steps = Window.partitionBy(*keys, "t", "seed").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = continuations.withColumn("_at", F.sum("wait").over(steps))
    tail = timed.groupBy(*keys, "t", "seed").agg(
        F.max(
            F.struct(F.col("I").cast("double").alias("I"), (-F.col("step")).cast("long").alias("back"), F.col("_at").alias("clock"))
        ).alias("_tail")
    )
    both = join_keys(
        join_keys(_with_seeds(estimates.select(*keys, "t"), seeds), head, [*keys, "t"]), tail, [*keys, "t", "seed"], "left"
    )
    from_tail = F.coalesce(F.col("_tail.I") > F.col("_head.I"), F.lit(False))
    return both.select(
        *keys, "t", "seed",
        F.when(from_tail, F.col("t") + F.col("_tail.clock")).otherwise(-F.col("_head.back")).cast("double").alias("peak_t"),
        F.when(from_tail, F.col("_tail.I")).otherwise(F.col("_head.I")).alias("peak_I"),
    )


def actual_peak(states: DataFrame, keys: Sequence[str], position: str = "step") -> DataFrame:
    """Largest ``I`` of each series and its position from 1, the first among equals."""
    return states.groupBy(*keys).agg(
        F.max("I").alias("actual_peak_I"),
        F.max_by(position, F.struct(F.col("I"), -F.col(position))).alias("actual_peak_t"),
    )


def observed_states(series: DataFrame, keys: Sequence[str], order: Sequence[str], gamma: float) -> DataFrame:
    """State series with the row position in ``step``."""
    return with_position(state_fold(series, keys, order, gamma), keys, order, "step")


def column_append(estimates: DataFrame, peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put peak columns next to the estimates they belong to, by key and prefix length."""
    return join_keys(estimates, peaks, [*keys, "t"])


def peak_report(
    estimates: DataFrame, observed: DataFrame, continuations: DataFrame, keys: Sequence[str], seeds: int
) -> DataFrame:
    """Estimates with the median predicted peak over replicates and the actual peak."""
    peaks = stitched_peak(estimates, observed, continuations, keys, seeds)
    medians = median_over_replicates(peaks, [*keys, "t"], ["peak_t", "peak_I", "seed"])
    return join_keys(column_append(estimates, medians, keys), actual_peak(observed, keys), keys)
