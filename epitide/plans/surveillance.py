"""Whole jobs: from surveillance weeks to estimates, peaks and crossing reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitide.functions.calendar import mmwr_week_start
from epitide.functions.text import clean_numbers, region_number
from epitide.operators import ensemble as en
from epitide.operators import fits, reports
from epitide.operators.series import season_series
from epitide.schemas import GAMMA, KEYS, MESSY_NUMBERS, ORDER
from epitide.session import cut


def clean_surveillance(raw: DataFrame) -> DataFrame:
    """From the text columns of a download to a typed table.

    Numbers lose their marks and are NULL where none is left, ``week_start`` is the first day of the
    week, and ``region_rank`` orders the regions, the whole country first. Every row stays.
    """
    typed = clean_numbers(raw, MESSY_NUMBERS)
    year, week = (F.trim(F.col(c)).try_cast("int") for c in ("year", "week"))
    rank = F.when(F.col("region") == "National", 0).otherwise(region_number("region"))
    typed = typed.withColumns({"year": year, "week": week, "region_rank": rank})
    return typed.withColumn("week_start", mmwr_week_start(F.col("year"), F.col("week")))


@dataclass
class SeasonFits:
    """Season series with fits of all prefixes, at free and at known size."""

    series: DataFrame
    estimates: DataFrame
    estimates_true_size: DataFrame


def fit_seasons(ili: DataFrame, gamma: float = GAMMA, samples: int = 100) -> SeasonFits:
    """All seasons of all regions in one job.

    The estimates are cut: the refit and every report start from the written table instead
    of repeating the fit.
    """
    series = season_series(ili)
    estimates = cut(fits.refined_fit_sir(series, KEYS, ORDER, gamma, samples), "estimates")
    known = fits.fit_known_size(series, fits.last_size(estimates, KEYS), KEYS, ORDER, gamma, samples)
    return SeasonFits(series, estimates, known)


def peak_reports(fitted: SeasonFits, continuations: DataFrame, seeds: int, gamma: float = GAMMA) -> DataFrame:
    """Predicted and actual peaks for both kinds of estimates."""
    seen = en.observed_states(fitted.series, KEYS, ORDER, gamma)
    shared = fitted.estimates_true_size.columns
    both = [
        en.peak_report(e.select(*shared), seen, continuations, KEYS, seeds).withColumn("type", F.lit(name))
        for name, e in (("estimates", fitted.estimates), ("estimates_true_N", fitted.estimates_true_size))
    ]
    return both[0].unionByName(both[1])


def season_report(series: DataFrame, final: DataFrame, trajectories: DataFrame, horizon: int = 52,
                  after_year: int | None = 2010) -> DataFrame:
    """When did each season become predictable, and when did it peak?"""
    results = reports.final_results(final, KEYS)
    joined = en.trajectories_with_estimate(trajectories, results, KEYS)
    summary = en.ensemble_summary(en.replicate_summary(joined, KEYS), KEYS)
    left = en.leftovers(trajectories, KEYS, horizon)
    data = reports.data_agg_leftovers(series, summary, left, KEYS, after_year)
    return reports.crossing_report(data, KEYS, ["week", *ORDER])
