"""Whole job: from the event log to Bass fits of sampled products."""

from __future__ import annotations

from pyspark.sql import DataFrame

from epitide.operators import fits
from epitide.operators.series import sample_rows, valid_products, weekly_counts
from epitide.operators.spread import join_keys


def fit_products(events: DataFrame, min_reviews: int = 100, products: int | None = 100, seed: int = 42) -> DataFrame:
    """Bass fits of the qualifying products, or of a sample of them, in one job.

    The sample (at most ``products`` ids) is small by its own definition and joins as a
    semi join; the log is filtered before anything is counted per week.
    """
    chosen = valid_products(events, min_reviews)
    if products is not None:
        chosen = sample_rows(chosen, "id", products, seed)
    kept = join_keys(events, chosen.select("id"), ["id"], "left_semi")
    return fits.profile_fit_bass(weekly_counts(kept), ["id"], ["week"])
