"""The whole jobs, end to end on the test tables."""

import os

import pytest

from conftest import rows
from epitide.operators import fits
from epitide.plans import products, surveillance
from epitide.plans import views as v

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_products(spark):
    reviews = v.reviews(spark, FOLDER)
    got = products.fit_products(reviews, min_reviews=10, products=20).collect()
    assert len(got) == 20 and all(r.N > r.m - 1 or r.N is None for r in got)
    everything = {r.id: r for r in products.fit_products(reviews, min_reviews=10, products=None).collect()}
    assert len(everything) == 1963
    assert all(everything[r.id].N == r.N for r in got)


def test_seasons_to_reports(spark):
    with v.one_scan():
        fitted = surveillance.fit_seasons(v.ili(spark, FOLDER), samples=10)
        n = fitted.estimates.count()
        assert n == fitted.estimates_true_size.count() == 348
        last = fits.final_estimate(fitted.estimates, v.KEYS)
        again = fits.final_estimate(fitted.estimates_true_size, v.KEYS)
        a, b = (rows(x, "region", "year", "t", "N") for x in (last, again))
        assert a == b
        peaks = surveillance.peak_reports(fitted, v.continuations(spark, FOLDER), v.SEEDS)
        assert peaks.groupBy("type").count().collect()[0]["count"] == 348
        report = surveillance.season_report(fitted.series, last, v.trajectories(spark, FOLDER), 40, 1996)
        assert report.count() == 25
