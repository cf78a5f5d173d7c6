"""Registered queries against their SQL at the smallest scale.

All of them with EPITIDE_ALL=1, otherwise one or two per area.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from epitide.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
SOME = ["scan_skip_preamble", "keys_from_path", "write_by_key", "param_query", "season_rekey", "prefix_points_thinned",
        "season_ids", "prefix_range_join", "weekly_counts", "valid_products", "median_over_replicates", "lag_diff",
        "sample_products", "to_num", "state_fold", "state_fold_ranges", "profile_fit_sir", "profile_fit_bass", "grid_search_mle", "peak_report"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("EPITIDE_ALL") else SOME)
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name, queries()[name], oracle_sql()[name]).startswith("ok")


def test_every_query_has_a_check():
    assert set(QUERIES) <= set(queries()) & set(oracle_sql())


def test_entry(spark):
    assert entry(spark).columns == ["id", "week", "dS", "Nmax"]
