"""Registered queries against their SQL twins (all of them with LOGLOOM_ALL=1)."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import TABLES, compare

from logloom.plans import registry

SF = "/root/testdata/sf0.001"
PICKED = (
    "agg_fl_01", "agg_fl_counters", "agg_fl_13", "agg_gn_01", "rul_fl_all", "rnk_06", "jon_02", "agg_lb_22", "tsr_01", "tsr_06", "hlt_01", "hlt_04",
    "rnk_11_lb", "rul_wf_all", "agg_wf_counters", "rul_ob_all", "agg_ob_counters", "rul_ct_all", "rnk_05", "src_12", "src_13", "src_18", "src_19", "src_20",
    "jon_01", "snk_14", "met_02", "met_06_mean",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _names():
    if not os.environ.get("LOGLOOM_ALL"):
        return PICKED
    return tuple(registry.all_queries())


@pytest.mark.parametrize("name", _names())
def test_matches_sql(spark, con, name):
    text, _, fine = compare(spark, con, name, registry.queries()[name], registry.oracle_sql().get(name), SF)
    assert fine, text


def test_every_query_has_a_twin():
    assert set(registry.queries()) == set(registry.oracle_sql())
