"""Registered queries beside their SQL.  The default run takes one query per family on the
smallest tables; BARLOOM_ALL=1 takes all of them."""

import os

import pytest
from check_queries import compare, duck

from barloom.plans import load_all

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()
SAMPLE = [
    "src_01_bars_by_nation",
    "src_02_normalise",
    "src_06_fx_payload",
    "src_10_statement_pivot",
    "src_15_latest_payload",
    "src_16_upsert",
    "snk_01_delimited",
    "prj_09_latest_macro",
    "prj_12_watchlist",
    "joi_01_regressor_join",
    "agg_01_missing",
    "agg_07_exact_quantiles",
    "agg_16_stationarity",
    "win_05_adx",
    "win_20_feature_suite",
    "fea_08_mutual_information",
    "aug_03_time_warp",
    "eva_05_kappa_gmean",
    "eva_12_calibration",
    "scn_06_class_probabilities",
    "bkt_01_cross_backtest",
    "alr_02_alert_run",
    "str_01_streaming_bars",
    "str_04_streaming_rsi",
]
CHOSEN = list(QUERIES) if os.environ.get("BARLOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    ok, message, _ = compare(spark, con, QUERIES[name], ORACLES.get(name), SMALL)
    assert ok, message


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
