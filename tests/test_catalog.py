"""Registered queries against their checking SQL on the given tables."""

import os

import pytest
from check_oracles import compare, connect

from quantloom.catalog import load

SF = os.environ.get("QUANTLOOM_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = load()
CHECKED = ["s02_wide_price_scan", "s09_series_payload", "j01_asof_fundamentals", "j10_combine_first", "w05_percent_rank", "w16_rolling_cvar",
           "f01_equity_features", "f06_composite_score", "a13_rank_correlation", "q00_momentum_slice", "o20_metric_pack", "o17_carry_forward",
           "r08_stress_windows", "r10_composite_regimes", "r16b_monte_carlo_factor", "r17_gev_tail", "b02_metric_intervals", "b05_block_length",
           "m01b_expanding_gram", "m04_ledoit_wolf", "m09_macro_views", "h08_overlay_backtest", "x09_overfitting_probability", "q10_anchor_table"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()) == ""


@pytest.mark.parametrize("name", ["m01_elastic_net_forecast", "o02_mean_variance", "r14_rolling_forecast"])
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
