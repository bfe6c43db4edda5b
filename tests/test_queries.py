"""Registered queries against their SQL on the smallest data set.

RISKFRAME_QUERIES=all runs every query; by default one of each family runs.
"""

import os

import pytest

from oracle import compare, connect
from riskframe.queries import load_all

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["portfolio_profile", "expected_shortfall", "stress_tests", "trade_statistics", "rolling_performance", "exponential_means",
          "drawdown_periods", "realised_bipower", "tick_rolling_mean", "interpolated", "iqr_outliers", "daily_macro", "lookback_windows",
          "daily_payload", "source_failover", "top_assets_or_others", "event_fan_out", "brinson_sectors", "regime_comparison",
          "portfolio_monitor", "hedge_plan", "factor_table", "quality_scores", "distribution_checks", "class_metrics", "weight_timeline",
          "vectorised_backtest", "simulated_distribution", "cost_scenarios", "label_confidence", "stream_bars"]
REGISTRY = load_all()
CHOSEN = list(REGISTRY) if os.environ.get("RISKFRAME_QUERIES") == "all" else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    ok, message, _ = compare(spark, duck, REGISTRY[name], FOLDER)
    assert ok or message == "EMPTY", message


def test_entry_contract():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200
