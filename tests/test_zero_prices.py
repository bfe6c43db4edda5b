"""Queries over prices of zero against their SQL: infinite and undefined ratios stay in the result."""

import os
import shutil

import pandas as pd
import pytest

from oracle import TABLES, compare, connect
from riskframe.queries import load_all

NAMES = ["simple_returns", "rolling_momentum", "rolling_volatility", "change_over_periods", "consecutive_losses",
         "price_checks", "volume_checks", "source_agreement", "quality_scores", "realised_volatility",
         "realised_bipower", "realised_two_scale", "tick_drawdown", "recommendations"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three users over 40 days, a click and a view each day; zeros alone, in a row, and on the first day; one of wide days."""
    rows = []
    for user, zeros in ((1, {4, 12, 13, 30}), (2, {0, 25}), (3, set())):
        for day in range(40):
            for step, kind in enumerate(("click", "view")):
                price = 0.0 if day in zeros and (step == 1 or day != 30) else round(20 + 7 * ((day * 13 + step * 5 + user) % 11) / 11, 2)
                price *= 1 + 2 * step * (user == 3)
                rows.append((len(rows), pd.Timestamp("2024-01-01") + pd.Timedelta(days=day, hours=step), user, kind, price, '{"k": 1}'))
    path = tmp_path_factory.mktemp("zero_prices")
    frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    frame.astype({"ts": "datetime64[us]"}).to_parquet(path / "events.parquet")
    for table in TABLES:
        if table != "events":
            shutil.copy(f"/root/testdata/sf0.001/{table}.parquet", path)
    return str(path)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_zero_prices(spark, folder, name):
    ok, message, _ = compare(spark, connect(folder), load_all()[name], folder)
    assert ok, message
