"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from riskframe.queries import load_all
from riskframe.session import build_session

HEADLINE = [
    "portfolio_profile", "portfolio_risk_metrics", "stress_tests", "benchmark_metrics", "trade_statistics",
    "rolling_volatility", "moving_averages", "relative_strength", "rolling_performance", "drawdown_periods",
    "win_loss_streaks", "realised_volatility", "tick_drawdown", "tick_bars", "iqr_outliers", "simple_returns",
    "pair_covariances", "weekly_bars", "latest_quotes", "source_failover", "brinson_sectors", "regime_performance",
    "portfolio_monitor", "hedge_minimum_variance", "factor_table", "single_factor_fit", "vectorised_backtest",
    "order_costs", "block_bootstrap", "quality_scores", "price_checks", "ljung_box", "class_metrics",
    "transition_matrix", "hmm_decoded", "stream_bars",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("riskframe-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    registry = load_all()
    # One query on a small table starts the JVM's code paths and the Python workers.
    registry["risk_return_points"].run(spark, folder).count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
