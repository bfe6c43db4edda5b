"""riskframe: portfolio, risk and market-regime analytics on Spark DataFrames."""

from riskframe.session import build_session, cut_lineage, ship_package

__all__ = ["build_session", "cut_lineage", "ship_package"]
