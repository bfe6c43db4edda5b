"""Writers of result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

FORMATS = ("parquet", "csv", "json", "orc")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {FORMATS}")
    if fmt == "csv":
        options.setdefault("header", "true")
    df.write.mode(mode).options(**options).format(fmt).save(path)


def write_run(returns: DataFrame, weights: DataFrame, regimes: DataFrame, summary: DataFrame, folder: str) -> None:
    """Return series, weights and regime table as CSV, the run summary as JSON."""
    write_table(returns, f"{folder}/portfolio_returns", "csv")
    write_table(weights, f"{folder}/portfolio_weights", "csv")
    write_table(regimes, f"{folder}/regime_summary", "csv")
    write_table(summary, f"{folder}/summary", "json")


def write_metric_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Current metrics, history, decomposition and stress results as one table each."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", fmt)
