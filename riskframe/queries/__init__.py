"""Registered queries: one module per operator family, each pairing a Spark query with its SQL."""

from riskframe.queries.base import REGISTRY


def load_all():
    from riskframe.queries import (attribution, backtest, factors, hedge, monitor, prep, quality,  # noqa: F401
                                   regime, risk, series, sources, streams, topk, weights)
    return REGISTRY
