"""Transaction cost formulas as columns, and the registry of market impact models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.stats import col

#: Commission rate per asset class and impact coefficients of the holdings-based trade list (fixed values).
COMMISSION_RATES = {"equity": 0.001, "bond": 0.0005, "etf": 0.0005, "international": 0.002}
DAILY_VOLUME = 1_000_000.0
IMPACT_LINEAR, IMPACT_ROOT, IMPACT_FIXED = 0.1, 0.05, 0.0001

#: Dividend yield per sector (fixed values).
DIVIDEND_YIELDS = {"Technology": 0.015, "Financials": 0.035, "Healthcare": 0.025, "Consumer": 0.028, "Industrial": 0.022,
                   "Energy": 0.045, "Utilities": 0.040, "Telecom": 0.045, "Bonds": 0.030, "REITs": 0.050}


def commission_by_class(value: Column | str, kind: Column | str) -> Column:
    rates = F.create_map(*[F.lit(x) for pair in COMMISSION_RATES.items() for x in pair])
    return F.abs(col(value)) * F.coalesce(F.try_element_at(rates, col(kind)), F.lit(0.001))


def participation_impact(value: Column | str) -> Column:
    """value * (0.1 p + 0.05 sqrt(p) + 0.0001) with p the share of an assumed daily volume."""
    v = F.abs(col(value))
    p = v / DAILY_VOLUME
    return v * (IMPACT_LINEAR * p + IMPACT_ROOT * F.sqrt(p) + IMPACT_FIXED)


@dataclass(frozen=True)
class TradingCosts:
    commission_rate: float = 0.001
    min_commission: float = 1.0
    bid_ask_spread: float = 0.0005
    impact_coefficient: float = 0.001


#: The three cost levels compared with each other (fixed values).
COST_SCENARIOS = {
    "low_cost": TradingCosts(0.0005, 1.0, 0.0002, 0.00005),
    "moderate_cost": TradingCosts(0.001, 1.0, 0.0005, 0.0001),
    "high_cost": TradingCosts(0.002, 1.0, 0.001, 0.0002),
}

Impact = Callable[..., Column]


def _signed(impact: Column, is_buy: Column, cap: float) -> Column:
    capped = F.least(impact, F.lit(cap))
    return F.when(is_buy, capped).otherwise(-capped)


def linear_impact(participation: Column, is_buy: Column, coefficient: float = 0.0001, **_: Column) -> Column:
    return _signed(coefficient * participation, is_buy, 0.01)


def root_impact(participation: Column, is_buy: Column, coefficient: float = 0.001, **_: Column) -> Column:
    return _signed(coefficient * F.sqrt(participation), is_buy, 0.01)


def advanced_impact(participation: Column, is_buy: Column, coefficient: float = 0.001, volatility: Column | None = None,
                    relative_volume: Column | None = None) -> Column:
    """Root impact scaled by volatility against 2 % and by the inverse of relative volume."""
    vol = F.lit(0.02) if volatility is None else volatility
    rel = F.lit(1.0) if relative_volume is None else relative_volume
    scale = (1 + 0.5 * (vol / 0.02 - 1)) * (1 + 0.3 * (1 / rel - 1))
    return _signed(coefficient * F.sqrt(participation) * scale, is_buy, 0.02)


IMPACT_MODELS: dict[str, Impact] = {"linear": linear_impact, "square_root": root_impact, "advanced": advanced_impact}


def register_impact(name: str, fn: Impact) -> None:
    IMPACT_MODELS[name] = fn


def impact(name: str, quantity: Column | str, volume: Column | str, is_buy: Column, **kwargs) -> Column:
    """Signed relative impact of an order by the model's name; 0 without volume."""
    if name not in IMPACT_MODELS:
        raise ValueError(f"unknown impact model {name!r}; one of {sorted(IMPACT_MODELS)}")
    share = F.try_divide(col(quantity), col(volume))
    return F.when(col(volume) > 0, IMPACT_MODELS[name](share, is_buy, **kwargs)).otherwise(0.0)


def execution_columns(quantity: Column | str, price: Column | str, volume: Column | str, is_buy: Column,
                      costs: TradingCosts = TradingCosts(), model: str = "square_root", **kwargs) -> dict[str, Column]:
    """Execution price after half spread and impact, commission with its minimum, and the total cost."""
    q, p = col(quantity), col(price)
    half = F.when(is_buy, 1 + costs.bid_ask_spread / 2).otherwise(1 - costs.bid_ask_spread / 2)
    move = impact(model, q, volume, is_buy, coefficient=costs.impact_coefficient, **kwargs)
    done = p * half * (1 + move)
    commission = F.greatest(q * done * costs.commission_rate, F.lit(costs.min_commission))
    return {"market_impact": move, "execution_price": done, "commission": commission,
            "total_cost": commission + q * F.abs(done - p)}
