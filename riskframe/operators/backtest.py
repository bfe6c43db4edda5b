"""Table-form backtests, trade lists, cost tables, ledgers and resampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import costs as cost_functions
from riskframe.functions import measures as m
from riskframe.operators.align import portfolio_returns, range_join, with_benchmark
from riskframe.operators.weights import cumulative_growth, turnover_steps, weight_timeline
from riskframe.plans.chunked import Chunks
from riskframe.plans.scans import affine_scan
from riskframe.plans.windows import Keys, as_list, by, running, whole


def vectorised_backtest(rebalances: DataFrame, returns: DataFrame, commission: float = 0.001, benchmark: DataFrame | None = None,
                        capital: float = 1.0, keys: Keys = "portfolio_id", ts: str = "ts") -> DataFrame:
    """Hold the weights of each rebalance over the half-open period up to the next one.

    The first date of every period but the first pays commission on the turnover.  Output per portfolio and
    date: ret, turnover, value and, if given, the benchmark.
    """
    keys = as_list(keys)
    held = weight_timeline(returns.select(ts).distinct(), rebalances, ts, keys)
    gross = portfolio_returns(held.drop("rebalance_date"), returns, True, keys, ts)
    first = (held.groupBy(*keys, "rebalance_date").agg(F.min(ts).alias(ts))
             .withColumn("_k", F.row_number().over(by(keys, "rebalance_date"))))
    turnover = turnover_steps(rebalances, keys, ts).groupBy(*keys, F.col(ts).alias("rebalance_date")).agg(
        F.sum(F.abs("change")).alias("turnover"))
    paid = first.where("_k > 1").join(turnover, [*keys, "rebalance_date"]).select(*keys, ts, "turnover")
    net = gross.join(paid, [*keys, ts], "left").na.fill(0.0, ["turnover"])
    net = net.withColumn("ret", F.col("ret") - F.col("turnover") * commission)
    out = net.withColumn("value", capital * cumulative_growth("ret", keys, ts))
    return out if benchmark is None else with_benchmark(out, benchmark, ts)


def sampled_backtest(rebalances: DataFrame, returns: DataFrame, rate: float = 0.001, keys: Keys = "portfolio_id",
                     ts: str = "ts", threshold: float = 0.001) -> DataFrame:
    """Rebalance dates only: the earlier weights earn the date's return, trades above the threshold cost."""
    keys = as_list(keys)
    w = by(keys, ts)
    order = rebalances.select(*keys, ts).distinct().withColumn("_next", F.lead(ts).over(w))
    before = (rebalances.join(order, [*keys, ts]).where("_next IS NOT NULL")
              .select(*keys, F.col("_next").alias(ts), "symbol", "weight"))
    earned = portfolio_returns(before, returns, True, keys, ts)
    change = F.abs("change")
    traded = turnover_steps(rebalances, keys, ts).groupBy(*keys, ts).agg(
        F.sum(F.when(change > threshold, change).otherwise(0.0)).alias("turnover"))
    path = traded.join(earned, [*keys, ts], "left").na.fill(0.0, ["ret"])
    return path.withColumn("value", F.product(1 + F.col("ret") - rate * F.col("turnover")).over(running(keys, ts)))


def weight_trades(rebalances: DataFrame, values: DataFrame, rate: float = 0.001, threshold: float = 0.001,
                  keys: Keys = "portfolio_id", ts: str = "ts") -> DataFrame:
    """Trades from weight changes; ``values`` gives the portfolio value (keys, ts, value) before each rebalance."""
    steps = turnover_steps(rebalances, keys, ts).where(F.abs("change") > threshold)
    value = F.abs("change") * F.col("value")
    return steps.join(values, [*as_list(keys), ts]).select(
        *as_list(keys), ts, "symbol", F.col("change").alias("weight_change"), value.alias("trade_value"),
        (value * rate).alias("transaction_cost"), F.when(F.col("change") > 0, "buy").otherwise("sell").alias("trade_type"))


def holdings_trades(weights: DataFrame, prices: DataFrame, capital: float = 1_000_000.0, keys: Keys = "portfolio_id",
                    ts: str = "ts", change: float = 0.01, smallest: float = 1000.0) -> DataFrame:
    """Trades of a portfolio that starts with cash, builds its positions on the first date and later trades assets
    whose weight moved more than ``change`` if the trade is above ``smallest``.

    Cash and quantities depend on all earlier trades, so the fold is per portfolio; only dates and assets of
    that portfolio's weight table (date grain) reach its task.
    """
    keys = as_list(keys)
    w = by([*keys, "symbol"], ts)
    rows = weights.join(prices.select("symbol", ts, F.col("close").alias("_price")), ["symbol", ts], "left")
    rows = rows.withColumn("_before", F.lag("weight").over(w))
    kinds = {f.name: f.dataType.simpleString() for f in weights.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{ts}` timestamp", "symbol string", "side string", "quantity double",
                        "price double", "trade_value double", "notes string"])

    def fold(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cash, held, out, first = capital, {}, [], True
        for date, day in pdf.sort_values([ts, "symbol"]).groupby(ts, sort=True):
            price = dict(zip(day["symbol"], day["_price"]))
            good = day[(day["_price"] > 0)]
            if first:
                trades = [(s, capital * x, p) for s, x, p in zip(good["symbol"], good["weight"], good["_price"]) if x > 0]
            else:
                moved = good[(good["weight"] - good["_before"]).abs() > change]
                if moved.empty:
                    continue
                worth = cash + sum(q * price[s] for s, q in held.items() if price.get(s, np.nan) > 0)
                trades = [(s, worth * x - held.get(s, 0.0) * p, p) for s, x, p in zip(moved["symbol"], moved["weight"], moved["_price"])]
                trades = [t for t in trades if abs(t[1]) > smallest]
            for symbol, value, p in trades:
                share = abs(value) / cost_functions.DAILY_VOLUME
                impact = abs(value) * (cost_functions.IMPACT_LINEAR * share + cost_functions.IMPACT_ROOT * share ** 0.5 + cost_functions.IMPACT_FIXED)
                held[symbol] = held.get(symbol, 0.0) + value / p
                cash -= value + abs(value) * cost_functions.COMMISSION_RATES["equity"] + impact
                out.append((*group, date, symbol, "Buy" if value > 0 else "Sell", abs(value) / p, p, abs(value),
                            "Initial purchase" if first else "Rebalancing"))
            first = False
        return pd.DataFrame(out, columns=[*keys, ts, "symbol", "side", "quantity", "price", "trade_value", "notes"])

    trades = rows.groupBy(*keys).applyInPandas(fold, schema)
    return trades.withColumns({"commission": F.col("trade_value") * cost_functions.COMMISSION_RATES["equity"],
                               "market_impact": cost_functions.participation_impact("trade_value")})


def walk_forward_windows(dates: DataFrame, train_days: int, test_days: int, ts: str = "ts") -> DataFrame:
    """(window_id, train_start, test_start, test_end) stepping by the test length over the date range."""
    span = dates.agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    step = F.expr(f"INTERVAL {test_days} DAYS")
    train, test = F.expr(f"INTERVAL {train_days} DAYS"), step
    starts = span.where(F.col("_a") + train + test <= F.col("_b")).select(
        F.posexplode(F.sequence(F.col("_a"), F.col("_b") - train - test, step)).alias("window_id", "train_start"))
    return starts.select("window_id", "train_start", (F.col("train_start") + train).alias("test_start"),
                         (F.col("train_start") + train + test).alias("test_end"))


def walk_forward(df: DataFrame, windows: DataFrame, keys: Keys = "portfolio_id", ret: str = "ret", ts: str = "ts") -> DataFrame:
    """One metric row per key and test window, all windows in one plan."""
    from riskframe.operators.risk import drawdown_path
    keys = as_list(keys)
    tests = range_join(windows, df, "test_start", "test_end", None, ts)
    path = drawdown_path(tests, [*keys, "window_id"], ret, ts)
    return path.groupBy(*keys, "window_id").agg(F.count("*").alias("n"), *m.styled_set(ret, "framework", dd="dd_rel"))


def bootstrap(returns: DataFrame, n_sims: int, steps: int, block: int = 20, seed: int = 7, ts: str = "ts") -> DataFrame:
    """Resample whole dates in blocks (block = 1: independent dates): (sim_id, step, symbol, ret).

    The start of each block is a hash of seed, simulation and block number, so any partitioning and any
    recomputed task gives the same sample.
    """
    dates = returns.select(ts).distinct().withColumn("_one", F.lit(1))
    numbered = dates.withColumns({"_rn": F.row_number().over(by("_one", ts)) - 1, "_n": F.count("*").over(whole("_one"))})
    size = numbered.groupBy("_one").agg(F.max("_n").alias("_n"))
    per = -(-steps // block)
    cells = returns.sparkSession.range(n_sims * per).select(
        F.floor(F.col("id") / per).alias("sim_id"), (F.col("id") % per).alias("_b"), F.lit(1).alias("_one"))
    code = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "sim_id", "_b")), 1, 8), 16, 10).cast("bigint")
    starts = cells.join(size, "_one").withColumn("_s", code % F.greatest(F.col("_n") - block, F.lit(1)))
    offsets = starts.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).select(
        "sim_id", (F.col("_b") * block + F.col("_o")).alias("step"), (F.col("_s") + F.col("_o")).alias("_rn")).where(F.col("step") < steps)
    return offsets.join(numbered.select("_rn", ts), "_rn").join(returns, ts).select("sim_id", "step", "symbol", "ret")


def simulated_paths(samples: DataFrame, weights: DataFrame, keys: Keys = "portfolio_id") -> DataFrame:
    """(keys, sim_id, step, ret, value) of constant-weight portfolios over resampled returns."""
    keys = as_list(keys)
    rets = weights.join(samples, "symbol").groupBy(*keys, "sim_id", "step").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    return rets.withColumn("value", cumulative_growth("ret", [*keys, "sim_id"], "step"))


def dividends(holdings: DataFrame, prices: DataFrame, sectors: DataFrame, ts: str = "ts", yields: Mapping[str, float] | None = None,
              smallest: float = 1.0) -> DataFrame:
    """Quarter-end dividends of positive holdings, a weekend quarter end moved back to Friday."""
    table = F.create_map(*[F.lit(x) for pair in (yields or cost_functions.DIVIDEND_YIELDS).items() for x in pair])
    end = F.date_sub(F.add_months(F.date_trunc("quarter", ts), 3), 1)
    back = F.when(F.dayofweek(end) == 1, 2).when(F.dayofweek(end) == 7, 1).otherwise(0)
    due = holdings.where((F.to_date(ts) == F.date_sub(end, back)) & (F.col("quantity") > 0))
    rate = F.coalesce(F.try_element_at(table, F.col("sector")), F.lit(0.02)) / 4
    paid = due.join(sectors, "symbol").join(prices.select("symbol", ts, F.col("close").alias("_p")), ["symbol", ts])
    return paid.withColumns({"dividend_per_share": F.col("_p") * rate, "amount": F.col("quantity") * F.col("_p") * rate}).where(
        F.col("amount") > smallest).drop("_p")


def cost_table(orders: DataFrame, model: str = "square_root", costs: cost_functions.TradingCosts | None = None,
               volume: str = "volume", side: str = "side", **kwargs: Column) -> DataFrame:
    """Execution price, commission and total cost of every order."""
    is_buy = F.lower(side) == "buy"
    return orders.withColumns(cost_functions.execution_columns(
        "quantity", "price", volume, is_buy, costs or cost_functions.TradingCosts(), model, **kwargs))


def cost_scenarios(orders: DataFrame, keys: Keys, scenarios: Mapping[str, cost_functions.TradingCosts] | None = None,
                   model: str = "advanced", volume: str = "volume", side: str = "side") -> DataFrame:
    """Total commission and cost per key and scenario; every scenario is one sum in the same pass."""
    keys = as_list(keys)
    chosen = scenarios or cost_functions.COST_SCENARIOS
    is_buy = F.lower(side) == "buy"
    aggs = []
    for k, c in enumerate(chosen.values()):
        cols = cost_functions.execution_columns("quantity", "price", volume, is_buy, c, model)
        aggs += [F.sum(cols["commission"]).alias(f"_c{k}"), F.sum(cols["total_cost"]).alias(f"_t{k}")]
    wide = orders.groupBy(*keys).agg(F.sum(F.col("quantity") * F.col("price")).alias("traded_value"), *aggs)
    cells = F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(f"_c{k}").alias("commission"), F.col(f"_t{k}").alias("total_cost"))
                      for k, n in enumerate(chosen)])
    long = wide.select(*keys, "traded_value", F.explode(cells).alias("_s")).select(*keys, "traded_value", "_s.*")
    return long.withColumn("cost_ratio", F.try_divide("total_cost", "traded_value"))


def position_ledger(fills: DataFrame, keys: Sequence[str] = ("portfolio_id", "symbol"), order: Sequence[str] = ("ts",),
                    bucket: Column | None = None, chunk_rows: int = 200_000) -> DataFrame:
    """Running quantity, average cost, realised profit and cash flow after each fill.

    Quantities are a prefix sum.  Given the quantity, the average cost follows a first-order recurrence, so
    the ledger of a hot position is cut into chunks like any other scan.
    """
    keys = list(keys)
    rule = F.date_trunc("month", F.col(order[0])) if bucket is None else bucket
    buy = F.lower("side") == "buy"
    signed = F.when(buy, F.col("quantity")).otherwise(-F.col("quantity"))
    chunks = Chunks(keys, order, rule)
    # One scan gives both the quantity and the row number.
    rows = chunks.running(fills.withColumns({"_signed": signed.cast("double"), "_one": F.lit(1.0)}),
                          {"position": ("sum", "_signed"), "_rank": ("sum", "_one")})
    before, after = F.col("position") - F.col("_signed"), F.col("position")
    blended = buy & (after > 0)
    rows = rows.withColumns({
        "_a": F.when(blended, F.try_divide(before, after)).when(~buy & (F.abs(after) < 1e-9), 0.0).otherwise(1.0),
        "_b": F.when(blended, F.try_divide(F.col("quantity") * F.col("price"), after)).otherwise(0.0)})
    scanned = affine_scan(rows, keys, order, "_a", "_b", "_cost", rule, chunk_rows, "_rank")
    realised = F.when(~buy & (before > 0), (F.col("price") - F.col("_cost")) * F.col("quantity")).otherwise(0.0)
    fee = F.col("commission")
    cash = F.when(buy, -(F.col("quantity") * F.col("price") + fee)).otherwise(F.col("quantity") * F.col("price") - fee)
    return scanned.withColumns({"average_cost": F.col("_a") * F.col("_cost") + F.col("_b"), "realised_pnl": realised,
                                "cash_flow": cash}).drop("_signed", "_one", "_rank", "_a", "_b", "_cost")


def positions(ledger: DataFrame, keys: Sequence[str] = ("portfolio_id", "symbol"), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Final quantity and average cost per position with realised profit and cash so far."""
    last = F.struct(*order)
    return ledger.groupBy(*keys).agg(
        F.max_by("position", last).alias("quantity"), F.max_by("average_cost", last).alias("average_cost"),
        F.sum("realised_pnl").alias("realised_pnl"), F.sum("cash_flow").alias("cash_flow"), F.count("*").alias("fills"))


def mark_positions(held: DataFrame, prices: DataFrame) -> DataFrame:
    """Market value and unrealised profit at prices (symbol, price)."""
    return held.join(prices, "symbol").withColumns({
        "market_value": F.col("quantity") * F.col("price"),
        "unrealised_pnl": (F.col("price") - F.col("average_cost")) * F.col("quantity")})


def nav_and_weights(marked: DataFrame, capital: float = 0.0, keys: Keys = "portfolio_id") -> DataFrame:
    """NAV = capital + cash + market value, and live weights."""
    w = whole(keys)
    nav = F.lit(capital) + F.sum("cash_flow").over(w) + F.sum("market_value").over(w)
    return marked.withColumn("nav", nav).withColumn("weight", F.try_divide("market_value", "nav"))


def open_positions(marked: DataFrame) -> DataFrame:
    return marked.where(F.abs("quantity") > 1e-9)


def drift_orders(live: DataFrame, targets: DataFrame, prices: DataFrame, threshold: float = 0.05, keys: Keys = ("portfolio_id", "symbol"),
                 smallest: float = 0.001) -> DataFrame:
    """Orders for assets whose weight is off target by more than the threshold; live(keys, quantity, weight, nav)."""
    keys = as_list(keys)
    group = [k for k in keys if k != "symbol"]
    navs = live.groupBy(*group).agg(F.max("nav").alias("_nav"))
    joined = (targets.select(*keys, F.col("weight").alias("target_weight")).join(live.select(*keys, "quantity", "weight"), keys, "left")
              .na.fill(0.0, ["quantity", "weight"]).join(navs, group).join(prices, "symbol"))
    diff = F.try_divide(F.col("target_weight") * F.col("_nav"), F.col("price")) - F.col("quantity")
    return (joined.where(F.abs(F.col("target_weight") - F.col("weight")) > threshold)
            .withColumn("quantity_difference", diff).where(F.abs("quantity_difference") > smallest)
            .withColumn("side", F.when(F.col("quantity_difference") > 0, "buy").otherwise("sell")).drop("_nav"))
