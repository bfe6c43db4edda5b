"""Queries K, D42 and Q24: backtests, trades, costs, ledgers, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import costs as cf
from riskframe.operators import backtest as bt, weights as wt
from riskframe.queries.base import query
from riskframe.queries.weights import MOM, REB, rebalances

PERIODS = f"""{REB}, {MOM}, ds AS (SELECT DISTINCT portfolio_id, ts FROM reb2),
  pe AS (SELECT portfolio_id, ts AS st, coalesce(lead(ts) OVER w, TIMESTAMP '2100-01-01') AS en, lag(ts) OVER w AS pv, row_number() OVER w AS k FROM ds WINDOW w AS (PARTITION BY portfolio_id ORDER BY ts)),
  ch AS (SELECT n.portfolio_id, n.st AS ts, a.symbol, a.weight - coalesce(b.weight, 0) AS change, b.weight AS before FROM pe n JOIN reb2 a ON a.portfolio_id = n.portfolio_id AND a.ts = n.st
    LEFT JOIN reb2 b ON b.portfolio_id = n.portfolio_id AND b.ts = n.pv AND b.symbol = a.symbol),
  tu AS (SELECT portfolio_id, ts, sum(abs(change)) AS turnover FROM ch GROUP BY 1, 2)"""
BT = f"""{PERIODS}, gr AS (SELECT pe.portfolio_id, rets.ts, pe.st, pe.k, sum(weight * ret) AS g FROM pe JOIN rets ON rets.ts >= st AND rets.ts < en
    JOIN reb2 ON reb2.portfolio_id = pe.portfolio_id AND reb2.ts = st AND reb2.symbol = rets.symbol GROUP BY 1, 2, 3, 4),
  nt AS (SELECT gr.portfolio_id, gr.ts, CASE WHEN k > 1 AND gr.ts = st THEN turnover ELSE 0 END AS turnover, g - 0.001 * CASE WHEN k > 1 AND gr.ts = st THEN turnover ELSE 0 END AS ret
    FROM gr JOIN tu ON tu.portfolio_id = gr.portfolio_id AND tu.ts = st)"""


def run(t):
    return bt.vectorised_backtest(rebalances(t), t.returns, benchmark=t.benchmark)


@query("vectorised_backtest", "K1", "portfolio_id:s ts:t ret turnover value bench", "rets bench", f"""
WITH {BT} SELECT portfolio_id, nt.ts, nt.ret, turnover, product(1 + nt.ret) OVER (PARTITION BY portfolio_id ORDER BY nt.ts) AS value, bench.ret AS bench FROM nt JOIN bench USING (ts)""")
def _(t):
    return run(t)


@query("sampled_backtest", "K2", "portfolio_id:s ts:t turnover ret value", "rets", f"""
WITH {PERIODS}, e AS (SELECT ch.portfolio_id, ch.ts, sum(CASE WHEN abs(change) > 0.001 THEN abs(change) ELSE 0 END) AS turnover, coalesce(sum(before * ret), 0) AS ret FROM ch LEFT JOIN rets USING (ts, symbol) GROUP BY 1, 2)
SELECT *, product(1 + ret - 0.001 * turnover) OVER (PARTITION BY portfolio_id ORDER BY ts) AS value FROM e""")
def _(t):
    return bt.sampled_backtest(rebalances(t), t.returns)


@query("weight_trades", "K3", "portfolio_id:s ts:t symbol:s weight_change trade_value:m transaction_cost:m trade_type:s", "rets", f"""
WITH {PERIODS} SELECT portfolio_id, ts, symbol, change AS weight_change, abs(change) * 1e6 AS trade_value, abs(change) * 1e3 AS transaction_cost,
  CASE WHEN change > 0 THEN 'buy' ELSE 'sell' END AS trade_type FROM ch WHERE abs(change) > 0.001""")
def _(t):
    reb = rebalances(t)
    return bt.weight_trades(reb, reb.select("portfolio_id", "ts").distinct().withColumn("value", F.lit(1e6)))


def prices(t):
    return t.weekly("symbol").withColumnRenamed("v", "close")


@query("holdings_trades", "K4 K5", "portfolio_id:s ts:t symbol:s side:s quantity trade_value:m commission:m market_impact:m notes:s")
def _(t):
    return bt.holdings_trades(rebalances(t), prices(t))


@query("trade_costs", "K5", "kind:s n:i commission:m impact:m", "tx", """
SELECT CASE WHEN symbol % 4 = 0 THEN 'bond' WHEN symbol % 4 = 1 THEN 'etf' WHEN symbol % 4 = 2 THEN 'international' ELSE 'equity' END AS kind, count(*) AS n,
  sum(value * CASE symbol % 4 WHEN 0 THEN 0.0005 WHEN 1 THEN 0.0005 WHEN 2 THEN 0.002 ELSE 0.001 END) AS commission,
  sum(value * (0.1 * value / 1e6 + 0.05 * sqrt(value / 1e6) + 0.0001)) AS impact FROM tx GROUP BY 1""")
def _(t):
    m = F.col("symbol") % 4
    kind = F.when(m == 0, "bond").when(m == 1, "etf").when(m == 2, "international").otherwise("equity")
    tx = t.transactions.withColumn("kind", kind)
    return tx.groupBy("kind").agg(F.count("*").alias("n"), F.sum(cf.commission_by_class("value", "kind")).alias("commission"),
                                  F.sum(cf.participation_impact("value")).alias("impact"))


@query("walk_forward", "K6 C11", "portfolio_id:s window_id:i n:i total_return annualized_volatility win_rate max_drawdown", "prets", """
WITH s AS (SELECT min(ts) AS a, max(ts) AS b FROM prets), w AS (SELECT k AS window_id, a + INTERVAL 365 DAY + to_days(180 * k::INT) AS st FROM s, range(0, 100) r(k)
    WHERE a + to_days(365 + 180 + 180 * k::INT) <= b),
  x AS (SELECT portfolio_id, window_id, ts, ret FROM w JOIN prets ON ts >= st AND ts < st + INTERVAL 180 DAY),
  y AS (SELECT *, product(1 + ret) OVER p AS v FROM x WINDOW p AS (PARTITION BY portfolio_id, window_id ORDER BY ts)),
  z AS (SELECT *, v / max(v) OVER (PARTITION BY portfolio_id, window_id ORDER BY ts) - 1 AS d FROM y)
SELECT portfolio_id, window_id, count(*) AS n, product(1 + ret) - 1 AS total_return, stddev_samp(ret) * sqrt(252.0) AS annualized_volatility,
  avg((ret > 0)::INT) AS win_rate, min(d) AS max_drawdown FROM z GROUP BY 1, 2""")
def _(t):
    windows = bt.walk_forward_windows(t.portfolio_returns, 365, 180)
    return bt.walk_forward(t.portfolio_returns, windows)


def BOOT(block: int) -> str:
    per = -(-104 // block)
    return f"""d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM rets)),
  c AS (SELECT sim AS sim_id, b, CAST('0x' || substr(md5('7-' || sim || '-' || b), 1, 8) AS BIGINT) % greatest((SELECT max(n) FROM d) - {block}, 1) AS s FROM range(0, 50) x(sim), range(0, {per}) y(b)),
  o AS (SELECT sim_id, b * {block} + o AS step, s + o AS rn FROM c, range(0, {block}) z(o) WHERE b * {block} + o < 104),
  sm AS (SELECT sim_id, step, symbol, ret FROM o JOIN d USING (rn) JOIN rets USING (ts))"""


@query("block_bootstrap", "K7", "sim_id:i step:i symbol:s ret", "rets", f"WITH {BOOT(20)} SELECT * FROM sm")
def _(t):
    return bt.bootstrap(t.returns, 50, 104)


@query("simulated_distribution", "K7 D42 D43", "portfolio_id:s paths:i mean std min max probability_of_loss median ci_low ci_high", "rets lw", f"""
WITH {BOOT(1)}, f AS (SELECT portfolio_id, sim_id, product(1 + r) AS f FROM (SELECT portfolio_id, sim_id, step, sum(weight * ret) AS r FROM lw JOIN sm USING (symbol) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT portfolio_id, count(*) AS paths, avg(f) AS mean, stddev_pop(f) AS std, min(f) AS min, max(f) AS max, avg((f < 1)::INT) AS probability_of_loss,
  quantile_cont(f, 0.5) AS median, quantile_cont(f, 0.025) AS ci_low, quantile_cont(f, 0.975) AS ci_high FROM f GROUP BY 1""")
def _(t):
    from riskframe.operators.risk import path_statistics
    paths = bt.simulated_paths(bt.bootstrap(t.returns, 50, 104, block=1), t.latest_weights)
    return path_statistics(paths, "portfolio_id")


@query("resampled_weights", "J12", "symbol:s mean_weight std_weight", "rets", f"""
WITH {BOOT(20)}, v AS (SELECT sim_id, symbol, 1 / stddev_samp(ret) AS iv FROM sm GROUP BY 1, 2), w AS (SELECT symbol, iv / sum(iv) OVER (PARTITION BY sim_id) AS weight FROM v)
SELECT symbol, avg(weight) AS mean_weight, stddev_pop(weight) AS std_weight FROM w GROUP BY 1""")
def _(t):
    return wt.resampled_summary(wt.inverse_volatility(bt.bootstrap(t.returns, 50, 104), "sim_id"))


@query("dividend_payments", "K8", "portfolio_id:s symbol:i ts:t dividend_per_share amount:m", "tx", """
WITH e AS (SELECT *, (date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS qe FROM tx),
  h AS (SELECT portfolio_id, symbol, ts, sum(quantity) AS quantity, max(price) AS close FROM e WHERE ts::DATE = qe - (CASE dayofweek(qe) WHEN 0 THEN 2 WHEN 6 THEN 1 ELSE 0 END)::INT GROUP BY 1, 2, 3),
  p AS (SELECT symbol, ts, max(price) AS close FROM tx GROUP BY 1, 2)
SELECT portfolio_id, symbol, ts, p.close * y / 4 AS dividend_per_share, quantity * p.close * y / 4 AS amount FROM h JOIN p USING (symbol, ts)
JOIN (SELECT s_suppkey AS symbol, CASE WHEN s_nationkey % 3 = 0 THEN 0.015 WHEN s_nationkey % 3 = 1 THEN 0.045 ELSE 0.02 END AS y FROM supplier) USING (symbol) WHERE quantity * p.close * y / 4 > 1""")
def _(t):
    n = F.col("s_nationkey") % 3
    sectors = t.read("supplier").select(F.col("s_suppkey").alias("symbol"), F.when(n == 0, "Technology").when(n == 1, "Energy").otherwise("Other").alias("sector"))
    held = t.transactions.groupBy("portfolio_id", "symbol", "ts").agg(F.sum("quantity").alias("quantity"))
    price = t.transactions.groupBy("symbol", "ts").agg(F.max("price").alias("close"))
    return bt.dividends(held, price, sectors)


def orders_table(t):
    return t.transactions.withColumn("volume", 5000 + 50 * F.col("line"))


COST = """o AS (SELECT *, 5000 + 50 * line AS volume, side = 'Buy' AS buy FROM tx),
  i AS (SELECT *, {model} AS raw FROM o), m AS (SELECT *, CASE WHEN buy THEN least(raw, {cap}) ELSE -least(raw, {cap}) END AS market_impact FROM i),
  x AS (SELECT *, price * (CASE WHEN buy THEN 1 + {sp} / 2 ELSE 1 - {sp} / 2 END) * (1 + market_impact) AS execution_price FROM m),
  k AS (SELECT *, greatest(quantity * execution_price * {cr}, 1.0) AS commission2 FROM x)"""


@query("order_costs", "K9 U5", "order_id:i line:i symbol:i market_impact execution_price commission total_cost", "tx", "WITH " + COST.format(
    model="0.001 * sqrt(quantity / volume)", cap="0.01", sp="0.0005", cr="0.001") + """
SELECT order_id, line, symbol, market_impact, execution_price, commission2 AS commission, commission2 + quantity * abs(execution_price - price) AS total_cost FROM k""")
def _(t):
    return bt.cost_table(orders_table(t))


@query("impact_models", "K9 U5", "portfolio_id:s linear square_root advanced", "tx", """
WITH o AS (SELECT portfolio_id, CASE WHEN side = 'Buy' THEN 1 ELSE -1 END AS s, quantity / (5000 + 50 * line) AS p, 0.02 + 0.001 * line AS v, (5000 + 50 * line) / 5200.0 AS rel FROM tx)
SELECT portfolio_id, 1000 * sum(s * least(0.0001 * p, 0.01)) AS linear, sum(s * least(0.001 * sqrt(p), 0.01)) AS square_root,
  sum(s * least(0.001 * sqrt(p) * (1 + 0.5 * (v / 0.02 - 1)) * (1 + 0.3 * (1 / rel - 1)), 0.02)) AS advanced FROM o GROUP BY 1""")
def _(t):
    o = orders_table(t)
    buy = F.col("side") == "Buy"
    extra = {"volatility": 0.02 + 0.001 * F.col("line"), "relative_volume": F.col("volume") / 5200.0}
    return o.groupBy("portfolio_id").agg((1000 * F.sum(cf.impact("linear", "quantity", "volume", buy))).alias("linear"),
                                         F.sum(cf.impact("square_root", "quantity", "volume", buy)).alias("square_root"),
                                         F.sum(cf.impact("advanced", "quantity", "volume", buy, **extra)).alias("advanced"))


@query("cost_scenarios", "K13", "portfolio_id:s scenario:s commission:m total_cost:m cost_ratio", "tx", " UNION ALL ".join(
    "SELECT * FROM (WITH " + COST.format(model=f"{c.impact_coefficient} * sqrt(quantity / volume)", cap="0.02", sp=c.bid_ask_spread, cr=c.commission_rate) +
    f" SELECT portfolio_id, '{name}' AS scenario, sum(commission2) AS commission, sum(commission2 + quantity * abs(execution_price - price)) AS total_cost, "
    "sum(commission2 + quantity * abs(execution_price - price)) / sum(quantity * price) AS cost_ratio FROM k GROUP BY 1)"
    for name, c in cf.COST_SCENARIOS.items()))
def _(t):
    return bt.cost_scenarios(orders_table(t), "portfolio_id")


LEDGER = """f AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id, symbol ORDER BY ts, order_id, line) AS k FROM tx),
  l AS (SELECT portfolio_id, symbol, order_id, line, k, ts, CASE WHEN side = 'Buy' THEN quantity ELSE -quantity END AS position, CASE WHEN side = 'Buy' THEN price ELSE 0.0 END AS average_cost, 0.0::DOUBLE AS realised_pnl FROM f WHERE k = 1
    UNION ALL SELECT f.portfolio_id, f.symbol, f.order_id, f.line, f.k, f.ts, CASE WHEN side = 'Buy' THEN l.position + quantity ELSE l.position - quantity END,
      CASE WHEN side = 'Buy' THEN CASE WHEN l.position + quantity > 0 THEN (l.position * l.average_cost + quantity * price) / (l.position + quantity) ELSE l.average_cost END
        WHEN l.position = quantity THEN 0.0 ELSE l.average_cost END,
      CASE WHEN side = 'Sell' AND l.position > 0 THEN (price - l.average_cost) * quantity ELSE 0.0 END
    FROM l JOIN f ON f.portfolio_id = l.portfolio_id AND f.symbol = l.symbol AND f.k = l.k + 1)"""
ORDER = ("ts", "order_id", "line")


@query("position_ledger", "K10", "portfolio_id:s symbol:i order_id:i line:i position average_cost:m realised_pnl:m", "tx", f"WITH RECURSIVE {LEDGER} SELECT * FROM l")
def _(t):
    return bt.position_ledger(t.transactions, order=ORDER)


def marked(t):
    held = bt.positions(bt.position_ledger(t.transactions, order=ORDER), order=ORDER)
    price = t.transactions.groupBy("symbol").agg(F.avg("price").alias("price"))
    return bt.mark_positions(held, price)


@query("portfolio_nav", "K11 K12", "portfolio_id:s symbol:i quantity average_cost:m realised_pnl:m unrealised_pnl:m market_value:m fills:i nav:m weight", "tx", f"""
WITH RECURSIVE {LEDGER}, p AS (SELECT portfolio_id, symbol, arg_max(position, k) AS quantity, arg_max(average_cost, k) AS average_cost, sum(realised_pnl) AS realised_pnl, count(*) AS fills FROM l GROUP BY 1, 2),
  c AS (SELECT portfolio_id, sum(CASE WHEN side = 'Buy' THEN -(value + commission) ELSE value - commission END) AS cash FROM tx GROUP BY 1),
  v AS (SELECT p.*, price, quantity * price AS market_value FROM p JOIN (SELECT symbol, avg(price) AS price FROM tx GROUP BY 1) USING (symbol)),
  n AS (SELECT *, 5e9 + cash + sum(market_value) OVER (PARTITION BY portfolio_id) AS nav FROM v JOIN c USING (portfolio_id))
SELECT *, (price - average_cost) * quantity AS unrealised_pnl, market_value / nav AS weight FROM n WHERE abs(quantity) > 1e-9""")
def _(t):
    return bt.open_positions(bt.nav_and_weights(marked(t), 5e9))


@query("fill_history", "K12", "portfolio_id:s symbol:i order_id:i line:i ts:t side:s quantity price commission", "tx", """
SELECT portfolio_id, symbol, order_id, line, ts, side, quantity, price, commission FROM tx WHERE ts >= TIMESTAMP '2001-01-01'""")
def _(t):
    return t.transactions.where(F.col("ts") >= F.lit("2001-01-01").cast("timestamp"))


@query("drift_orders", "K14", "portfolio_id:s symbol:s quantity_difference:m side:s", "lw wk rets", """
WITH p AS (SELECT symbol, avg(v) / 1e4 AS price FROM wk GROUP BY 1), lv AS (SELECT portfolio_id, symbol, 1000.0 * weight AS quantity, 1000.0 * weight * price AS mv FROM lw JOIN p USING (symbol)),
  n AS (SELECT *, sum(mv) OVER (PARTITION BY portfolio_id) AS nav, mv / sum(mv) OVER (PARTITION BY portfolio_id) AS w FROM lv),
  t AS (SELECT portfolio_id, symbol, row_number() OVER (PARTITION BY portfolio_id ORDER BY symbol) / 15.0 AS target FROM lw)
SELECT portfolio_id, symbol, target * nav / price - quantity AS quantity_difference, CASE WHEN target * nav / price > quantity THEN 'buy' ELSE 'sell' END AS side
FROM n JOIN t USING (portfolio_id, symbol) JOIN p USING (symbol) WHERE abs(target - w) > 0.05""")
def _(t):
    from riskframe.plans.windows import by, whole
    price = t.weekly("symbol").groupBy("symbol").agg((F.avg("v") / 1e4).alias("price"))
    live = t.latest_weights.join(price, "symbol").select("portfolio_id", "symbol", (1000.0 * F.col("weight")).alias("quantity"),
                                                         (1000.0 * F.col("weight") * F.col("price")).alias("mv"))
    nav = F.sum("mv").over(whole("portfolio_id"))
    live = live.withColumns({"nav": nav, "weight": F.col("mv") / nav})
    targets = t.latest_weights.withColumn("weight", F.row_number().over(by("portfolio_id", "symbol")) / 15.0)
    return bt.drift_orders(live, targets, price)


@query("backtest_validation", "Q24", "portfolio_id:s periods:i total_return annualized_return annualized_volatility sharpe_ratio max_drawdown win_rate", "rets bench", f"""
WITH {BT}, v AS (SELECT *, product(1 + ret) OVER (PARTITION BY portfolio_id ORDER BY ts) AS w FROM nt), x AS (SELECT *, w - max(w) OVER (PARTITION BY portfolio_id ORDER BY ts) AS d FROM v)
SELECT portfolio_id, count(*) AS periods, product(1 + ret) - 1 AS total_return, product(1 + ret) ** (252.0 / count(*)) - 1 AS annualized_return, stddev_samp(ret) * sqrt(252.0) AS annualized_volatility,
  (avg(ret) - 0.02 / 252) / stddev_samp(ret) * sqrt(252.0) AS sharpe_ratio, min(d) AS max_drawdown, avg((ret > 0)::INT) AS win_rate FROM x GROUP BY 1""")
def _(t):
    from riskframe.operators.risk import performance_profile
    return performance_profile(run(t), "portfolio_id")
