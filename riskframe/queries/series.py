"""Queries E: windows, indicators, drawdown periods, streaks, regime intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import prep, risk, series
from riskframe.queries.base import query

S, P = "symbol", "portfolio_id"


def w(n: int, key: str = "symbol") -> str:
    return f"(PARTITION BY {key} ORDER BY ts ROWS {n - 1} PRECEDING)"


def bar_returns(t):
    return prep.simple_returns(t.bars)


@query("rolling_volatility", "E1", "symbol:s ts:t volatility", "bret", f"""
SELECT symbol, ts, CASE WHEN count(ret) OVER n = 20 THEN stddev_samp(ret) OVER n * sqrt(252.0) END AS volatility
FROM bret WHERE ret IS NOT NULL WINDOW n AS {w(20)}""")
def _(t):
    return series.rolling_volatility(bar_returns(t))


@query("volume_indicators", "E2", "symbol:s ts:t volume_ma volume_ratio", "bars", f"""
SELECT symbol, ts, CASE WHEN count(*) OVER n = 20 THEN avg(volume) OVER n END AS volume_ma,
  volume / CASE WHEN count(*) OVER n = 20 THEN avg(volume) OVER n END AS volume_ratio FROM bars WINDOW n AS {w(20)}""")
def _(t):
    return series.volume_indicators(t.bars)


@query("moving_averages", "E3", "symbol:s ts:t sma_5 sma_10 sma_20", "bars", f"""
SELECT symbol, ts, CASE WHEN count(*) OVER a = 5 THEN avg(close) OVER a END AS sma_5,
  CASE WHEN count(*) OVER b = 10 THEN avg(close) OVER b END AS sma_10,
  CASE WHEN count(*) OVER c = 20 THEN avg(close) OVER c END AS sma_20 FROM bars
WINDOW a AS {w(5)}, b AS {w(10)}, c AS {w(20)}""")
def _(t):
    return series.sma(t.bars, "close", (5, 10, 20))


@query("exponential_means", "E4", "symbol:s ts:t ema_12 ema_26", "bars", """
WITH r AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars)
SELECT a.symbol, a.ts, sum(b.close * (11.0 / 13) ** (a.k - b.k)) / sum((11.0 / 13) ** (a.k - b.k)) AS ema_12,
  sum(b.close * (25.0 / 27) ** (a.k - b.k)) / sum((25.0 / 27) ** (a.k - b.k)) AS ema_26
FROM r a JOIN r b ON a.symbol = b.symbol AND b.k <= a.k GROUP BY 1, 2""")
def _(t):
    return series.ema(t.bars, "close")


@query("rolling_moments", "E5", "symbol:s ts:t std_20 skew_20 kurt_20", "rets", f"""
SELECT symbol, ts, CASE WHEN count(*) OVER n = 20 THEN stddev_samp(ret) OVER n END AS std_20,
  CASE WHEN count(*) OVER n = 20 THEN skewness(ret) OVER n END AS skew_20,
  CASE WHEN count(*) OVER n = 20 THEN kurtosis(ret) OVER n END AS kurt_20 FROM rets WINDOW n AS {w(20)}""")
def _(t):
    return series.rolling_moments(t.returns, "ret")


@query("relative_strength", "E6", "symbol:s ts:t rsi", "bars", f"""
WITH d AS (SELECT symbol, ts, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) AS d FROM bars),
  g AS (SELECT symbol, ts, count(*) OVER n AS k, avg(greatest(d, 0)) OVER n AS g, avg(greatest(-d, 0)) OVER n AS l
    FROM d WINDOW n AS {w(14)})
SELECT symbol, ts, CASE WHEN k = 14 THEN CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100 END
  ELSE 100 - 100 / (1 + g / l) END END AS rsi FROM g""")
def _(t):
    return series.rsi(t.bars, "close")


@query("bollinger_bands", "E7", "symbol:s ts:t bb_middle bb_upper bb_lower", "bars", f"""
SELECT symbol, ts, m AS bb_middle, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower FROM (
  SELECT symbol, ts, CASE WHEN count(*) OVER n = 20 THEN avg(close) OVER n END AS m, stddev_samp(close) OVER n AS s
  FROM bars WINDOW n AS {w(20)})""")
def _(t):
    return series.bollinger(t.bars, "close")


@query("rolling_momentum", "E8", "symbol:s ts:t momentum_10 momentum_20", "bret", f"""
SELECT symbol, ts, CASE WHEN count(*) OVER a = 10 THEN sum(ret) OVER a END AS momentum_10,
  CASE WHEN count(*) OVER b = 20 THEN sum(ret) OVER b END AS momentum_20 FROM bret WHERE ret IS NOT NULL
WINDOW a AS {w(10)}, b AS {w(20)}""")
def _(t):
    return series.momentum(bar_returns(t), "ret")


@query("volatility_trend", "E9 B8", "series_id:s ts:t vol_sma vol_regime:i", "volr", f"""
SELECT series_id, ts, CASE WHEN count(vol) OVER a = 10 THEN avg(vol) OVER a END AS vol_sma,
  CASE WHEN vol > CASE WHEN count(vol) OVER b = 60 THEN avg(vol) OVER b END THEN 1 ELSE -1 END AS vol_regime FROM volr
WINDOW a AS {w(10, 'series_id')}, b AS {w(60, 'series_id')}""")
def _(t):
    return series.volatility_trend(t.regimes, "vol", keys="series_id")


@query("rolling_correlation", "E10", "portfolio_id:s ts:t correlation", "al", f"""
SELECT portfolio_id, ts, CASE WHEN count(*) OVER n = 30 THEN corr(ret, bench) OVER n END AS correlation FROM al
WINDOW n AS {w(30, P)}""")
def _(t):
    return series.rolling_correlation(t.aligned, "ret", "bench", keys=P)


@query("rolling_performance", "E11", "portfolio_id:s ts:t rolling_return annualized_return rolling_volatility rolling_sharpe "
       "rolling_max_drawdown rolling_var_95", "prets", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY ts) AS k FROM prets),
  x AS (SELECT a.portfolio_id, a.ts, b.ts AS bts, product(1 + b.ret) OVER (PARTITION BY a.portfolio_id, a.ts ORDER BY b.ts) AS w
    FROM r a JOIN r b ON a.portfolio_id = b.portfolio_id AND b.k BETWEEN a.k - 51 AND a.k WHERE a.k >= 52),
  y AS (SELECT *, w - max(w) OVER (PARTITION BY portfolio_id, ts ORDER BY bts) AS dd FROM x),
  z AS (SELECT portfolio_id, ts, min(dd) AS rolling_max_drawdown FROM y GROUP BY 1, 2)
SELECT *, (1 + rolling_return) ** (252.0 / 52) - 1 AS annualized_return FROM (
  SELECT portfolio_id, ts, k, product(1 + ret) OVER n - 1 AS rolling_return, stddev_samp(ret) OVER n * sqrt(252.0) AS rolling_volatility,
    avg(ret) OVER n / stddev_samp(ret) OVER n * sqrt(252.0) AS rolling_sharpe, quantile_cont(ret, 0.05) OVER n AS rolling_var_95
  FROM r WINDOW n AS {w(52, P)}) JOIN z USING (portfolio_id, ts) WHERE k >= 52""")
def _(t):
    return series.rolling_performance(t.portfolio_returns, 52,
                                      metrics=("return", "volatility", "sharpe", "max_drawdown", "var"))


@query("rolling_analysis", "E12", "portfolio_id:s ts:t rolling_return rolling_volatility rolling_sharpe rolling_drawdown", "dd", f"""
SELECT portfolio_id, ts, CASE WHEN k THEN r END AS rolling_return, CASE WHEN k THEN v END AS rolling_volatility,
  CASE WHEN k THEN (r * 252 - 0.02) / v END AS rolling_sharpe, CASE WHEN k THEN w / mx - 1 END AS rolling_drawdown FROM (
  SELECT portfolio_id, ts, w, count(*) OVER n = 52 AS k, product(1 + ret) OVER n - 1 AS r,
    stddev_samp(ret) OVER n * sqrt(252.0) AS v, max(w) OVER n AS mx FROM dd WINDOW n AS {w(52, P)})""")
def _(t):
    return series.rolling_analysis(t.portfolio_returns, 52)


def _block(n: int) -> str:
    c = f"CASE WHEN count(ret) OVER w{n} = {n} THEN"
    p = f"rolling_{n}d"
    return ", ".join(f"{c} {e} END AS {p}_{name}" for name, e in {
        "volatility": f"stddev_samp(ret) OVER w{n}", "realized_vol": f"sqrt(sum(ret * ret) OVER w{n})",
        "mean_return": f"avg(ret) OVER w{n}", "cumulative_return": f"product(1 + ret) OVER w{n} - 1",
        "skewness": f"skewness(ret) OVER w{n}", "kurtosis": f"kurtosis(ret) OVER w{n}",
        "momentum": f"sum(ret) OVER w{n}", "range": f"max(ret) OVER w{n} - min(ret) OVER w{n}",
        "autocorr": f"corr(ret, prev) OVER p{n}"}.items())


FEATURES = [f"rolling_{n}d_{k}" for n in (5, 20) for k in
            ("volatility", "realized_vol", "mean_return", "cumulative_return", "skewness", "kurtosis", "momentum", "range", "autocorr")]


@query("regime_features", "E13", "series_id:s ts:t " + " ".join(FEATURES) + " rolling_5d_mean_reversion rolling_5d_vol_ratio",
       "bench", f"""
WITH b AS (SELECT *, lag(ret) OVER (ORDER BY ts) AS prev FROM bench),
  f AS (SELECT series_id, ts, ret, {_block(5)}, {_block(20)} FROM b WINDOW w5 AS {w(5, 'series_id')}, w20 AS {w(20, 'series_id')},
    p5 AS {w(4, 'series_id')}, p20 AS {w(19, 'series_id')}),
  g AS (SELECT *, CASE WHEN count(rolling_5d_mean_return) OVER w = 5 THEN avg(ret - rolling_5d_mean_return) OVER w END AS rolling_5d_mean_reversion,
    rolling_5d_volatility / CASE WHEN count(rolling_5d_volatility) OVER w = 5 THEN avg(rolling_5d_volatility) OVER w END AS rolling_5d_vol_ratio
    FROM f WINDOW w AS {w(5, 'series_id')})
SELECT series_id, ts, {", ".join(f"coalesce(first({c} IGNORE NULLS) OVER n, 0) AS {c}"
                                 for c in FEATURES + ["rolling_5d_mean_reversion", "rolling_5d_vol_ratio"])}
FROM g WINDOW n AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def _(t):
    return series.regime_features(t.benchmark, (5, 20))


@query("cross_window_features", "E14", "series_id:s ts:t vol_short_long_ratio fear_index volatility_spike:i extreme_return:i",
       "bench", f"""
WITH f AS (SELECT series_id, ts, ret, CASE WHEN count(*) OVER a = 5 THEN stddev_samp(ret) OVER a END AS v5,
    CASE WHEN count(*) OVER b = 20 THEN stddev_samp(ret) OVER b END AS v20,
    CASE WHEN count(*) OVER c = 60 THEN stddev_samp(ret) OVER c END AS v60 FROM bench
    WINDOW a AS {w(5, 'series_id')}, b AS {w(20, 'series_id')}, c AS {w(60, 'series_id')})
SELECT series_id, ts, v5 / v60 AS vol_short_long_ratio,
  v5 / CASE WHEN count(v60) OVER y = 252 THEN avg(v60) OVER y END * 100 AS fear_index,
  coalesce(v5 > 2 * v60, false)::INT AS volatility_spike, coalesce(abs(ret) > 2 * v20, false)::INT AS extreme_return
FROM f WINDOW y AS {w(252, 'series_id')}""")
def _(t):
    return series.regime_features(t.benchmark, fill=False)


@query("cumulative_values", "E15", "symbol:s ts:t cum_product cum_sum running_max", "rets", """
SELECT symbol, ts, product(1 + ret) OVER w AS cum_product, sum(ret) OVER w AS cum_sum, max(ret) OVER w AS running_max
FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(t):
    return series.cumulative(t.returns, "ret", S)


def drawdown_sql(enter: str, leave: str, depth: str, keep: str) -> str:
    return f"""
WITH s AS (SELECT *, last(CASE WHEN {enter} THEN 1 WHEN {leave} THEN 0 END IGNORE NULLS) OVER p AS st FROM dd
    WINDOW p AS (PARTITION BY portfolio_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
  v AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY portfolio_id ORDER BY ts), 0) AS was FROM s),
  i AS (SELECT *, sum(CASE WHEN st = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio_id ORDER BY ts) AS id FROM v)
SELECT portfolio_id, id AS period, min(ts) AS start_date, max(ts) AS end_date,
  (min(w) / arg_min(w, ts) - 1) * {int(depth == 'entry')} + min(dd_rel) * {int(depth != 'entry')} AS max_drawdown,
  date_diff('day', min(ts), max(ts)) AS duration_days, max(CASE WHEN st = 0 THEN 1 ELSE 0 END) = 1 AS recovered
FROM i WHERE st = 1 OR was = 1 GROUP BY 1, 2 {keep}"""


@query("drawdown_periods", "E16", "portfolio_id:s period:i start_date:t end_date:t max_drawdown duration_days:i recovered:b",
       "dd", drawdown_sql("dd_rel <= -0.002", "abs(dd_rel) < 0.001", "entry", ""))
def _(t):
    return series.drawdown_periods(t.portfolio_returns, P, threshold=0.002)


@query("drawdown_periods_closed", "E16", "portfolio_id:s period:i start_date:t end_date:t max_drawdown duration_days:i recovered:b",
       "dd", drawdown_sql("dd_rel <= -0.003", "dd_rel > -0.001", "drawdown", "HAVING max(CASE WHEN st = 0 THEN 1 ELSE 0 END) = 1"))
def _(t):
    return series.drawdown_periods(t.portfolio_returns, P, style="analyzer", threshold=0.003)


STREAKS = """WITH l AS (SELECT {key}, ts, sign(ret)::INT AS s FROM {table}),
  c AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER (PARTITION BY {key} ORDER BY ts) THEN 1 ELSE 0 END AS n FROM l),
  r AS (SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY ts) AS run FROM c),
  g AS (SELECT {key}, run, s, count(*) AS k, max(ts) AS e FROM r GROUP BY 1, 2, 3)"""


@query("win_loss_streaks", "E17", "symbol:s max_win_streak:i max_loss_streak:i current_streak:i", "rets",
       STREAKS.format(key="symbol", table="rets") + """
SELECT symbol, coalesce(max(k) FILTER (s = 1), 0) AS max_win_streak, coalesce(max(k) FILTER (s = -1), 0) AS max_loss_streak,
  arg_max(s * k, e) AS current_streak FROM g GROUP BY 1""")
def _(t):
    return series.win_loss_streaks(t.returns, S)


@query("consecutive_losses", "E18", "symbol:s max_consecutive_losses:i", "bret", STREAKS.format(
    key="symbol", table="(SELECT * FROM bret WHERE ret IS NOT NULL)") + """
SELECT symbol, coalesce(max(k) FILTER (s = -1), 0) AS max_consecutive_losses FROM g GROUP BY 1""")
def _(t):
    return series.max_consecutive_losses(bar_returns(t), S)


@query("regime_change_stats", "E19", "series_id:s from_regime:i to_regime:i count:i avg_return std_return success_rate", "reg", """
SELECT series_id, f AS from_regime, regime AS to_regime, count(*) AS count, avg(ret) AS avg_return,
  stddev_pop(ret) AS std_return, avg((ret > 0)::INT) AS success_rate FROM (
  SELECT *, lag(regime) OVER (PARTITION BY series_id ORDER BY ts) AS f FROM reg) WHERE f <> regime GROUP BY 1, 2, 3""")
def _(t):
    return series.regime_change_stats(t.regimes, "series_id")


@query("regime_intervals", "E20", "series_id:s run:i regime:i start_date:t end_date:t duration:i mean_return total_return "
       "max_drawdown sharpe_ratio", "reg", """
WITH c AS (SELECT *, CASE WHEN regime IS DISTINCT FROM lag(regime) OVER (ORDER BY ts) THEN 1 ELSE 0 END AS n FROM reg),
  r AS (SELECT *, sum(n) OVER (ORDER BY ts) AS run FROM c),
  s AS (SELECT *, sum(ret) OVER (PARTITION BY run ORDER BY ts) AS cs FROM r),
  d AS (SELECT *, cs - max(cs) OVER (PARTITION BY run ORDER BY ts) AS dd FROM s)
SELECT series_id, run, regime, min(ts) AS start_date, max(ts) AS end_date, count(*) AS duration, avg(ret) AS mean_return,
  product(1 + ret) - 1 AS total_return, min(dd) AS max_drawdown,
  CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) ELSE 0 END AS sharpe_ratio FROM d GROUP BY 1, 2, 3""")
def _(t):
    return series.regime_intervals(t.regimes, "series_id", ret="ret")


@query("strategy_ranks", "E21 L29", "strategy:s metric:s value rank:i", "prets", """
SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, strategy) AS rank FROM (
  SELECT portfolio_id AS strategy, 'total_return' AS metric, product(1 + ret) - 1 AS value FROM prets GROUP BY 1 UNION ALL
  SELECT portfolio_id, 'sharpe_ratio', (product(1 + ret) ** (252.0 / count(*)) - 1 - 0.02) / (stddev_samp(ret) * sqrt(252.0))
    FROM prets GROUP BY 1 UNION ALL
  SELECT portfolio_id, 'win_rate', avg((ret > 0)::INT) FROM prets GROUP BY 1)""")
def _(t):
    from riskframe.functions import measures as m
    table = t.portfolio_returns.groupBy(F.col(P).alias("strategy")).agg(
        m.total_return("ret").alias("total_return"), m.sharpe("ret", style="annual").alias("sharpe_ratio"),
        m.win_rate("ret").alias("win_rate"))
    return series.rank_strategies(table, columns=("total_return", "sharpe_ratio", "win_rate"))


@query("series_gaps", "E22", "symbol:s ts:t step_seconds median_seconds", "bars", """
WITH s AS (SELECT symbol, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS step_seconds FROM bars)
SELECT s.*, m AS median_seconds FROM s JOIN (SELECT symbol, quantile_cont(step_seconds, 0.5) AS m FROM s GROUP BY 1) USING (symbol)
WHERE step_seconds > 2 * m""")
def _(t):
    return series.gaps(t.bars)


@query("correlation_breaks", "E23 C7", "ts:t change", "rets", """
WITH full_dates AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rn, count(*) OVER () AS total FROM (
    SELECT ts FROM rets GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM rets))),
  x AS (SELECT a.symbol AS i, b.symbol AS j, f.ts, f.rn, f.total, a.ret AS x, b.ret AS y FROM full_dates f JOIN rets a USING (ts)
    JOIN rets b ON b.ts = f.ts AND a.symbol < b.symbol),
  c AS (SELECT ts, rn, total, abs(corr(x, y) OVER (PARTITION BY i, j ORDER BY rn ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)
    - corr(x, y) OVER (PARTITION BY i, j ORDER BY rn ROWS BETWEEN CURRENT ROW AND 51 FOLLOWING)) AS d FROM x)
SELECT ts, max(d) AS change FROM c WHERE rn >= 52 AND rn < total - 52 GROUP BY 1 HAVING max(d) > 0.3""")
def _(t):
    return series.correlation_breaks(t.returns, n=52)


TICK_RETURNS = """WITH r AS (SELECT symbol, ts, event_id, price / lag(price) OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS r,
    date_trunc('day', ts)::TIMESTAMP AS day FROM ticks), q AS (SELECT *, lag(r) OVER d AS r1, row_number() OVER d AS i FROM r
    WHERE r IS NOT NULL WINDOW d AS (PARTITION BY symbol, day ORDER BY ts, event_id))"""


@query("realised_volatility", "E24", "symbol:s day:t realised", "ticks", TICK_RETURNS + """
SELECT symbol, day, sqrt(252 * sum(r * r)) AS realised FROM q GROUP BY 1, 2""")
def _(t):
    return series.realised_volatility(t.ticks, tie=["event_id"])


@query("realised_bipower", "E24", "symbol:s day:t realised", "ticks", TICK_RETURNS + """
SELECT symbol, day, coalesce(pi() / 2 * 252 * sum(abs(r) * abs(r1)), 0) AS realised FROM q GROUP BY 1, 2""")
def _(t):
    return series.realised_volatility(t.ticks, "bipower", tie=["event_id"])


@query("realised_two_scale", "E24", "symbol:s day:t realised", "ticks", TICK_RETURNS + """
SELECT symbol, day, 252 * CASE WHEN n < 4 THEN total ELSE total - (sub - total) / (n / 2 - 1) END AS realised FROM (
  SELECT symbol, day, count(*) AS n, sum(r * r) AS total, 2 * sum(CASE WHEN i % 2 = 1 THEN r * r END) AS sub FROM q GROUP BY 1, 2)""")
def _(t):
    return series.realised_volatility(t.ticks, "two_scale", tie=["event_id"])


@query("hurst_exponents", "E25", "symbol:s hurst", "rets", """
WITH r AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn,
    count(*) OVER (PARTITION BY symbol) AS n FROM rets),
  k AS (SELECT r.*, k, floor(10 ** (1 + k * (log10(floor(n / 4)) - 1) / 19) + 1e-9)::BIGINT AS scale FROM r, range(0, 20) t(k)),
  w AS (SELECT *, rn // scale AS win FROM k WHERE (rn // scale + 1) * scale <= n),
  d AS (SELECT *, ret - avg(ret) OVER (PARTITION BY symbol, k, win) AS dev FROM w),
  c AS (SELECT *, sum(dev) OVER (PARTITION BY symbol, k, win ORDER BY rn) AS dep FROM d),
  p AS (SELECT symbol, k, scale, win, (max(dep) - min(dep)) / stddev_pop(ret) AS rs FROM c GROUP BY 1, 2, 3, 4),
  s AS (SELECT symbol, k, scale, avg(rs) AS rs FROM p GROUP BY 1, 2, 3)
SELECT symbol, greatest(0.1, least(0.9, regr_slope(ln(rs), ln(scale)))) AS hurst FROM s GROUP BY 1""")
def _(t):
    return series.hurst_exponent(t.returns, S)


@query("tercile_regimes", "E26", "series_id:s ts:t vol regime:i p0 p1 p2", "reg", """
SELECT series_id, ts, vol, regime, CASE WHEN regime = 0 THEN 0.8 ELSE 0.1 END AS p0, CASE WHEN regime = 1 THEN 0.8 ELSE 0.1 END AS p1,
  CASE WHEN regime = 2 THEN 0.8 ELSE 0.1 END AS p2 FROM reg""")
def _(t):
    labelled = series.regime_probabilities(t.regimes)
    return labelled.withColumns({f"p{k}": F.get("probs", F.lit(k)) for k in range(3)})


@query("regime_switches", "E27", "series_id:s ts:t switched:b", "reg", """
SELECT series_id, ts, coalesce(regime <> lag(regime) OVER (ORDER BY ts), true) AS switched FROM reg""")
def _(t):
    return series.regime_switches(t.regimes, "series_id")


@query("tick_drawdown", "E15 D6", "symbol:s ts:t drawdown", "ticks", """
SELECT symbol, ts, price / max(price) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS drawdown
FROM ticks""")
def _(t):
    from riskframe.functions.stats import ieee_ratio
    from riskframe.plans.chunked import Chunks
    chunks = Chunks([S], ["ts", "event_id"], F.date_trunc("day", F.col("ts")))
    return chunks.running(t.ticks, {"_peak": ("max", "price")}).withColumn("drawdown", ieee_ratio("price", "_peak") - 1)


@query("tick_rolling_mean", "E3", "symbol:s ts:t event_id:i mean_20", "ticks", f"""
SELECT symbol, ts, event_id, avg(price) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS 19 PRECEDING) AS mean_20 FROM ticks""")
def _(t):
    from riskframe.plans.chunked import Chunks
    chunks = Chunks([S], ["ts", "event_id"], F.date_trunc("day", F.col("ts")))
    return chunks.rolling(t.ticks.select(S, "ts", "event_id", "price"), 20, {"mean_20": lambda w: F.avg("price").over(w)}, 32)
