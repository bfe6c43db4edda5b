"""Queries B and C: preparation and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.adapters import MACRO_NAMES
from riskframe.operators import align, prep, risk, series
from riskframe.queries.base import query
from riskframe.sources.readers import macro_wide, news_by_date, sentiment_by_date

S, P = "symbol", "portfolio_id"


@query("simple_returns", "B1", "symbol:s ts:t ret", "bret", "SELECT symbol, ts, ret FROM bret WHERE ret IS NOT NULL")
def _(t):
    return prep.simple_returns(t.bars)


@query("change_over_periods", "B2", "symbol:s ts:t change", "bars", """
SELECT symbol, ts, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS change FROM bars""")
def _(t):
    return prep.change_over(t.bars, 20)


@query("close_prices", "B3", "symbol:s ts:t close", "bars", "SELECT symbol, ts, close FROM bars")
def _(t):
    return t.bars.select("symbol", "ts", "close")


@query("cross_section_means", "B4", "ts:t mean_close mean_volume n:i", "bars", """
SELECT ts, avg(close) AS mean_close, avg(volume) AS mean_volume, count(*) AS n FROM bars GROUP BY 1""")
def _(t):
    means = prep.cross_section_mean(t.bars, {"mean_close": "close", "mean_volume": "volume"})
    return means.join(t.bars.groupBy("ts").agg(F.count("*").alias("n")), "ts")


@query("daily_macro", "B5 C15", "code:s ts:t value", "macrow", """
WITH m AS (SELECT ts, 'T10' AS code, t10 AS value FROM macrow UNION ALL SELECT ts, 'T02', t02 FROM macrow
    UNION ALL SELECT ts, 'IND', ind FROM macrow),
  d AS (SELECT code, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM m GROUP BY 1)
SELECT d.code, d.ts, m.value FROM d ASOF JOIN m ON d.code = m.code AND d.ts >= m.ts""")
def _(t):
    return prep.to_daily(t.macro, "code", ["value"])


@query("tick_bars", "B5b", "symbol:s ts:t open high low close volume:i", "ticks", """
SELECT symbol, time_bucket(INTERVAL 6 HOUR, ts)::TIMESTAMP AS ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high,
  min(price) AS low, last(price ORDER BY ts, event_id) AS close, sum(size) AS volume FROM ticks GROUP BY 1, 2""".replace(
    " AS ts, first", " AS b, first").replace("SELECT symbol, time_bucket", "SELECT symbol, b AS ts, open, high, low, close, volume FROM (SELECT symbol, time_bucket")
       + ")")
def _(t):
    return prep.ohlcv_bars(t.ticks, "6 hours", tie="event_id")


@query("weekly_bars", "B5b A6", "symbol:s ts:t open high low close volume:i", "bars", """
SELECT symbol, wk AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close,
  sum(volume) AS volume FROM (SELECT *, date_trunc('week', ts)::TIMESTAMP AS wk FROM bars) GROUP BY 1, 2""")
def _(t):
    return prep.coarser_bars(t.bars, "week")


UNIFIED = """WITH p AS (SELECT date_trunc('month', ts)::TIMESTAMP AS ts, avg(ret) AS market FROM bench GROUP BY 1),
  s AS (SELECT ts, avg(greatest(-1, least(1, 100 * ret))) AS sentiment FROM panel GROUP BY 1),
  n AS (SELECT ts, avg(cap) AS news_volume, avg(bm) AS news_sentiment FROM panel GROUP BY 1),
  j AS (SELECT ts, market, t10, t02, sentiment, news_volume, news_sentiment FROM p FULL JOIN macrow USING (ts)
    FULL JOIN s USING (ts) FULL JOIN n USING (ts)),
  f AS (SELECT ts, """ + ", ".join(
    f"last({c} IGNORE NULLS) OVER (ORDER BY ts) AS {c}" for c in
    ("market", "t10", "t02", "sentiment", "news_volume", "news_sentiment")) + """ FROM j)
SELECT * FROM f WHERE market IS NOT NULL AND t10 IS NOT NULL AND t02 IS NOT NULL AND sentiment IS NOT NULL
  AND news_volume IS NOT NULL AND news_sentiment IS NOT NULL"""


@query("unified_features", "B6 C3 A16 A17", "ts:t market t10 t02 sentiment news_volume:m news_sentiment", "bench panel macrow", UNIFIED)
def _(t):
    prices = t.benchmark.groupBy(F.date_trunc("month", "ts").alias("_m")).agg(F.avg("ret").alias("market"))
    macro = macro_wide(t.macro, {"T10": "t10", "T02": "t02"})
    sentiment = sentiment_by_date(t.panel.withColumn("sentiment", 100 * F.col("ret")))
    news = news_by_date(t.panel, "cap", "bm")
    return prep.unified_features(prices.withColumnRenamed("_m", "ts"), macro, sentiment, news)


@query("yield_spread", "B7", "ts:t spread", "macrow", "SELECT ts, t10 - t02 AS spread FROM macrow")
def _(t):
    wide = macro_wide(t.macro, MACRO_NAMES)
    return wide.withColumn("spread", F.col("treasury_10y") - F.col("treasury_2y"))


@query("trend_flags", "B8", "series_id:s ts:t risk_sentiment:i yield_curve_regime:i vol_regime:i", "volr", """
SELECT series_id, ts, CASE WHEN abs(ret) > CASE WHEN count(*) OVER w = 60 THEN avg(abs(ret)) OVER w END THEN -1 ELSE 1 END AS risk_sentiment,
  CASE WHEN ret > 0 THEN 1 ELSE -1 END AS yield_curve_regime,
  CASE WHEN vol > CASE WHEN count(vol) OVER w = 60 THEN avg(vol) OVER w END THEN 1 ELSE -1 END AS vol_regime
FROM volr WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS 59 PRECEDING)""")
def _(t):
    return prep.trend_flags(t.regimes.withColumn("fear", F.abs("ret")), "series_id", "fear", "ret", "vol")


HOLES = """WITH g AS (SELECT symbol, ts, CASE WHEN day(ts) % 4 = 0 OR day(ts) > 27 OR day(ts) < 3 THEN NULL ELSE close END AS close,
    row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars)"""


def with_holes(t):
    d = F.dayofmonth("ts")
    return t.bars.withColumn("close", F.when((d % 4 == 0) | (d > 27) | (d < 3), None).otherwise(F.col("close")))


@query("forward_fill", "B9", "symbol:s ts:t close", "bars", HOLES + """
SELECT symbol, ts, coalesce(last(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts),
  first(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM g""")
def _(t):
    return prep.forward_fill(with_holes(t), ["close"], back=True)


@query("interpolated", "B10", "symbol:s ts:t close", "bars", HOLES + """,
  n AS (SELECT *, max(CASE WHEN close IS NOT NULL THEN k END) OVER (PARTITION BY symbol ORDER BY k) AS a,
    min(CASE WHEN close IS NOT NULL THEN k END) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g)
SELECT n.symbol, n.ts, coalesce(n.close, x.close + (y.close - x.close) * (n.k - a) / (b - a), x.close, y.close) AS close FROM n
LEFT JOIN g x ON x.symbol = n.symbol AND x.k = n.a LEFT JOIN g y ON y.symbol = n.symbol AND y.k = n.b""")
def _(t):
    return prep.interpolate(with_holes(t), "close")


IQR = """WITH q AS (SELECT symbol, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM ticks GROUP BY 1)"""


@query("iqr_outliers", "B11", "symbol:s event_id:i price is_outlier:b", "ticks", IQR + """
SELECT symbol, event_id, price, price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a) AS is_outlier FROM ticks JOIN q USING (symbol)""")
def _(t):
    return prep.iqr_outliers(t.ticks, "price", long_groups=True)


@query("zscore_outliers", "B12", "symbol:s event_id:i price is_outlier:b", "ticks", """
SELECT symbol, event_id, price, coalesce(abs((price - m) / nullif(s, 0)) > 3, false) AS is_outlier FROM ticks
JOIN (SELECT symbol, avg(price) AS m, stddev_samp(price) AS s FROM ticks GROUP BY 1) USING (symbol)""")
def _(t):
    return prep.zscore_outliers(t.ticks, "price")


@query("winsorised", "B13", "symbol:s event_id:i price", "ticks", """
SELECT symbol, event_id, greatest(a, least(b, price)) AS price FROM ticks
JOIN (SELECT symbol, quantile_cont(price, 0.01) AS a, quantile_cont(price, 0.99) AS b FROM ticks GROUP BY 1) USING (symbol)""")
def _(t):
    return prep.winsorise(t.ticks, "price", long_groups=True)


ZFLAG = """WITH z AS (SELECT r.*, coalesce(abs((ret - m) / nullif(s, 0)) > {z}, false) AS bad FROM {table} r
    JOIN (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS s FROM {table} GROUP BY 1) USING (symbol))"""


@query("outlier_dates_dropped", "B14", "symbol:s ts:t ret", "rets", ZFLAG.format(z=2, table="rets") + """
SELECT symbol, ts, ret FROM z WHERE ts NOT IN (SELECT ts FROM z WHERE bad)""")
def _(t):
    return prep.drop_outlier_dates(prep.zscore_outliers(t.returns, "ret", threshold=2.0))


@query("outliers_interpolated", "B15", "symbol:s ts:t ret", "rets", ZFLAG.format(z=2, table="rets") + """,
  g AS (SELECT symbol, ts, CASE WHEN NOT bad THEN ret END AS ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM z),
  n AS (SELECT *, max(CASE WHEN ret IS NOT NULL THEN k END) OVER (PARTITION BY symbol ORDER BY k) AS a,
    min(CASE WHEN ret IS NOT NULL THEN k END) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g)
SELECT n.symbol, n.ts, coalesce(n.ret, x.ret + (y.ret - x.ret) * (n.k - a) / (b - a), x.ret, y.ret) AS ret FROM n
LEFT JOIN g x ON x.symbol = n.symbol AND x.k = n.a LEFT JOIN g y ON y.symbol = n.symbol AND y.k = n.b""")
def _(t):
    return prep.interpolate_outliers(prep.zscore_outliers(t.returns, "ret", threshold=2.0), "ret")


@query("scaled_features", "B16", "symbol:s ts:t standard robust", "rets", """
SELECT symbol, ts, (ret - m) / s AS standard, (ret - md) / iq AS robust FROM rets JOIN (
  SELECT symbol, avg(ret) AS m, stddev_pop(ret) AS s, quantile_cont(ret, 0.5) AS md,
    quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25) AS iq FROM rets GROUP BY 1) USING (symbol)""")
def _(t):
    r = t.returns
    out = prep.apply_scaler(r, prep.fit_scaler(r, "ret"), "ret", out="standard")
    return prep.apply_scaler(out, prep.fit_scaler(r, "ret", kind="robust"), "ret", out="robust")


@query("lag_features", "B17", "symbol:s ts:t ret ret_lag_1 ret_lag_2 ret_lag_3 ret_lag_5 ret_lag_10", "rets", """
SELECT * FROM (SELECT symbol, ts, ret, """ + ", ".join(f"lag(ret, {k}) OVER w AS ret_lag_{k}" for k in (1, 2, 3, 5, 10)) + """
FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE ret_lag_10 IS NOT NULL""")
def _(t):
    return prep.lag_features(t.returns, "ret")


@query("cleaned_and_scaled", "B18", "symbol:s ts:t ret sma_5 sma_20 ret_lag_1 ret_lag_10 scaled", "rets", """
WITH c AS (SELECT symbol, ts, greatest(a, least(b, ret)) AS ret FROM rets JOIN (SELECT symbol, quantile_cont(ret, 0.01) AS a,
    quantile_cont(ret, 0.99) AS b FROM rets GROUP BY 1) USING (symbol)),
  f AS (SELECT symbol, ts, ret, avg(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) AS sma_5,
    CASE WHEN count(*) OVER w = 20 THEN avg(ret) OVER w END AS sma_20, lag(ret, 1) OVER s AS ret_lag_1, lag(ret, 10) OVER s AS ret_lag_10
    FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), s AS (PARTITION BY symbol ORDER BY ts)),
  k AS (SELECT * FROM f WHERE sma_20 IS NOT NULL AND ret_lag_10 IS NOT NULL)
SELECT *, (ret - avg(ret) OVER (PARTITION BY symbol)) / stddev_pop(ret) OVER (PARTITION BY symbol) AS scaled FROM k""")
def _(t):
    return prep.clean_and_scale(t.returns, "ret")


@query("custom_features", "B19 U1", "symbol:s ts:t ret_to_bench spread", "rets bench", """
SELECT symbol, ts, rets.ret - bench.ret AS ret_to_bench, abs(rets.ret) * 100 AS spread FROM rets JOIN bench USING (ts)""")
def _(t):
    registry = prep.FeatureRegistry()
    registry.register("ret_to_bench", lambda df: df["ret"] - df["bench"])
    registry.register("spread", lambda df: F.abs(df["ret"]) * 100)
    return registry.add_to(align.with_benchmark(t.returns, t.benchmark))


@query("rebalance_calendar", "B20", "frequency:s ts:t", "bars", """
WITH d AS (SELECT DISTINCT date_trunc('day', o_orderdate)::TIMESTAMP AS ts FROM orders)
SELECT 'weekly' AS frequency, ts FROM d WHERE dayofweek(ts) = 5 UNION ALL
SELECT 'monthly', max(ts) FROM d GROUP BY date_trunc('month', ts) UNION ALL
SELECT 'quarterly', max(ts) FROM d GROUP BY date_trunc('quarter', ts) UNION ALL
SELECT 'yearly', max(ts) FROM d GROUP BY year(ts)""")
def _(t):
    days = t.read("orders").select(F.date_trunc("day", "o_orderdate").alias("ts"))
    out = None
    for f in ("weekly", "monthly", "quarterly", "yearly"):
        part = prep.rebalance_dates(days, f).withColumn("frequency", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


@query("asset_classes", "B21", "part_type:s asset_class:s n:i", "", """
SELECT p_type AS part_type, CASE WHEN contains(p_type, 'ECO') THEN 'bond' WHEN contains(p_type, 'SM') OR contains(p_type, 'MED') THEN 'etf'
  ELSE 'equity' END AS asset_class, count(*) AS n FROM part GROUP BY 1, 2""")
def _(t):
    kind = prep.asset_class("p_type", {"bond": ["ECO"], "etf": ["SM", "MED"]})
    return t.read("part").groupBy(F.col("p_type").alias("part_type"), kind.alias("asset_class")).agg(F.count("*").alias("n"))


@query("trailing_periods", "B22", "portfolio_id:s period:s n:i mean", "prets", """
WITH l AS (SELECT *, max(ts) OVER (PARTITION BY portfolio_id) AS m FROM prets)
SELECT portfolio_id, '1M' AS period, count(*) AS n, avg(ret) AS mean FROM l WHERE ts >= m - INTERVAL 30 DAY GROUP BY 1 UNION ALL
SELECT portfolio_id, '3M', count(*), avg(ret) FROM l WHERE ts >= m - INTERVAL 90 DAY GROUP BY 1 UNION ALL
SELECT portfolio_id, 'YTD', count(*), avg(ret) FROM l WHERE year(ts) = year(m) GROUP BY 1""")
def _(t):
    out = None
    for period in ("1M", "3M", "YTD"):
        part = prep.trailing_period(t.portfolio_returns, period, P).groupBy(P).agg(
            F.lit(period).alias("period"), F.count("*").alias("n"), F.avg("ret").alias("mean"))
        out = part if out is None else out.unionByName(part)
    return out


@query("growth_table", "B23", "series_id:s ts:t ret growth cumulative_return", "bench", """
SELECT *, growth - 1 AS cumulative_return FROM (SELECT series_id, ts, ret, product(1 + ret) OVER (ORDER BY ts) AS growth FROM bench)""")
def _(t):
    return prep.growth_table(t.benchmark, "series_id")


# Joins.

@query("aligned_series", "C1 G1", "symbol:s ts:t ret bench", "rets bench", """
SELECT symbol, ts, rets.ret, bench.ret AS bench FROM rets JOIN bench USING (ts)""")
def _(t):
    return align.common_dates(t.returns, t.benchmark.select("ts", F.col("ret").alias("bench")))


@query("benchmark_alignment", "C2", "symbol:s ts:t ret bench", "rets bench", """
SELECT r.symbol, r.ts, r.ret, coalesce(b.ret, 0) AS bench FROM rets r LEFT JOIN bench b ON r.ts = b.ts AND b.ret > 0""")
def _(t):
    return align.with_benchmark(t.returns, t.benchmark.where("ret > 0"))


@query("portfolio_returns", "C4", "portfolio_id:s ts:t ret", "prets", "SELECT * FROM prets")
def _(t):
    return align.portfolio_returns(t.weights, t.returns)


@query("drifting_weight_returns", "C5", "portfolio_id:s ts:t ret", "wts rets", """
SELECT portfolio_id, ts, sum(w * ret) AS ret FROM (SELECT *, lag(weight) OVER (PARTITION BY portfolio_id, symbol ORDER BY ts) AS w FROM wts)
JOIN rets USING (ts, symbol) WHERE w IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return align.portfolio_returns(align.lagged_weights(t.weights), t.returns)


@query("sector_mapping", "C6", "sector:s n:i value:m", "", """
SELECT coalesce(r_name, 'Unknown') AS sector, count(*) AS n, sum(s_acctbal) AS value FROM supplier
LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3 GROUP BY 1""")
def _(t):
    mapping = t.read("nation").join(t.read("region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("symbol"), F.col("r_name").alias("sector"))
    mapped = align.with_group(t.read("supplier").withColumnRenamed("s_nationkey", "symbol"), mapping)
    return mapped.groupBy("sector").agg(F.count("*").alias("n"), F.sum("s_acctbal").alias("value"))


@query("pair_covariances", "C7", "i:s j:s n:i cov corr", "panel", """
SELECT a.symbol AS i, b.symbol AS j, count(*) AS n, covar_samp(a.bret, b.bret) * 252 AS cov, corr(a.bret, b.bret) AS corr
FROM panel a JOIN panel b USING (ts) GROUP BY 1, 2""")
def _(t):
    from riskframe.plans.pairs import covariances, pair_moments
    return covariances(pair_moments(t.panel, value="bret", blocks=4), scale=252.0)


@query("source_agreement", "C8", "symbol:s common_dates:i accuracy", "ticks", """
WITH d AS (SELECT symbol, date_trunc('day', ts) AS ts, max(price) FILTER (source = 'click') AS a, max(price) FILTER (source = 'view') AS b
    FROM ticks WHERE source IN ('click', 'view') GROUP BY 1, 2)
SELECT symbol, count(a * b) AS common_dates, CASE WHEN count(a * b) > 3 THEN greatest(0, 100 - avg(abs((a - b) / a) * 100)) ELSE 50 END AS accuracy
FROM d GROUP BY 1""")
def _(t):
    daily = t.ticks.groupBy("symbol", F.date_trunc("day", "ts").alias("day"), "source").agg(F.max("price").alias("close"))
    return align.source_agreement(daily.withColumnRenamed("day", "ts"), "click", "view", enough=3)


@query("position_changes", "C9", "portfolio_id:s symbol:s current_position target_position trade_size trade_direction:s", "wts lw", """
WITH c AS (SELECT portfolio_id, symbol, arg_max(weight, ts) AS w FROM wts GROUP BY 1, 2)
SELECT *, CASE WHEN trade_size > 0 THEN 'buy' ELSE 'sell' END AS trade_direction FROM (
  SELECT coalesce(c.portfolio_id, l.portfolio_id) AS portfolio_id, coalesce(c.symbol, l.symbol) AS symbol, coalesce(c.w, 0) AS current_position,
    coalesce(l.weight, 0) AS target_position, coalesce(l.weight, 0) - coalesce(c.w, 0) AS trade_size FROM c
  FULL JOIN lw l ON c.portfolio_id = l.portfolio_id AND c.symbol = l.symbol) WHERE abs(trade_size) > 0.001""")
def _(t):
    current = t.weights.groupBy(P, S).agg(F.max_by("weight", "ts").alias("weight"))
    return align.position_diff(current, t.latest_weights)


@query("lookback_windows", "C10", "as_of:t symbol:s n:i mean", "rets", """
WITH p AS (SELECT max(ts) AS as_of FROM rets GROUP BY date_trunc('quarter', ts))
SELECT as_of, symbol, count(*) AS n, avg(ret) AS mean FROM p JOIN rets ON ts >= as_of - INTERVAL 180 DAY AND ts < as_of GROUP BY 1, 2""")
def _(t):
    points = prep.rebalance_dates(t.returns, "quarterly").withColumnRenamed("ts", "as_of")
    return align.lookback_join(points, t.returns, 180).groupBy("as_of", S).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"))


@query("positional_pairs", "C12", "symbol:s position:i close other", "bars", """
WITH a AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS position FROM bars),
  b AS (SELECT symbol, open AS other, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS position FROM bars WHERE volume > 1)
SELECT symbol, position, close, other FROM a JOIN b USING (symbol, position)""")
def _(t):
    return align.positional_join(t.bars.select(S, "ts", "close"),
                                 t.bars.where("volume > 1").select(S, "ts", F.col("open").alias("other")), S)


@query("transition_distance", "C14", "series_id:s ts:t regime:i distance:i", "reg", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn, lag(regime) OVER (ORDER BY ts) AS p FROM reg)
SELECT series_id, ts, regime, (SELECT min(abs(r.rn - x.rn)) FROM r x WHERE x.regime <> x.p) AS distance FROM r""")
def _(t):
    return align.transition_distance(t.regimes, "series_id")


@query("macro_as_of", "C15", "symbol:s ts:t ret value", "rets macrow", """
SELECT symbol, r.ts, ret, m.t10 AS value FROM rets r ASOF LEFT JOIN macrow m ON r.ts >= m.ts""")
def _(t):
    history = t.macro.where("code = 'T10'").select("ts", "value")
    dated = align.as_of(t.returns.select("ts").distinct(), history, ["value"])
    return t.returns.join(dated, "ts")


@query("regime_labelled_returns", "C16", "symbol:s ts:t ret regime:i", "rets reg", """
SELECT symbol, ts, rets.ret, regime FROM rets JOIN reg USING (ts)""")
def _(t):
    return align.with_label(t.returns, t.regimes.select("ts", "regime"))


@query("scalar_functions", "H1 H2 H3 H4 H5 H6 H7", "event_id:i z:d logpdf:d pdf:d cdf:d clipped:d rounded:d sign_of:i year:i quarter:i weekday:i "
       "epoch_ms:i title:s prefix:s k:i looked_up:d best:i flag:i", "", """
SELECT event_id, (value - 50) / 50 AS z, -0.5 * (ln(2 * pi()) + ((value - 50) / 50) ** 2) AS logpdf,
  exp(-0.5 * (ln(2 * pi()) + ((value - 50) / 50) ** 2)) AS pdf, c.cdf, greatest(1, least(100, value)) AS clipped,
  round(sqrt(value), 2) AS rounded, sign(value - 50) AS sign_of, year(ts) AS year, quarter(ts) AS quarter, dayofweek(ts) + 1 AS weekday,
  epoch_us(ts) // 1000 AS epoch_ms, upper(event_type[1]) || event_type[2:] AS title, split_part(event_type, 'i', 1) AS prefix,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'click' THEN 1.5 WHEN 'view' THEN 2.5 ELSE 0.0 END AS looked_up,
  CASE WHEN value >= 50 AND value >= 100 - value THEN 0 ELSE 1 END AS best, CASE WHEN value > 100 THEN 1 ELSE 0 END AS flag
FROM events JOIN (SELECT event_id, CASE WHEN y < 0 THEN 1 - u ELSE u END AS cdf FROM (
  SELECT event_id, y, 0.5 + x * exp(-x * x / 2) / sqrt(2 * pi()) * list_reduce(list_transform(range(0, 80), lambda k: p[k + 1]), lambda a, b: a + b) AS u FROM (
  SELECT event_id, y, x, list_transform(range(0, 80), lambda k: x ** (2 * k) / list_reduce(list_transform(range(0, k + 1), lambda i: (2 * i + 1)::DOUBLE), lambda a, b: a * b)) AS p
  FROM (SELECT event_id, (value - 50) / 50 AS y, abs(value - 50) / 50 AS x FROM events)))) c USING (event_id)""")
def _(t):
    from riskframe.functions import stats
    e = t.read("events")
    v = F.col("value")
    k = F.from_json("props", "k BIGINT")["k"]
    lookup = stats.lookup(F.create_map(F.lit("click"), F.lit(1.5), F.lit("view"), F.lit(2.5)), "event_type", 0.0)
    e = e.withColumn("z", (v - 50) / 50)
    return e.select(
        "event_id", "z", stats.normal_logpdf("z", 0.0, 1.0).alias("logpdf"), stats.normal_pdf("z").alias("pdf"),
        stats.normal_cdf("z").alias("cdf"), F.greatest(F.lit(1.0), F.least(F.lit(100.0), v)).alias("clipped"),
        F.round(F.sqrt(v), 2).alias("rounded"), stats.sign_of(v - 50).alias("sign_of"), F.year("ts").alias("year"),
        F.quarter("ts").alias("quarter"), F.dayofweek("ts").alias("weekday"), F.unix_millis(F.col("ts").cast("timestamp")).alias("epoch_ms"),
        stats.title_text("event_type").alias("title"), F.split("event_type", "i")[0].alias("prefix"), k.alias("k"),
        lookup.alias("looked_up"), stats.argmax(F.array(v, 100 - v)).alias("best"),
        F.when(v > 100, 1).otherwise(0).alias("flag"))
