"""Queries A: landed payloads, caches, failover and snapshots.  File readers are covered by the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import prep
from riskframe.queries.base import query
from riskframe.sources import cache, readers

S = "symbol"


@query("transaction_lines", "A1", "portfolio_id:s ts:t symbol:s side:s quantity price commission impact", "tx", """
SELECT portfolio_id, ts, symbol, side, quantity, price, commission, impact FROM tx""")
def _(t):
    tx = t.transactions
    numbers = [F.col(c).cast("string") for c in ("quantity", "price", "commission", "impact")]
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("symbol").cast("string"), "side",
                       *numbers, F.lit("fill"))
    return readers.parse_transaction_lines(tx.select("portfolio_id", line.alias("line")))


@query("daily_payload", "A2", "symbol:s ts:t open high low close volume:i", "bars", """
SELECT * FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'""")
def _(t):
    fields = F.create_map(*[x for name, c in (("1. open", "open"), ("2. high", "high"), ("3. low", "low"), ("4. close", "close"),
                                              ("5. volume", "volume")) for x in (F.lit(name), F.col(c).cast("string"))])
    landed = t.bars.groupBy(S, F.date_trunc("month", "ts").alias("m")).agg(F.to_json(F.map_from_entries(F.collect_list(
        F.struct(F.date_format("ts", "yyyy-MM-dd"), fields)))).alias("payload"))
    return readers.parse_daily_payload(landed, start="2024-01-05", end="2024-01-25")


@query("aggregate_payload", "A3", "symbol:s ts:t open high low close volume:i", "bars", "SELECT * FROM bars")
def _(t):
    item = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"),
                    F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").cast("double").alias("v"))
    landed = t.bars.groupBy(S, F.date_trunc("month", "ts").alias("m")).agg(F.to_json(F.collect_list(item)).alias("payload"))
    return readers.parse_aggregate_payload(landed)


@query("decoded_trades", "A4", "symbol:s ts:t open high low price size:i", "", """
SELECT 'U' || user_id AS symbol, date_trunc('millisecond', ts) AS ts, value AS open, value AS high,
  CASE WHEN event_type = 'click' THEN value / 2 ELSE value END AS low, value AS price,
  CASE WHEN event_type = 'click' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS size
FROM events WHERE event_type <> 'error'""")
def _(t):
    click = F.col("source") == "click"
    message = F.to_json(F.struct(
        F.when(F.col("source") == "error", "Q").otherwise("T").alias("ev"), F.col("symbol").alias("sym"), F.col("price").alias("p"),
        F.when(~click, F.col("size")).alias("s"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
        F.when(click, F.col("price") / 2).alias("l")))
    return readers.decode_trades(t.ticks.select(message.alias("value")))


@query("latest_quotes", "A5 I2", "symbol:s ts:t event_id:i price size:i", "ticks", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS k FROM ticks) WHERE k = 1""")
def _(t):
    return readers.latest_quotes(t.ticks, tie="event_id")


@query("hourly_bars", "A6", "symbol:s ts:t open close volume:i", "ticks", """
SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, first(price ORDER BY ts, event_id) AS open, last(price ORDER BY ts, event_id) AS close,
  sum(size) AS volume FROM ticks GROUP BY symbol, date_trunc('hour', ts)""")
def _(t):
    return readers.bars_at(t.ticks, "1h", tie="event_id")


@query("macro_table", "A7 L8", "ts:t treasury_10y treasury_2y industrial_output term_change spread_change", "macrow", """
SELECT * FROM (SELECT ts, t10 AS treasury_10y, t02 AS treasury_2y, ind AS industrial_output, t10 - lag(t10) OVER (ORDER BY ts) AS term_change,
  (t10 - t02) - lag(t10 - t02) OVER (ORDER BY ts) AS spread_change FROM macrow) WHERE term_change IS NOT NULL""")
def _(t):
    from riskframe.adapters import MACRO_NAMES
    from riskframe.operators.factors import macro_factors
    wide = readers.macro_wide(t.macro, MACRO_NAMES).withColumn("spread", F.col("treasury_10y") - F.col("treasury_2y"))
    return macro_factors(wide, {"term_change": "treasury_10y", "spread_change": "spread"})


@query("fundamentals", "A8 H4", "symbol:s market_cap:m price:m missing pct", "", """
SELECT p_name || p_partkey AS symbol, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_retailprice * p_size END AS market_cap,
  p_retailprice AS price, 0.0 AS missing, p_size / 100.0 AS pct FROM part""")
def _(t):
    from riskframe.functions.stats import percent_text
    p = t.read("part").withColumn(S, F.concat("p_name", "p_partkey"))
    cap = F.when(F.col("p_partkey") % 3 == 0, "None").otherwise((F.col("p_retailprice") * F.col("p_size")).cast("string"))
    raw = p.select(S, "p_size", F.to_json(F.create_map(F.lit("MarketCapitalization"), cap, F.lit("Price"),
                                                       F.col("p_retailprice").cast("string"), F.lit("PERatio"), F.lit("-"))).alias("payload"))
    numbers = readers.parse_fundamentals(raw, {"market_cap": "MarketCapitalization", "price": "Price", "missing": "PERatio"})
    pct = raw.select(S, percent_text(F.concat(F.col("p_size").cast("string"), F.lit("%"))).alias("_p"))
    return numbers.join(pct, S).withColumn("pct", F.col("_p") / 100)


@query("resolved_aliases", "A9", "symbol:s n:i", "", """
SELECT CASE event_type WHEN 'view' THEN '^VIX' WHEN 'click' THEN '^TNX' ELSE event_type END AS symbol, count(*) AS n FROM events GROUP BY 1""")
def _(t):
    named = t.read("events").select(F.col("event_type").alias(S))
    return readers.resolve_aliases(named, S, {"view": "^VIX", "click": "^TNX"}).groupBy(S).agg(F.count("*").alias("n"))


FAILOVER = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY priority) AS k FROM (
  SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, source, max(price) AS close,
    CASE source WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS priority
  FROM ticks GROUP BY 1, 2, 3)) WHERE k = 1"""


@query("source_failover", "A10", "symbol:s ts:t source:s close", "ticks", FAILOVER)
def _(t):
    daily = t.ticks.groupBy(S, F.date_trunc("day", "ts").alias("day"), "source").agg(F.max("price").alias("close"))
    order = F.create_map(*[F.lit(x) for i, s in enumerate(("purchase", "view", "click", "signup")) for x in (s, i)])
    ranked = daily.withColumnRenamed("day", "ts").withColumn("priority", F.coalesce(F.try_element_at(order, "source"), F.lit(4)))
    return cache.first_source(ranked)


@query("cache_upsert", "A11", "symbol:s ts:t kind:s close", "ticks", """
SELECT symbol, ts, kind, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts, kind ORDER BY event_id DESC) AS k FROM (
  SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, 'price' AS kind, event_id, price AS close FROM ticks)) WHERE k = 1""")
def _(t):
    rows = t.ticks.select(S, F.date_trunc("day", "ts").alias("ts"), F.lit("price").alias("kind"),
                          F.col("event_id").alias("write_ts"), F.col("price").alias("close"))
    return cache.upsert(rows.where("write_ts % 2 = 0"), rows.where("write_ts % 2 = 1"))


@query("valid_cache_rows", "A12", "event_id:i", "", """
SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 90 MINUTE""")
def _(t):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return cache.still_valid(t.read("events"), 90, now, "ts")


@query("snapshot_export", "A13", "symbol:s price", "ticks", "SELECT symbol, arg_max(price, (ts, event_id)) AS price FROM ticks GROUP BY 1")
def _(t):
    return cache.snapshot(t.ticks, "event_id")


@query("alternative_data", "A16", "ts:t region:s activity sentiment", "panel", """
SELECT ts, sector AS region, avg(bw) AS activity, s AS sentiment FROM panel JOIN (
  SELECT ts, avg(greatest(-1, least(1, 100 * ret))) AS s FROM panel GROUP BY 1) USING (ts) GROUP BY 1, 2, 4""")
def _(t):
    moods = readers.sentiment_by_date(t.panel.withColumn("sentiment", 100 * F.col("ret")))
    return readers.activity_by_date(t.panel.withColumnsRenamed({"bw": "activity", "sector": "region"})).join(moods, "ts")


@query("merged_quotes", "A17 U6", "symbol:s price source:s", "ticks", """
SELECT symbol, price, source FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE source WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) AS k
  FROM (SELECT symbol, source, arg_max(price, (ts, event_id)) AS price FROM ticks WHERE source IN ('view', 'click', 'error') GROUP BY 1, 2)) WHERE k = 1""")
def _(t):
    registry = readers.SourceRegistry()
    for name in ("error", "click", "view"):
        registry.register(name, lambda spark, source=name: readers.latest_quotes(
            t.ticks.where(F.col("source") == source), tie="event_id"))
    return registry.failover(t.spark, ["view", "click", "error"], keys=[S])


@query("written_run", "A14", "portfolio_id:s n:i mean", "prets", "SELECT portfolio_id, count(*) AS n, avg(ret) AS mean FROM prets GROUP BY 1")
def _(t):
    from riskframe.session import scratch_folder
    from riskframe.sources import sinks
    folder = scratch_folder(t.spark, "run")
    summary = t.portfolio_returns.groupBy("portfolio_id").agg(F.count("*").alias("n"))
    sinks.write_run(t.portfolio_returns, t.latest_weights, t.regimes.select("ts", "regime"), summary, folder)
    stored = t.spark.read.schema("portfolio_id string, ts timestamp, ret double").csv(f"{folder}/portfolio_returns", header=True)
    return stored.groupBy("portfolio_id").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"))


@query("written_metric_tables", "A15", "portfolio_id:s herfindahl n:i", "lw prets", """
SELECT portfolio_id, sum(weight ** 2) AS herfindahl, n FROM lw JOIN (SELECT portfolio_id, count(*) AS n FROM prets GROUP BY 1) USING (portfolio_id) GROUP BY portfolio_id, n""")
def _(t):
    from riskframe.operators import risk
    from riskframe.session import scratch_folder
    from riskframe.sources import sinks
    folder = scratch_folder(t.spark, "metrics")
    shares = risk.contributions_from_returns(t.latest_weights, t.returns)
    tables = {"current": risk.concentration(t.latest_weights), "history": t.portfolio_returns, "decomposition": shares,
              "stress": risk.stress_tests(t.latest_weights, t.returns, {"none": {}})}
    sinks.write_metric_tables(tables, folder)
    n = t.spark.read.parquet(f"{folder}/history").groupBy("portfolio_id").agg(F.count("*").alias("n"))
    return t.spark.read.parquet(f"{folder}/current").join(n, "portfolio_id")
