"""Files, caches and streams with late, repeated and unordered data."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import monitor, topk
from riskframe.sources import cache, readers, sinks
from riskframe.streaming import events as ev, regime_log, run, state


def stamp(minute, day=1):
    return dt.datetime(2024, 1, day) + dt.timedelta(minutes=minute)


def test_csv_files(spark, tmp_path):
    (tmp_path / "AAPL.csv").write_text("Date,Open,High,Low,Close,Volume,Adj_Close\n2024-01-02,1,2,0.5,1.5,100,1.4\n")
    got = readers.read_bars_csv(spark, str(tmp_path)).first()
    assert (got["symbol"], got["close"], got["volume"]) == ("AAPL", 1.5, 100)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "transactions.csv").write_text("Date,Symbol,Type,Quantity,Price,Commission,Market_Impact,Notes\n2024-01-02,A,Buy,2,3.5,0.1,0.2,x\n")
    assert readers.read_transactions_csv(spark, str(tmp_path / "t"), "p").first()["quantity"] == 2.0
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "weights.csv").write_text("Date,A,B\n2024-01-02,0.6,\n")
    assert {r["symbol"]: r["weight"] for r in readers.read_weights_csv(spark, str(tmp_path / "w"), "p", ["A", "B"]).collect()} == {"A": 0.6, "B": 0.0}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "regimes.csv").write_text("Date,returns,regime,regime_code,confidence\n2024-01-02,0.1,Bull,0,0.9\n")
    assert readers.read_regimes_csv(spark, str(tmp_path / "r"), "s").first()["regime_name"] == "Bull"


def test_cache_round_trip_prunes_partitions(spark, tmp_path):
    rows = [("A", stamp(0, d), "price", float(d), stamp(d)) for d in (1, 15)] + [("A", dt.datetime(2024, 2, 1), "price", 9.0, stamp(1))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, kind string, close double, write_ts timestamp")
    newer = df.limit(1).withColumns({"close": F.lit(7.0), "write_ts": F.lit(stamp(999))})
    cache.write_cache(cache.upsert(df, newer), str(tmp_path / "c"))
    got = cache.read_cache(spark, str(tmp_path / "c"), ["A"], "2024-01-01", "2024-01-31", "price")
    assert sorted(r["close"] for r in got.collect()) == [7.0, 15.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan


def test_failover_and_registry(spark):
    rows = [("A", stamp(0), "slow", 1.0, 1), ("A", stamp(0), "fast", 2.0, 0), ("B", stamp(0), "slow", 3.0, 1)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, source string, close double, priority int")
    got = {r["symbol"]: r["source"] for r in cache.first_source(df).collect()}
    assert got == {"A": "fast", "B": "slow"}
    with pytest.raises(KeyError):
        readers.SourceRegistry().read(spark, "missing")
    with pytest.raises(ValueError):
        readers.bars_at(df, "2y")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 1.0)], "portfolio_id string, ret double")
    sinks.write_run(df, df, df, df, str(tmp_path))
    assert spark.read.csv(str(tmp_path / "portfolio_returns"), header=True).first()["portfolio_id"] == "p"
    sinks.write_metric_tables({"current": df, "history": df, "decomposition": df, "stress": df}, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m" / "stress")).count() == 1
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "x"), "xlsx")


def test_set_operations(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    b = spark.createDataFrame([(2,), (3,)], "x int")
    assert [r["x"] for r in topk.common_values(a, b, ["x"]).collect()] == [2]
    assert topk.all_values(a, b, ["x"]).count() == 3
    assert topk.stack(a, b.withColumnRenamed("x", "y")).columns == ["x", "y"]


SCHEMA = "symbol string, ts timestamp, price double, size bigint, source string"


def land(spark, folder, batch, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{batch}")


def feed(spark, folder):
    return (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
            .parquet(f"{folder}/b*"))


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Four batches: an unordered tick, a repeated one, and one far later than the watermark of the batch before."""
    folder = str(tmp_path_factory.mktemp("feed"))
    land(spark, folder, 0, [("A", stamp(1), 10.0, 1, "s"), ("A", stamp(3), 12.0, 1, "s"), ("B", stamp(2), 5.0, 1, "s")])
    land(spark, folder, 1, [("A", stamp(2), 11.0, 1, "s"), ("A", stamp(3), 12.0, 1, "s"), ("A", stamp(200), 20.0, 1, "s")])
    land(spark, folder, 2, [("B", stamp(201), 6.0, 1, "s"), ("A", stamp(400), 21.0, 1, "s")])
    land(spark, folder, 3, [("A", stamp(4), 99.0, 1, "s"), ("A", stamp(700), 22.0, 1, "s")])
    return folder


def test_bars_drop_late_and_repeated_ticks(spark, landed):
    bars = ev.stream_bars(ev.dedup(feed(spark, landed), "10 minutes"), "1 hour", delay=None)
    got = {(r["symbol"], r["ts"].hour): r for r in run.drain(bars).collect()}
    first = got[("A", 0)]
    assert (first["open"], first["high"], first["low"], first["close"], first["volume"]) == (10.0, 12.0, 10.0, 12.0, 3)
    assert got[("B", 0)]["volume"] == 1 and got[("B", 3)]["close"] == 6.0


def test_last_values_over_batches(spark, landed):
    got = {r["symbol"]: r["price"] for r in run.newest(run.drain(ev.last_values(feed(spark, landed)), "update"), ["symbol"]).collect()}
    assert got == {"A": 22.0, "B": 6.0}


def label_rows(n=24_000):
    """One label a second, in pseudo-random regimes, and a second series."""
    times = pd.date_range("2024-01-01", periods=n, freq="s")
    rng = np.random.default_rng(5)
    return pd.concat([pd.DataFrame({"series_id": s, "ts": times, "tie": np.arange(n), "regime": rng.integers(0, 3, n), "confidence": 0.9})
                      for s in ("A", "B")])


def land_labels(rows, folder, files=8):
    folder.mkdir()
    for i, part in enumerate(np.array_split(np.arange(len(rows)), files)):
        rows.iloc[part].astype({"tie": "int64", "regime": "int32", "ts": "datetime64[us]"}).to_parquet(folder / f"{i}.parquet", index=False)
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


@pytest.mark.parametrize("files_at_once,disorder,delay", [(None, None, "10 minutes"), (1, 3600, "2 hours")])
def test_regime_changes_do_not_depend_on_files_or_triggers(spark, tmp_path, files_at_once, disorder, delay):
    rows, rng = label_rows(), np.random.default_rng(6)
    late = rng.random(len(rows)) * (disorder or 1e9)
    mixed = rows.iloc[np.argsort(rows["ts"].to_numpy().astype("datetime64[s]").astype(float) + late)]
    folder = land_labels(mixed, tmp_path / "labels")
    reader = spark.readStream.schema("series_id string, ts timestamp, tie bigint, regime int, confidence double")
    reader = reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader
    got = run.drain(state.regime_changes(reader.parquet(folder), delay)).toPandas()
    cut = rows["ts"].max() - pd.Timedelta(delay)
    for series, whole in rows[rows["ts"] < cut].groupby("series_id"):
        whole = whole.sort_values("ts")
        want = whole[(whole["regime"] != whole["regime"].shift()) & whole["regime"].shift().notna()]
        mine = got[got["series_id"] == series].sort_values("switches")
        assert len(want) > 10_000 and mine["ts"].tolist() == want["ts"].tolist() and mine["to_regime"].tolist() == want["regime"].tolist()
        assert mine["switches"].tolist() == list(range(1, len(want) + 1)) and len(mine["recent"].iloc[-1]) == 100


def changes_of(rows):
    whole = rows.sort_values(["ts", "tie"])
    return whole[(whole["regime"] != whole["regime"].shift()) & whole["regime"].shift().notna()]


@pytest.mark.parametrize("files_at_once,shuffled", [(None, False), (None, True), (1, True)])
def test_logged_regime_changes_lose_nothing(spark, tmp_path, files_at_once, shuffled):
    rows = label_rows(9000)
    rows = pd.concat([rows, rows[rows["series_id"] == "A"].iloc[:4000].assign(series_id="C", ts=pd.Timestamp("2024-02-01"))])  # one moment
    mixed = rows.sample(frac=1, random_state=3) if shuffled else rows
    folder = land_labels(mixed, tmp_path / "labels", 8 if shuffled else 1)
    reader = spark.readStream.schema("series_id string, ts timestamp, tie bigint, regime int, confidence double")
    reader = reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader
    got = regime_log.drain_regime_changes(reader.parquet(folder), "10 minutes").toPandas()
    for series, whole in rows.groupby("series_id"):
        want, mine = changes_of(whole), got[got["series_id"] == series].sort_values("switches")
        assert len(want) > 2000 and mine["ts"].tolist() == want["ts"].tolist() and mine["to_regime"].tolist() == want["regime"].tolist()
        assert mine["switches"].tolist() == list(range(1, len(want) + 1))
        assert all(list(r) == want["regime"].iloc[max(0, i - 99):i + 1].tolist() for i, r in list(enumerate(mine["recent"]))[::977])
    assert len(got) == sum(len(changes_of(w)) for _, w in rows.groupby("series_id"))


def test_models_survive_a_restart_and_a_repeated_batch(spark, tmp_path):
    def refit(buffer):
        return buffer.agg(F.count("*").alias("n"), F.max("price").alias("most"))

    handler = run.refresh_handler(str(tmp_path / "out"), 3, refit)
    for i in range(6):
        land(spark, str(tmp_path / "in"), i, [("A", stamp(i), float(i), 1, "s")] * (i + 1))
        if i in (3, 5):
            run.start(feed(spark, str(tmp_path / "in")), handler, str(tmp_path / "state")).awaitTermination()
    again = feed(spark, str(tmp_path / "in"))
    run.start(again, run.refresh_handler(str(tmp_path / "out"), 3, refit), str(tmp_path / "state")).awaitTermination()
    model = run.latest_model(spark, str(tmp_path / "out")).collect()
    assert [(r.version, r.n, r.most) for r in model] == [(5, 15, 5.0)]
    handler(spark.read.parquet(str(tmp_path / "in" / "b5")), 5)
    every = spark.read.parquet(str(tmp_path / "out-models"))
    assert sorted((r.version, r.n) for r in every.collect()) == [(2, 6), (3, 9), (4, 12), (5, 15)]


def test_risk_alerts_follow_the_merged_portfolio(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = pd.DataFrame({"portfolio_id": "p", "symbol": [f"s{i % 4}" for i in range(40)], "weight": rng.random(40) * 0.4,
                         "ts": pd.date_range("2024-01-01", periods=40, freq="h")})
    folder = tmp_path / "updates"
    folder.mkdir()
    for i, part in enumerate(np.array_split(rng.permutation(40), 4)):
        rows.iloc[part].astype({"ts": "datetime64[us]"}).to_parquet(folder / f"{i}.parquet", index=False)
    updates = spark.readStream.schema("portfolio_id string, symbol string, weight double, ts timestamp").option(
        "maxFilesPerTrigger", 1).parquet(str(folder))
    limits = monitor.limits_table(spark.createDataFrame([("p",)], "portfolio_id string"))
    run.start(updates, run.risk_alert_handler(spark, limits, str(tmp_path / "out")), str(tmp_path / "state")).awaitTermination()
    latest = spark.createDataFrame(rows.sort_values("ts").groupby("symbol").tail(1)[["portfolio_id", "symbol", "weight"]])
    kinds = lambda df: sorted((r["alert_type"], round(r["current_value"], 9)) for r in df.collect())
    got = spark.read.parquet(str(tmp_path / "out")).where("batch = 3")
    assert kinds(got) == kinds(monitor.monitor(latest, limits)) and kinds(got)


def test_refresh_handlers_and_status(spark, landed, tmp_path):
    sizes, seen = [], []
    handlers = run.Handlers()
    handlers.register(run.refresh_handler(str(tmp_path / "buffer"), 2, lambda b: sizes.append(b.count())))
    handlers.register(lambda b, i: seen.append(b.count()), ["B"])
    listener = run.StatusListener()
    spark.streams.addListener(listener)
    run.start(feed(spark, landed), handlers, str(tmp_path / "state")).awaitTermination()
    spark.streams.removeListener(listener)
    assert sizes == [6, 5, 4] and seen == [1, 0, 1, 0]


def test_weight_upsert_over_batches(spark, landed, tmp_path):
    updates = feed(spark, landed).select(F.lit("p").alias("portfolio_id"), "symbol", F.col("price").alias("weight"), "ts")
    run.start(updates, run.weight_upsert_handler(spark, str(tmp_path / "w")), str(tmp_path / "s")).awaitTermination()
    got = {r["symbol"]: r["weight"] for r in spark.read.parquet(str(tmp_path / "w" / "version=3")).collect()}
    assert got == {"A": 22.0, "B": 6.0}
