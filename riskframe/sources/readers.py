"""Readers for files and landed vendor payloads, and the registry of data sources."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import schema
from riskframe.functions.stats import parse_number
from riskframe.operators.prep import coarser_bars, ohlcv_bars

#: Bar frequencies and the window or calendar unit behind each (fixed values).
FREQUENCIES = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour",
               "1d": "1 day", "1wk": "week", "1mo": "month"}

#: Short names of market indicators and the symbols they stand for (fixed values).
INDICATOR_ALIASES = {"vix": "^VIX", "yield_10y": "^TNX", "yield_2y": "^IRX", "dollar_index": "DX-Y.NYB",
                     "oil": "CL=F", "gold": "GC=F"}


# CSV files.

def _symbol_of_file() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_data)?\.csv$", 1)


def read_bars_csv(spark: SparkSession, path: str, source: str = "file") -> DataFrame:
    """One OHLCV file per symbol, the symbol taken from the file name."""
    raw = spark.read.schema(schema.OHLCV_FILE).csv(path, header=True)
    return raw.select(_symbol_of_file().alias("symbol"), F.col("Date").alias("ts"), F.col("Open").alias("open"),
                      F.col("High").alias("high"), F.col("Low").alias("low"), F.col("Close").alias("close"),
                      F.col("Adj_Close").alias("adj_close"), F.col("Volume").alias("volume"), F.lit(source).alias("source"))


def read_transactions_csv(spark: SparkSession, path: str, portfolio: str) -> DataFrame:
    raw = spark.read.schema(schema.TRANSACTION_FILE).csv(path, header=True)
    return _transactions(raw, portfolio)


def _transactions(raw: DataFrame, portfolio: str | Column) -> DataFrame:
    return raw.select((F.lit(portfolio) if isinstance(portfolio, str) else portfolio).alias("portfolio_id"),
                      F.col("Date").alias("ts"), F.col("Symbol").alias("symbol"), F.col("Type").alias("side"),
                      F.col("Quantity").alias("quantity"), F.col("Price").alias("price"),
                      F.col("Commission").alias("commission"), F.col("Market_Impact").alias("impact"),
                      F.col("Notes").alias("notes"))


def parse_transaction_lines(lines: DataFrame, column: str = "line", portfolio: str = "portfolio_id") -> DataFrame:
    """Transactions held as CSV text lines of a landed table."""
    parsed = lines.select(portfolio, F.from_csv(column, schema.TRANSACTION_FILE.simpleString()[7:-1].replace(":", " ")
                                                ).alias("_t")).select(portfolio, "_t.*")
    return _transactions(parsed, F.col(portfolio))


def read_weights_csv(spark: SparkSession, path: str, portfolio: str, symbols: Sequence[str]) -> DataFrame:
    """Wide date by asset weights as a long table."""
    fields = [T.StructField("Date", T.TimestampType()), *[T.StructField(s, T.DoubleType()) for s in symbols]]
    raw = spark.read.schema(T.StructType(fields)).csv(path, header=True)
    long = raw.unpivot("Date", list(symbols), "symbol", "weight")
    return long.select(F.lit(portfolio).alias("portfolio_id"), F.col("Date").alias("ts"), "symbol",
                       F.coalesce("weight", F.lit(0.0)).alias("weight"))


def read_regimes_csv(spark: SparkSession, path: str, series: str) -> DataFrame:
    raw = spark.read.schema(schema.REGIME_FILE).csv(path, header=True)
    return raw.select(F.lit(series).alias("series_id"), F.col("Date").alias("ts"), F.col("returns").alias("ret"),
                      F.col("regime_code").alias("regime"), F.col("regime").alias("regime_name"), "confidence")


# Landed vendor payloads, one JSON text per row.

def parse_daily_payload(df: DataFrame, column: str = "payload", symbol: str = "symbol", start: str | None = None,
                        end: str | None = None) -> DataFrame:
    """{"2024-01-02": {"1. open": "10.5", ..., "5. volume": "100"}}: one bar per date."""
    days = df.select(symbol, F.explode(F.from_json(column, "MAP<STRING, MAP<STRING, STRING>>")).alias("_d", "_f"))
    def field(name: str) -> Column:
        return F.try_element_at("_f", F.lit(name)).try_cast("double")
    bars = days.select(symbol, F.to_timestamp("_d", "yyyy-MM-dd").alias("ts"), field("1. open").alias("open"),
                       field("2. high").alias("high"), field("3. low").alias("low"), field("4. close").alias("close"),
                       field("5. volume").cast("bigint").alias("volume"))
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    return bars if end is None else bars.where(F.col("ts") <= F.lit(end).cast("timestamp"))


def parse_aggregate_payload(df: DataFrame, column: str = "payload", symbol: str = "symbol") -> DataFrame:
    """[{"t": epoch ms, "o": .., "h": .., "l": .., "c": .., "v": ..}]: one bar per element."""
    fields = "ARRAY<" + schema.AGGREGATE.simpleString() + ">"
    rows = df.select(symbol, F.explode(F.from_json(column, fields)).alias("_a"))
    return rows.select(symbol, F.timestamp_millis("_a.t").alias("ts"), F.col("_a.o").alias("open"),
                       F.col("_a.h").alias("high"), F.col("_a.l").alias("low"), F.col("_a.c").alias("close"),
                       F.col("_a.v").cast("bigint").alias("volume"))


def decode_trades(df: DataFrame, column: str = "value", source: str = "socket") -> DataFrame:
    """Trade messages of a tick feed, batch or streaming: only ev = 'T', prices default to the trade price."""
    m = F.col("_m")
    return (df.select(F.from_json(F.col(column).cast("string"), schema.TRADE_MESSAGE).alias("_m"))
            .where(m["ev"] == "T")
            .select(m["sym"].alias("symbol"), F.timestamp_millis(m["t"]).alias("ts"),
                    F.coalesce(m["o"], m["p"]).alias("open"), F.coalesce(m["h"], m["p"]).alias("high"),
                    F.coalesce(m["l"], m["p"]).alias("low"), m["p"].alias("price"),
                    F.coalesce(m["s"], F.lit(0)).alias("size"), F.lit(source).alias("source")))


def read_kafka_trades(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Streaming trades from a Kafka topic (needs the Kafka connector on the class path)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return decode_trades(reader.options(**options).load())


def latest_quotes(df: DataFrame, keys: str | Sequence[str] = "symbol", ts: str = "ts",
                  tie: str | None = None) -> DataFrame:
    """Last row per key; one struct per key and task reaches the shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = F.struct(ts, tie) if tie else F.col(ts)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_q")).select(*keys, "_q.*")


def bars_at(df: DataFrame, frequency: str, keys: str = "symbol", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Ticks or bars at one of the eight frequencies; raw ticks have a ``price`` column."""
    if frequency not in FREQUENCIES:
        raise ValueError(f"unknown frequency {frequency!r}; one of {sorted(FREQUENCIES)}")
    unit = FREQUENCIES[frequency]
    if "price" in df.columns:
        width = unit if " " in unit else "1 day"
        bars = ohlcv_bars(df, width, keys, ts, tie=tie)
        return bars if " " in unit else coarser_bars(bars, unit, keys, ts)
    return coarser_bars(df, unit if " " not in unit else unit.split()[1].rstrip("s"), keys, ts)


def macro_wide(df: DataFrame, names: Mapping[str, str], ts: str = "ts") -> DataFrame:
    """Long (ts, code, value) as one column per named indicator, outer-aligned on dates."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    named = df.withColumn("_name", F.try_element_at(F.create_map(*pairs), F.col("code"))).where("_name IS NOT NULL")
    return named.groupBy(ts).pivot("_name", list(names.values())).agg(F.first("value"))


def parse_fundamentals(df: DataFrame, fields: Mapping[str, str], column: str = "payload", symbol: str = "symbol") -> DataFrame:
    """Chosen numbers of a JSON object; 'None', empty and unparsable become 0."""
    raw = df.select(symbol, F.from_json(column, "MAP<STRING, STRING>").alias("_f"))
    return raw.select(symbol, *[parse_number(F.try_element_at("_f", F.lit(src))).alias(out) for out, src in fields.items()])


def resolve_aliases(df: DataFrame, column: str = "symbol", aliases: Mapping[str, str] | None = None) -> DataFrame:
    pairs = [F.lit(x) for pair in (aliases or INDICATOR_ALIASES).items() for x in pair]
    return df.withColumn(column, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.col(column)))


# Alternative data and bundles.

def sentiment_by_date(df: DataFrame, value: str = "sentiment", ts: str = "ts") -> DataFrame:
    """Mean over symbols of a per-symbol sentiment clipped to [-1, 1]."""
    return df.groupBy(ts).agg(F.avg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(value)))).alias("sentiment"))


def news_by_date(df: DataFrame, volume: str = "news_volume", sentiment: str = "news_sentiment", ts: str = "ts") -> DataFrame:
    return df.groupBy(ts).agg(F.avg(volume).alias("news_volume"), F.avg(sentiment).alias("news_sentiment"))


def activity_by_date(df: DataFrame, value: str = "activity", region: str = "region", ts: str = "ts") -> DataFrame:
    return df.groupBy(ts, region).agg(F.avg(value).alias("activity"))


def bundle(prices: DataFrame, economic: DataFrame, sentiment: DataFrame, news: DataFrame) -> dict[str, DataFrame]:
    return {"prices": prices, "economic": economic, "sentiment": sentiment, "news": news}


class SourceRegistry:
    """Named readers ``fn(spark, **options) -> DataFrame`` tried in the order of preference given."""

    def __init__(self) -> None:
        self._readers: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, reader: Callable[..., DataFrame]) -> None:
        self._readers[name] = reader

    def read(self, spark: SparkSession, name: str, **options) -> DataFrame:
        if name not in self._readers:
            raise KeyError(f"unknown source {name!r}; registered: {sorted(self._readers)}")
        return self._readers[name](spark, **options)

    def failover(self, spark: SparkSession, order: Sequence[str], keys: Sequence[str] = ("symbol", "ts"), **options) -> DataFrame:
        from riskframe.sources.cache import first_source
        frames = [self.read(spark, name, **options).withColumn("priority", F.lit(i)) for i, name in enumerate(order)]
        union = frames[0]
        for frame in frames[1:]:
            union = union.unionByName(frame, allowMissingColumns=True)
        return first_source(union, keys)
