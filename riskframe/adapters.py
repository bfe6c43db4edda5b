"""Domain views over the driver's tables: ticks, bars, returns, weights, transactions, macro, regimes.

Every view is an aggregation or projection of a base table, so its work grows with that table; the result
of the aggregations is date grain.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.plans.windows import constant_key, whole
from riskframe.session import cut_lineage, ship_package

#: Code to name of the macro series (fixed values).
MACRO_NAMES = {"T10": "treasury_10y", "T02": "treasury_2y", "IND": "industrial_output"}


class Tables:
    """Lazy views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        ship_package(spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Weekly order aggregates: five order priorities stand for assets, three statuses for portfolios.

    @cached_property
    def order_weeks(self) -> DataFrame:
        """(portfolio_id, symbol, ts, v, n): the one pass over the orders that all weekly views share.

        It is calendar-sized, so it is written to the checkpoint folder once; otherwise every join of two
        weekly views would read the orders again.
        """
        return cut_lineage(self.read("orders").groupBy(
            F.col("o_orderstatus").alias("portfolio_id"), F.col("o_orderpriority").alias("symbol"),
            F.date_trunc("week", "o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n")))

    def weekly(self, *keys: str) -> DataFrame:
        return self.order_weeks.groupBy(*keys, "ts").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))

    @cached_property
    def returns(self) -> DataFrame:
        """(symbol, ts, ret), one row per asset and week, with holes where there was no order."""
        return self.weekly("symbol").select(
            "symbol", "ts", (0.01 * (F.try_divide(F.col("v"), F.avg("v").over(whole("symbol"))) - 1)).alias("ret"))

    @cached_property
    def benchmark(self) -> DataFrame:
        """(series_id, ts, ret) over all orders."""
        total = constant_key(self.weekly())
        return total.select("series_id", "ts",
                            (0.01 * (F.try_divide(F.col("v"), F.avg("v").over(whole("series_id"))) - 1)).alias("ret"))

    @cached_property
    def weights(self) -> DataFrame:
        """(portfolio_id, ts, symbol, weight), adding up to 1 per portfolio and week."""
        counts = self.weekly("portfolio_id", "symbol")
        return counts.select("portfolio_id", "ts", "symbol",
                             (F.col("n") / F.sum("n").over(whole(["portfolio_id", "ts"]))).alias("weight"))

    @cached_property
    def latest_weights(self) -> DataFrame:
        """Constant weights per portfolio: shares of all its orders."""
        counts = self.order_weeks.groupBy("portfolio_id", "symbol").agg(F.sum("n").alias("n"))
        return counts.select("portfolio_id", "symbol",
                             (F.col("n") / F.sum("n").over(whole("portfolio_id"))).alias("weight"))

    @cached_property
    def portfolio_returns(self) -> DataFrame:
        """(portfolio_id, ts, ret) = sum of weight times return."""
        return (self.weights.join(self.returns, ["ts", "symbol"])
                .groupBy("portfolio_id", "ts").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret")))

    @cached_property
    def aligned(self) -> DataFrame:
        """Portfolio returns with the benchmark beside them, 0 where missing."""
        bench = self.benchmark.select("ts", F.col("ret").alias("bench"))
        return (self.portfolio_returns.join(bench, "ts", "left")
                .withColumn("bench", F.coalesce("bench", F.lit(0.0))))

    # Events: users are symbols of a tick feed.

    @cached_property
    def ticks(self) -> DataFrame:
        """(symbol, ts, event_id, price, size, source) at tick grain, one symbol per user."""
        return self.read("events").select(
            F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), "ts", "event_id",
            F.col("value").alias("price"),
            F.get_json_object("props", "$.k").cast("bigint").alias("size"),
            F.col("event_type").alias("source"))

    @cached_property
    def bars(self) -> DataFrame:
        """Daily bars per symbol; volume is the tick count."""
        order = F.struct("ts", "event_id")
        return self.ticks.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", order).alias("close"),
            F.count("*").alias("volume")).withColumnRenamed("day", "ts")

    # Line items: fills of trades, and a monthly panel with one asset per supplier nation.

    @cached_property
    def transactions(self) -> DataFrame:
        value = F.col("l_extendedprice")
        return self.read("lineitem").select(
            F.col("l_linestatus").alias("portfolio_id"), F.col("l_shipdate").alias("ts"),
            F.col("l_suppkey").alias("symbol"), F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line"),
            F.when(F.col("l_returnflag") == "R", "Sell").otherwise("Buy").alias("side"),
            F.col("l_quantity").alias("quantity"), F.try_divide(value, F.col("l_quantity")).alias("price"),
            value.alias("value"), (value * F.col("l_discount")).alias("commission"),
            (value * F.col("l_tax")).alias("impact"))

    @cached_property
    def places(self) -> DataFrame:
        """(symbol, sector): nation to region."""
        return (self.read("nation").join(self.read("region"),
                                         F.col("n_regionkey") == F.col("r_regionkey"))
                .select(F.col("n_nationkey").alias("_nk"), F.col("n_name").alias("symbol"),
                        F.col("r_name").alias("sector")))

    @cached_property
    def panel(self) -> DataFrame:
        """(symbol, sector, ts, ret, bret, pw, bw, cap, bm, prof, inv): monthly, one asset per nation.

        Written once like ``order_weeks``: factor work joins the panel with itself many times.
        """
        supplier = self.read("supplier").select("s_suppkey", "s_nationkey")
        per_supplier = (self.read("lineitem").groupBy(
            "l_suppkey", F.date_trunc("month", "l_shipdate").alias("ts")).agg(
            F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("q"),
            F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).otherwise(0.0)).alias("vf"),
            F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("d"),
            F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("t")))
        cells = (per_supplier.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
                 .join(self.places, F.col("s_nationkey") == F.col("_nk"))
                 .groupBy("symbol", "sector", "ts")
                 .agg(*[F.sum(c).alias(c) for c in ("v", "q", "vf", "d", "t")]))
        date, asset = whole("ts"), whole("symbol")
        return cut_lineage(cells.select(
            "symbol", "sector", "ts",
            (0.01 * (F.try_divide(F.col("vf"), F.avg("vf").over(asset)) - 1)).alias("ret"),
            (0.01 * (F.try_divide(F.col("v"), F.avg("v").over(asset)) - 1)).alias("bret"),
            F.try_divide(F.col("vf"), F.sum("vf").over(date)).alias("pw"),
            F.try_divide(F.col("q"), F.sum("q").over(date)).alias("bw"),
            F.col("v").alias("cap"), F.try_divide("q", "v").alias("bm"),
            F.try_divide("d", "v").alias("prof"), F.try_divide("t", "v").alias("inv")))

    @cached_property
    def macro(self) -> DataFrame:
        """(ts, code, value) monthly, long."""
        monthly = self.read("lineitem").groupBy(F.date_trunc("month", "l_shipdate").alias("ts")).agg(
            (100 * F.avg("l_tax")).alias("T10"), (100 * F.avg("l_discount")).alias("T02"),
            F.sum("l_quantity").alias("IND"))
        return monthly.unpivot("ts", ["T10", "T02", "IND"], "code", "value")

    @cached_property
    def regimes(self) -> DataFrame:
        """(series_id, ts, ret, vol, regime): volatility terciles of the benchmark."""
        from riskframe.operators.series import volatility_tercile_regimes
        return volatility_tercile_regimes(self.benchmark, "series_id")

    @cached_property
    def portfolio_regimes(self) -> DataFrame:
        """(portfolio_id, ts, ret, bench, regime)."""
        return self.aligned.join(self.regimes.select("ts", "regime"), "ts")
