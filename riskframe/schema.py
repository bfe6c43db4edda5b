"""Fixed schemas of the long tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    fields = []
    names = {"string": T.StringType(), "timestamp": T.TimestampType(), "date": T.DateType(), "double": T.DoubleType(),
             "bigint": T.LongType(), "int": T.IntegerType(), "doubles": T.ArrayType(T.DoubleType()),
             "strings": T.ArrayType(T.StringType()), "text_map": T.MapType(T.StringType(), T.StringType()),
             "number_map": T.MapType(T.StringType(), T.DoubleType())}
    for part in ddl.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, names[kind]))
    return T.StructType(fields)


OHLCV_FILE = _struct("Date timestamp, Open double, High double, Low double, Close double, Volume bigint, Adj_Close double")
BARS = _struct("symbol string, ts timestamp, open double, high double, low double, close double, adj_close double, "
               "volume bigint, source string")
VENDOR_BARS = T.StructType(BARS.fields + _struct("dividend double, split double").fields)
TICK = _struct("symbol string, ts timestamp, open double, high double, low double, price double, size bigint, "
               "source string, additional_fields number_map")
EVENT = _struct("event_id string, event_type string, ts timestamp, symbol string, data text_map, metadata text_map")
SUBSCRIPTION = _struct("client_id string, symbols strings, event_types strings, last_heartbeat timestamp")
RETURNS = _struct("symbol string, ts timestamp, ret double")
WEIGHTS = _struct("portfolio_id string, ts timestamp, symbol string, weight double")
REGIMES = _struct("series_id string, ts timestamp, regime int, regime_name string, confidence double, probs doubles")
REGIME_FILE = _struct("Date timestamp, returns double, regime string, regime_code int, confidence double")
TRANSACTION_FILE = _struct("Date timestamp, Symbol string, Type string, Quantity double, Price double, "
                           "Commission double, Market_Impact double, Notes string")
MACRO = _struct("ts timestamp, indicator string, value double")
ALERTS = _struct("portfolio_id string, ts timestamp, alert_type string, level string, metric_name string, "
                 "current_value double, threshold_value double, message string, suggested_action string")
#: One trade message of a tick socket.
TRADE_MESSAGE = _struct("ev string, sym string, p double, s bigint, t bigint, o double, h double, l double")
#: One element of an aggregates payload.
AGGREGATE = _struct("t bigint, o double, h double, l double, c double, v double")
