"""Registry of queries and the SQL views they share.

``spec`` fixes the output of both sides: "name:type" with s text, i integer, d double (23 significant bits),
m money and p price (30 significant bits), t timestamp as text, b boolean.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from riskframe.adapters import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}

#: SQL of the shared views, in dependency order.
VIEWS: dict[str, str] = {
    "wk": """SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS ts, o_orderpriority AS symbol,
        sum(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1, 2""",
    "rets": "SELECT symbol, ts, 0.01 * (v / avg(v) OVER (PARTITION BY symbol) - 1) AS ret FROM wk",
    "bench": """SELECT 'all' AS series_id, ts, 0.01 * (v / avg(v) OVER () - 1) AS ret FROM (
        SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS ts, sum(o_totalprice) AS v FROM orders GROUP BY 1)""",
    "wts": """SELECT portfolio_id, ts, symbol, n / sum(n) OVER (PARTITION BY portfolio_id, ts) AS weight FROM (
        SELECT o_orderstatus AS portfolio_id, date_trunc('week', o_orderdate)::TIMESTAMP AS ts,
        o_orderpriority AS symbol, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2, 3)""",
    "lw": """SELECT portfolio_id, symbol, n / sum(n) OVER (PARTITION BY portfolio_id) AS weight FROM (
        SELECT o_orderstatus AS portfolio_id, o_orderpriority AS symbol, count(*)::DOUBLE AS n
        FROM orders GROUP BY 1, 2)""",
    "prets": """SELECT portfolio_id, ts, sum(weight * ret) AS ret FROM wts JOIN rets USING (ts, symbol)
        GROUP BY 1, 2""",
    "al": """SELECT p.portfolio_id, p.ts, p.ret, coalesce(b.ret, 0) AS bench FROM prets p
        LEFT JOIN bench b USING (ts)""",
    "ticks": """SELECT 'U' || user_id AS symbol, ts, event_id, value AS price,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS size, event_type AS source FROM events""",
    "bars": """SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, first(price ORDER BY ts, event_id) AS open,
        max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close,
        count(*) AS volume FROM ticks GROUP BY 1, 2""",
    "bret": """SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars""",
    "tx": """SELECT l_linestatus AS portfolio_id, l_shipdate AS ts, l_suppkey AS symbol, l_orderkey AS order_id,
        l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 'Sell' ELSE 'Buy' END AS side,
        l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_extendedprice AS value,
        l_extendedprice * l_discount AS commission, l_extendedprice * l_tax AS impact FROM lineitem""",
    "places": """SELECT n_nationkey AS nk, n_name AS symbol, r_name AS sector FROM nation
        JOIN region ON n_regionkey = r_regionkey""",
    "panel": """SELECT symbol, sector, ts, 0.01 * (vf / avg(vf) OVER (PARTITION BY symbol) - 1) AS ret,
        0.01 * (v / avg(v) OVER (PARTITION BY symbol) - 1) AS bret, vf / sum(vf) OVER (PARTITION BY ts) AS pw,
        q / sum(q) OVER (PARTITION BY ts) AS bw, v AS cap, q / v AS bm, d / v AS prof, t / v AS inv FROM (
        SELECT symbol, sector, date_trunc('month', l_shipdate)::TIMESTAMP AS ts, sum(l_extendedprice) AS v,
        sum(l_quantity) AS q, sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END) AS vf,
        sum(l_extendedprice * l_discount) AS d, sum(l_extendedprice * l_tax) AS t
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = nk GROUP BY 1, 2, 3)""",
    "macrow": """SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS ts, 100 * avg(l_tax) AS t10,
        100 * avg(l_discount) AS t02, sum(l_quantity) AS ind FROM lineitem GROUP BY 1""",
    "volr": """SELECT series_id, ts, ret, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS vol
        FROM bench WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS 19 PRECEDING)""",
    "reg": """SELECT series_id, ts, ret, vol, CASE WHEN vol <= lo THEN 0 WHEN vol > hi THEN 2 ELSE 1 END AS regime
        FROM volr JOIN (SELECT series_id, quantile_cont(vol, 0.33) AS lo, quantile_cont(vol, 0.67) AS hi
        FROM volr GROUP BY 1) USING (series_id)""",
    "preg": "SELECT al.*, reg.regime FROM al JOIN reg USING (ts)",
    "dd": """SELECT *, w - max(w) OVER p AS dd_add, w / max(w) OVER p - 1 AS dd_rel FROM (
        SELECT *, product(1 + ret) OVER (PARTITION BY portfolio_id ORDER BY ts) AS w FROM al)
        WINDOW p AS (PARTITION BY portfolio_id ORDER BY ts)""",
}


def compose(views: str, body: str) -> str:
    """Prefix ``body`` with the named views and all they need."""
    needed = set(views.split())
    for name in reversed(list(VIEWS)):
        if name in needed:
            words = set(VIEWS[name].replace("(", " ").replace(")", " ").split())
            needed |= {other for other in VIEWS if other in words and other != name}
    chosen = [f"{name} AS ({sql})" for name, sql in VIEWS.items() if name in needed]
    return ("WITH " + ",\n".join(chosen) + "\n" if chosen else "") + body


#: Multiplier 2^k + 1 whose product cancels all but the first 53 - k bits of a double: 23 bits (7 digits) of measures,
#: 30 bits (9 digits) of money; sums differ in their last bits with the order of their terms.
SPLIT = {"d": 2.0 ** 30 + 1, "m": 2.0 ** 23 + 1, "p": 2.0 ** 23 + 1}
#: Larger values, infinite ones and not-a-number are left as they are.
LARGE = 1e290
#: Smaller values are what cancellation leaves of zero.
ZERO = 1e-13


def _rounded(x: str, kind: str) -> str:
    """Doubles by significant bits, in three operations that both engines compute alike and without text."""
    c = f"{x} * {SPLIT[kind]!r}D"
    return (f"CASE WHEN abs({x}) < {ZERO!r}D THEN 0.0D WHEN abs({x}) < {LARGE!r}D THEN {c} - ({c} - {x}) ELSE {x} END")


def _sql_column(name: str, kind: str) -> str:
    if kind in SPLIT:
        x = _rounded(f"CAST({name} AS DOUBLE)", kind)
        return re.sub(r"([0-9][0-9.e+-]*)D\b", r"CAST(\1 AS DOUBLE)", x) + f" AS {name}"
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"
    kinds = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}
    return f"CAST({name} AS {kinds[kind]}) AS {name}"


def _spark_column(name: str, kind: str) -> str:
    """SQL text: one parse per column instead of a dozen calls into the JVM."""
    if kind in SPLIT:
        return _rounded(f"CAST(`{name}` AS DOUBLE)", kind) + f" AS `{name}`"
    if kind == "t":
        return f"date_format(`{name}`, 'yyyy-MM-dd HH:mm:ss') AS `{name}`"
    kinds = {"i": "BIGINT", "s": "STRING", "b": "BOOLEAN"}
    return f"CAST(`{name}` AS {kinds[kind]}) AS `{name}`"


def parse_spec(spec: str) -> list[tuple[str, str]]:
    parts = [p.strip().split(":") for p in spec.split()]
    return [(p[0], p[1] if len(p) > 1 else "d") for p in parts]


def query(name: str, covers: str, spec: str, views: str = "", body: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``body`` is its SQL over ``views``, none where SQL has no form."""
    columns = parse_spec(spec)

    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        sql = None
        if body is not None:
            picked = ", ".join(_sql_column(*c) for c in columns)
            main = f"SELECT {picked} FROM (\n{body}\n) AS result"
            sql = compose(views, main)

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder)).selectExpr(*[_spark_column(*c) for c in columns])

        REGISTRY[name] = Query(name, covers, run, sql)
        return fn

    return register
