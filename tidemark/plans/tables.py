"""Bars and dimensions made of the star-schema tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def event_bars(spark: SparkSession, d: str, interval: str = "m60") -> DataFrame:
    return bars.from_ticks(read(spark, d, "events"), interval, F.col("event_type"), F.col("value"), F.col("ts").cast("timestamp"), F.col("event_id"))


def order_bars(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return bars.from_ticks(o, "day", F.col("o_orderpriority"), F.col("o_totalprice"), F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey"), "ORD")


def stamp(name: str = "ending"):  # noqa: ANN201
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def STAMP(name: str = "ending") -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


BARS = ("open", "high", "low", "close", "volume", "adj_close")


def shown(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Keys, ending as text, and doubles rounded, without a negative zero."""
    out = []
    for f in df.schema.fields:
        if cols and f.name not in cols:
            continue
        kind = f.dataType.typeName()
        out.append(stamp(f.name) if kind.startswith("timestamp") else (F.round(F.col(f.name), digits) + 0.0).alias(f.name) if kind in ("double", "float") else F.col(f.name))
    return df.select(*out)


H = """h AS (SELECT event_type AS symbol, 'EVT' AS market, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ending,
  arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
  CAST(count(*) AS DOUBLE) AS volume, arg_max(value, (ts, event_id)) AS adj_close FROM events GROUP BY 1, 2, 3)"""
D = """d AS (SELECT o_orderpriority AS symbol, 'ORD' AS market, date_trunc('day', o_orderdate) + INTERVAL 1 DAY AS ending,
  arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, CAST(count(*) AS DOUBLE) AS volume,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS adj_close FROM orders GROUP BY 1, 2, 3)"""


def rolled(source: str, unit: str, name: str = "r") -> str:
    key = f"date_trunc('{unit}', ending - INTERVAL 1 SECOND)"
    return f"""{name} AS (SELECT symbol, market, max(ending) AS ending, arg_min(open, ending) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ending) AS close, sum(volume) AS volume, arg_max(adj_close, ending) AS adj_close FROM {source} GROUP BY symbol, market, {key})"""


def rounded(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({c.split(' AS ')[0]} AS DOUBLE), {digits}) + 0.0 AS {c.split(' AS ')[-1]}" for c in cols)


SHOW = f"symbol, market, {STAMP()}, {rounded(*BARS)}"
