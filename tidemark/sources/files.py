"""Bars and tables in files: Parquet blocks, CSV and TSV, inline rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "symbol string, market string, ending timestamp, open double, high double, low double, close double, volume double, adj_close double"


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header, compressed or not; without a schema cells are typed by what they hold."""
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", gzip: bool = False, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).option("sep", sep).option("compression", "gzip" if gzip else "none").csv(path)


def transposed(df: DataFrame, key: str) -> DataFrame:
    """A small result on its side: one row a column, one column a value of key (the values become column names, so it is for display)."""
    others = [c for c in df.columns if c != key]
    long = df.select(F.col(key).cast("string").alias("_k"), F.explode(F.create_map(*[x for c in others for x in (F.lit(c), F.col(c).cast("string"))])).alias("column", "value"))
    return long.groupBy("column").pivot("_k").agg(F.first("value"))


def inline(spark: SparkSession, rows: Iterable[tuple], schema: str = BAR_SCHEMA) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def block_of(ending: Column, interval: str) -> Column:
    """The storage block of a bar: five years of days, months of quarter hours and longer, weeks of five minutes, else days."""
    minutes = {"m1": 1, "m2": 2, "m5": 5, "m10": 10}.get(interval, 15)
    if interval in ("day", "week", "month", "quarter", "year"):
        return (F.floor(F.year(ending) / 5) * 5).cast("string")
    return F.date_format(ending, "yyyy-MM") if minutes >= 15 else F.date_format(F.date_trunc("week", ending), "yyyy-MM-dd") if minutes >= 5 else F.date_format(ending, "yyyy-MM-dd")


def write_blocks(bars: DataFrame, path: str, interval: str) -> None:
    """Bars in folders by series and block; blocks that the frame holds are replaced, others stay."""
    blocked = bars.withColumn("block", block_of(F.col("ending"), interval))
    blocked.repartition("symbol", "market", "block").sortWithinPartitions("ending").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "market", "block").parquet(path)


def read_blocks(spark: SparkSession, path: str, interval: str, symbol: str | None = None, begin: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a block store; symbol and times prune folders and row groups."""
    df = spark.read.parquet(path)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    for edge, later in ((begin, True), (end, False)):
        if edge is not None:
            at = F.lit(edge).cast("timestamp")
            block = block_of(at, interval)
            df = df.where((F.col("ending") >= at) & (F.col("block") >= block) if later else (F.col("ending") <= at) & (F.col("block") <= block))
    return df.drop("block")
