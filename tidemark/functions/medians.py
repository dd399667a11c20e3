"""Running medians over many rows, dealt by spans of time and ranges of value.

Rows are numbered in their order and cut into spans of m; non-null values are numbered by size and cut into buckets of m. Counts by span
and bucket, summed over the spans before, tell which buckets hold the middle of what lies before a span. While a span's rows come, the
middle moves by no more than m ranks, so those of m ranks to either side and the span's own rows are all that its medians depend on: a
task has a few times m rows, whatever came before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Rows of a span at least, and spans of a segment at most: counts by span and bucket are MOST * MOST cells at most.
SPAN, MOST = 4096, 10_000


def in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, stored, with each row's number (from 0) in a strict order of all rows: places within ranges, and the rows of the ranges before
    (one row a range)."""
    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    first = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    placed = dealt.withColumn("_within", within).join(sizes.select("_range", first.alias("_first")), "_range")
    return placed.withColumn(name, F.col("_first") + F.col("_within")).drop("_range", "_within", "_first")


def medians(before: np.ndarray, below: int, count: int, own: np.ndarray) -> np.ndarray:
    """The median after each of a span's own values (NaN: none came). before: sorted values around the middle of the `count` values before
    the span, below: how many smaller ones aren't given. Goes back from the span's end: each value is taken out again, and the middle
    moves by one place at most."""
    came = np.flatnonzero(~np.isnan(own))
    every = np.concatenate([before, own[came]])
    order = np.argsort(every, kind="stable")
    place = np.empty(len(every), np.int64)
    place[order] = np.arange(len(every))
    value, n = every[order].tolist(), count + len(came)
    up, down = list(range(1, len(every) + 1)), list(range(-1, len(every) - 1))  # neighbours among those that are left
    out = [np.nan] * (len(came) + 1)
    at = rank = (n - 1) // 2 - below if n else 0  # where the lower middle value stands, and its rank among those given
    for k in range(len(came), -1, -1):
        if n:
            while rank > (n - 1) // 2 - below:
                at, rank = down[at], rank - 1
            while rank < (n - 1) // 2 - below:
                at, rank = up[at], rank + 1
            out[k] = value[at] if n % 2 else (value[at] + value[up[at]]) / 2
        if k:
            gone = int(place[len(before) + k - 1])
            if gone < at:
                rank -= 1
            elif gone == at:  # the next one takes its rank; without one, the one before
                at, rank = (up[at], rank) if up[at] < len(value) else (down[at], rank - 1)
            if down[gone] >= 0:
                up[down[gone]] = up[gone]
            if up[gone] < len(value):
                down[up[gone]] = down[gone]
            n -= 1
    return np.array(out)[np.cumsum(~np.isnan(own))]


def running(df: DataFrame, order: list[str], x: str, name: str, segment: list[str], span: int = SPAN) -> DataFrame:
    """df with the median of x over the rows so far of its segment, this one included; nulls (and NaN) don't count, and before the first
    value it is null. order: columns that order a segment's rows strictly."""
    rows = df.withColumn("_x", F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double")))
    rows = stored(in_order(rows, [*segment, *order], "_at"), "ordered")
    ranked = in_order(rows.where(F.col("_x").isNotNull()).select(*segment, "_x", "_at"), [*segment, "_x", "_at"], "_rank")
    edges = rows.groupBy(*segment).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_size"))
    floors = ranked.groupBy(*segment).agg(F.min("_rank").alias("_lowest"), F.count(F.lit(1)).alias("_values"))
    m = max(span, -(-(edges.agg(F.max("_size").alias("n")).first().n or 0) // MOST))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in segment]

    def with_edges(left: DataFrame, right: DataFrame) -> DataFrame:  # a row a segment
        if not segment:
            return left.join(F.broadcast(right), F.lit(True))  # one row
        return left.alias("a").join(right.alias("b"), same).select("a.*", *[F.col(f"b.{c}") for c in right.columns if c not in segment])

    values = with_edges(with_edges(ranked, edges), floors)
    values = stored(values.select(*segment, "_x", "_at", F.floor((F.col("_at") - F.col("_from")) / m).alias("_s"), F.floor((F.col("_rank") - F.col("_lowest")) / m).alias("_v")), "values")
    spans = with_edges(edges, floors.select(*segment, F.floor((F.col("_values") - 1) / m).alias("_last"))).select(*segment, "_size", "_last")
    cells = spans.select(*segment, "_last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / m))).alias("_s"))
    cells = cells.select(*segment, "_s", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("_v"))
    counts = values.groupBy(*segment, "_s", "_v").agg(F.count(F.lit(1)).alias("_n"))
    keys = [*segment, "_s", "_v"]
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    cells = cells.alias("a").join(counts.alias("b"), on, "left").select("a.*", F.coalesce("b._n", F.lit(0)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy(*segment, "_v").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("_held").over(W.partitionBy(*segment, "_s").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    whole = F.sum("_held").over(W.partitionBy(*segment, "_s"))
    cells = cells.withColumn("_held", earlier).withColumn("_upto", upto).withColumn("_count", whole)
    middle = F.floor(F.col("_count") / 2)
    near = cells.where((F.col("_held") > 0) & (F.col("_upto") > middle - m - 1) & (F.col("_upto") - F.col("_held") <= middle + m + 1))
    near = near.select(*segment, "_s", "_v", (F.col("_upto") - F.col("_held")).alias("_below"), "_count")
    past = near.alias("a").join(values.withColumnRenamed("_s", "_was").alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*segment, "_v"]])
    past = past.where("_was < _s").select(*[F.col(f"a.{c}") for c in segment], "_s", "_x", F.lit(None).cast("long").alias("_at"), "_below", "_count")
    own = with_edges(rows.select(*segment, "_x", "_at"), edges)
    own = own.select(*segment, F.floor((F.col("_at") - F.col("_from")) / m).alias("_s"), "_x", "_at", F.lit(None).cast("long").alias("_below"), F.lit(None).cast("long").alias("_count"))

    def of_span(frame: pd.DataFrame) -> pd.DataFrame:
        old, new = frame[frame["_at"].isna()], frame[frame["_at"].notna()].sort_values("_at")
        below, count = (int(old["_below"].min()), int(old["_count"].iloc[0])) if len(old) else (0, 0)
        found = medians(np.sort(old["_x"].to_numpy(float)), below, count, new["_x"].to_numpy(float))
        return pd.DataFrame({"_at": new["_at"].astype("int64"), "_median": found})

    found = own.unionByName(past).groupBy(*segment, "_s").applyInPandas(of_span, "_at long, _median double")
    return rows.join(found, "_at").withColumn(name, F.when(~F.isnan("_median"), F.col("_median"))).drop("_at", "_x", "_median")
