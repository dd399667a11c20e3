"""The first bar after a moment that reaches a price, for many orders at once, whatever gaps lie between the bars.

The prices asked for in a series are numbered, so that a bar reaches a range of numbers. Ranges are cut into nodes of doubling length
(level, number >> level), two a level at most, and a number lies in one node a level: an order and a bar that reaches its price have
exactly one node in common. So the first such bar is the first one in any of the order's nodes: rows go up with orders and bars times
the logarithm of the prices, and no order meets the bars one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Parts of a series' price range that are numbered apart, and bars of a node that are looked through together.
SPANS, CHUNK_BITS = 4096, 12


def numbered(bars: DataFrame, keys: list[str], ending: str = "ending") -> DataFrame:
    """Adds `_pos`, the bar's number in its series from 0: counts of the days before (a row a day), and the place within the day."""
    day = bars.withColumn("_day", F.col(ending).cast("date"))
    sizes = day.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*keys, "_day", F.coalesce(before, F.lit(0)).alias("_first"))
    within = F.row_number().over(W.partitionBy(*keys, "_day").orderBy(ending)) - 1
    return day.withColumn("_within", within).join(sizes, [*keys, "_day"]).withColumn("_pos", F.col("_first") + F.col("_within")).drop("_day", "_within", "_first")


def _shift(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k)


def _nodes(a: Column, b: Column) -> Column:
    """Nodes (level, node) that together hold the numbers from a to b."""

    def of(k: Column) -> Column:
        low, high = _shift(a + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), _shift(b + 1, k)
        node = lambda n: F.struct(k.cast("int").alias("level"), n.alias("node"))
        some = F.array(F.when((low < high) & (low % 2 == 1), node(low)), F.when((low < high) & (high % 2 == 1), node(high - 1)))
        return F.filter(some, lambda n: n.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.log2((b + 1).cast("double")).cast("int")), of))


def _numbers(prices: DataFrame, reaches: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Prices (keys, x) with `number` and `count` (of the series' prices), and reaches (keys, _pos, lo, hi) with the numbers _a to _b of
    the prices that they hold."""
    distinct = prices.select(*keys, F.col("x").alias("v")).distinct()
    extent = distinct.groupBy(*keys).agg(F.min("v").alias("_min"), F.max("v").alias("_max"), F.count(F.lit(1)).alias("count"))
    part = F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("_min"), F.col("_max") - F.col("_min")), F.lit(0.0)) * SPANS)
    part = F.least(F.greatest(part, F.lit(0)), F.lit(SPANS)).alias("_part")
    probe = lambda c, turn: reaches.where(F.col(c).isNotNull()).select(*keys, F.col(c).alias("v"), F.lit(turn).alias("_turn"), "_pos")
    every = distinct.withColumn("_turn", F.lit(1)).withColumn("_pos", F.lit(None).cast("long")).unionByName(probe("lo", 0)).unionByName(probe("hi", 2))
    every = every.join(extent.select(*keys, "_min", "_max"), keys).select(*keys, "v", "_turn", "_pos", part)
    asked = (F.col("_turn") == 1).cast("long")
    sizes = every.groupBy(*keys, "_part").agg(F.sum(asked).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # SPANS rows at most
    here = F.sum(asked).over(W.partitionBy(*keys, "_part").orderBy("v", "_turn").rowsBetween(W.unboundedPreceding, 0))
    placed = every.withColumn("_here", here).join(sizes.select(*keys, "_part", earlier.alias("_earlier")), [*keys, "_part"])
    placed = stored(placed.select(*keys, "v", "_turn", "_pos", (F.col("_here") + F.col("_earlier")).alias("_upto")), "placed")
    number = placed.where("_turn = 1").select(*keys, F.col("v").alias("x"), (F.col("_upto") - 1).alias("number"))
    ends = placed.where("_turn <> 1").groupBy(*keys, "_pos").agg(F.max(F.when(F.col("_turn") == 0, F.col("_upto"))).alias("_a"), F.max(F.when(F.col("_turn") == 2, F.col("_upto") - 1)).alias("_b"))
    ends = ends.join(extent.select(*keys, "count"), keys).select(*keys, "_pos", F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.col("count") - 1).alias("_b"))
    return prices.join(number, [*keys, "x"]).join(extent.select(*keys, "count"), keys), ends.where("_a <= _b")


def first_touch(orders: DataFrame, reaches: DataFrame, keys: list[str], ref: str) -> DataFrame:
    """For each order (keys, x, _after and a unique ref) the first bar after position _after that reaches x: ref and `_pos`; none where no
    bar does. reaches: keys, _pos, lo, hi, one row a bar (lo or hi null: without a bound; not both)."""
    waiting = orders.where(F.col("x").isNotNull() & ~F.isnan("x"))
    same = [*keys, "x", "_after"]  # orders alike in these wait for the same bar, and are asked for once
    asked, ends = _numbers(waiting.select(*same).distinct(), reaches, keys)
    levels = F.sequence(F.lit(0), F.log2(F.col("count").cast("double")).cast("int") + 1)
    up = F.transform(levels, lambda k: F.struct(k.cast("int").alias("level"), _shift(F.col("number"), k).alias("node")))
    node = [*keys, "level", "node"]
    a = asked.select(*same, F.explode(up).alias("_n")).select(*keys, "_n.level", "_n.node", "x", F.col("_after").alias("_at"))
    b = ends.select(*keys, "_pos", F.explode(_nodes(F.col("_a"), F.col("_b"))).alias("_n")).select(*keys, "_n.level", "_n.node", "_pos")
    b = b.withColumn("x", F.lit(None).cast("double"))
    both = a.withColumn("_pos", F.lit(None).cast("long")).unionByName(b.withColumn("_at", F.col("_pos"))).withColumn("_chunk", _shift(F.col("_at"), F.lit(CHUNK_BITS)))
    # within a chunk of bars, from its end (a frame that shrinks would be summed up anew for each row): an order stands before the bar
    # that it comes with, so it sees later ones only
    on = W.partitionBy(*node, "_chunk").orderBy(F.col("_at").desc(), F.col("_pos").isNull().desc()).rowsBetween(W.unboundedPreceding, 0)
    near = both.withColumn("_next", F.min("_pos").over(on)).where(F.col("_pos").isNull())
    # else the first bar of the node's next chunk that has one; a row a chunk
    chunks = b.withColumn("_chunk", _shift(F.col("_pos"), F.lit(CHUNK_BITS))).groupBy(*node, "_chunk").agg(F.min("_pos").alias("_first"))
    late = near.where(F.col("_next").isNull())
    asking = late.select(*node, "_chunk").distinct().withColumn("_first", F.lit(None).cast("long"))
    ahead = W.partitionBy(*node).orderBy(F.col("_chunk").desc()).rangeBetween(W.unboundedPreceding, -1)
    later = chunks.unionByName(asking).withColumn("_next", F.min("_first").over(ahead)).where(F.col("_first").isNull() & F.col("_next").isNotNull()).drop("_first")
    found = [*keys, "x", F.col("_at").alias("_after"), "_next"]
    hits = near.where(F.col("_next").isNotNull()).select(*found).unionByName(late.drop("_next").join(later, [*node, "_chunk"]).select(*found))
    return waiting.select(ref, *same).join(hits.groupBy(*same).agg(F.min("_next").alias("_pos")), same).select(ref, "_pos")
