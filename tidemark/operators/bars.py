"""Bars: making, rolling up, adjusting, merging.

A bar is a row (symbol, market, ending, open, high, low, close, volume, adj_close); a series is one (symbol, market).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["symbol", "market"]
#: The intervals and their lengths in minutes (from a day on: calendar units).
INTERVALS = {"m1": 1, "m2": 2, "m5": 5, "m10": 10, "m15": 15, "m20": 20, "m30": 30, "m60": 60, "m120": 120, "m240": 240, "day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year"}


def period_start(ts: Column, interval: str) -> Column:
    n = INTERVALS[interval]
    return F.date_trunc(n, ts) if isinstance(n, str) else F.timestamp_micros((F.floor(F.unix_micros(ts) / (n * 60_000_000)) * (n * 60_000_000)).cast("long"))


def period_end(ts: Column, interval: str) -> Column:
    """The end of the period that holds ts; a moment between two counts into the later one."""
    start = period_start(ts, interval)
    n = INTERVALS[interval]
    step = {"day": F.make_interval(days=F.lit(1)), "week": F.make_interval(weeks=F.lit(1)), "month": F.make_interval(months=F.lit(1)), "quarter": F.make_interval(months=F.lit(3)), "year": F.make_interval(years=F.lit(1))}
    return start + (step[n] if isinstance(n, str) else F.make_dt_interval(mins=F.lit(n)))


def from_ticks(ticks: DataFrame, interval: str, symbol: Column, price: Column, ts: Column, tie: Column, market: str = "EVT", volume: Column | None = None) -> DataFrame:
    """Bars of ticks; the first and last price by (ts, tie). One shuffle, summed map-side first."""
    t = ticks.select(symbol.alias("symbol"), F.lit(market).alias("market"), period_end(ts, interval).alias("ending"), price.cast("double").alias("p"), F.struct(ts.alias("a"), tie.alias("b")).alias("at"), (F.lit(1.0) if volume is None else volume.cast("double")).alias("v"))
    return t.groupBy("symbol", "market", "ending").agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.sum("v").alias("volume")).withColumn("adj_close", F.col("close"))


def adjusted_to(bars: DataFrame, by: list[str]) -> DataFrame:
    """open, high, low, close rescaled, within each group, to the adjustment of its last bar: four places, as they are within 1e-6."""
    w = W.partitionBy(*by).orderBy("ending").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    base = F.last(F.struct("close", "adj_close")).over(w)
    scale = F.try_divide(F.col("adj_close"), F.col("close")) * F.try_divide(base["close"], base["adj_close"])
    own = F.col("adj_close").isNull() | (F.col("adj_close") == 0) | (F.col("adj_close") == F.col("close")) | (F.abs(scale - 1) < 1e-6)
    b = bars.withColumn("_scale", F.when(~own, scale))
    return b.withColumns({c: F.when(F.col("_scale").isNull(), F.col(c)).otherwise(F.round(F.col(c) * F.col("_scale"), 4)) for c in ("open", "high", "low", "close")}).drop("_scale")


def roll_up(bars: DataFrame, interval: str, adjust: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Bars of a longer interval: first open, highest high, lowest low, last close and adj_close, summed volume; `ending` is the last
    bar's. With adjust the prices of a period are first rescaled to its last bar."""
    # a bar ends its period: step back before truncating
    b = bars.withColumn("_p", period_start(F.col("ending") - F.make_dt_interval(secs=F.lit(1)), interval) if interval in ("day", "week", "month", "quarter", "year") else period_end(F.col("ending") - F.make_dt_interval(secs=F.lit(1)), interval))
    if adjust:
        b = adjusted_to(b, [*keys, "_p"])
    last = F.max_by(F.struct("close", "adj_close"), "ending")
    out = b.groupBy(*keys, "_p").agg(F.max("ending").alias("ending"), F.min_by("open", "ending").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last.alias("_l"), F.sum("volume").alias("volume"))
    return out.select(*keys, "ending", "open", "high", "low", F.col("_l.close").alias("close"), "volume", F.col("_l.adj_close").alias("adj_close"))


def last_weekday(ts: Column, interval: str) -> Column:
    """The last weekday of ts's week, month, quarter or year, at the time of day of ts."""
    final = F.date_sub(period_end(ts, interval).cast("date"), 1)
    back = F.greatest(F.weekday(final) - 4, F.lit(0))
    day = F.date_sub(final, back)
    return day.cast("timestamp") + F.make_dt_interval(hours=F.hour(ts), mins=F.minute(ts), secs=F.second(ts))


def dedupe(bars: DataFrame, keys: list[str] = KEYS, first: str = "rank") -> DataFrame:
    """One bar an ending: the one of least `first`, without a sort of the series."""
    rest = [c for c in bars.columns if c not in (*keys, "ending")]
    return bars.groupBy(*keys, "ending").agg(F.min_by(F.struct(*rest), first).alias("_b")).select(*keys, "ending", "_b.*")


def failover(sources: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """For each series the bars of the source that has most, the earlier source on ties (one that has none is passed over)."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    every = tagged[0]
    for s in tagged[1:]:
        every = every.unionByName(s, allowMissingColumns=True)
    sizes = every.groupBy(*keys, "_source").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy(*keys).agg(F.max_by("_source", F.struct("n", -F.col("_source"))).alias("_source"))
    return every.join(best, [*keys, "_source"]).drop("_source")


def blend(earlier: DataFrame, later: DataFrame, at: Column, keys: list[str] = KEYS) -> DataFrame:
    """Splices two series at a time: earlier bars up to it, later bars after it. The earlier piece's adj_close is rescaled by the
    ratio of the two at its last bar, where both have one."""
    a, b = earlier.where(F.col("ending") <= at), later.where(F.col("ending") > at)
    edge = a.groupBy(*keys).agg(F.max("ending").alias("ending"), F.max_by("adj_close", "ending").alias("_mine"))
    ratio = edge.join(later.select(*keys, "ending", F.col("adj_close").alias("_theirs")), [*keys, "ending"]).select(*keys, F.try_divide("_theirs", "_mine").alias("_r"))
    scaled = a.join(ratio, keys, "left").withColumn("adj_close", F.col("adj_close") * F.coalesce("_r", F.lit(1.0))).drop("_r")
    return scaled.unionByName(b)


def trim(bars: DataFrame, begin: Column, end: Column, pad_begin: int = 0, pad_end: int = 0, keys: list[str] = KEYS, ending: str = "ending") -> DataFrame:
    """Bars from begin to end (both included), with some bars more before and after."""
    b = bars.withColumn("_before", F.col(ending) < begin).withColumn("_after", F.col(ending) > end)
    back = F.row_number().over(W.partitionBy(*keys, "_before").orderBy(F.desc(ending)))
    on = F.row_number().over(W.partitionBy(*keys, "_after").orderBy(ending))
    b = b.withColumn("_back", back).withColumn("_on", on)
    inside = ~F.col("_before") & ~F.col("_after")
    return b.where(inside | (F.col("_before") & (F.col("_back") <= pad_begin)) | (F.col("_after") & (F.col("_on") <= pad_end))).select(*bars.columns)


def cleaned(bars: DataFrame, now: Column | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Daily bars without those of no volume, nor a last one without a close. With now, a last bar of the past five days has it as `asof`:
    it may still change."""
    some = bars.where(F.coalesce(F.col("volume"), F.lit(0.0)) != 0)
    some = some.withColumn("_last", F.max("ending").over(W.partitionBy(*keys)) == F.col("ending"))
    some = some.where(~(F.col("_last") & (F.coalesce(F.col("close"), F.lit(0.0)) == 0)))
    if now is None:
        return some.drop("_last")
    some = some.withColumn("_last", F.max("ending").over(W.partitionBy(*keys)) == F.col("ending"))
    return some.withColumn("asof", F.when(F.col("_last") & (F.col("ending") > now - F.make_dt_interval(days=F.lit(5))), now)).drop("_last")


def with_live(history: DataFrame, live: DataFrame, interval: str, keys: list[str] = KEYS) -> DataFrame:
    """History, and after it what live bars of a shorter interval come to. Live bars of a period that history's last bar stands for
    change that bar: its open stays, high and low widen, the close is theirs, and its volume, which counts them already, stays unless
    theirs is more. Live bars of earlier periods are left out."""
    edge = history.groupBy(*keys).agg(F.max("ending").alias("_edge"))
    of = live.withColumn("_seen", F.col("ending")).withColumn("ending", period_end(F.col("ending") - F.make_dt_interval(secs=F.lit(1)), interval))
    rolled = of.groupBy(*keys, "ending").agg(F.min_by("open", "_seen").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "_seen").alias("close"), F.sum("volume").alias("volume"))
    rolled = rolled.join(edge, keys, "left").where(F.col("_edge").isNull() | (F.col("ending") >= F.col("_edge"))).drop("_edge")
    new = rolled.select(*keys, "ending", F.struct("open", "high", "low", "close", "volume").alias("_n"))
    both = history.withColumn("_old", F.lit(True)).join(new, [*keys, "ending"], "full")
    here = F.col("_n").isNotNull()
    changed = {
        "open": F.coalesce("open", "_n.open"), "high": F.greatest("high", "_n.high"), "low": F.least("low", "_n.low"), "close": F.coalesce("_n.close", "close"),
        "volume": F.greatest("volume", "_n.volume"), "adj_close": F.when(here, F.col("_n.close")).otherwise(F.col("adj_close")),
    }
    return both.withColumns(changed).select(*history.columns)


def marked_incomplete(bars: DataFrame, now: Column, ending: str = "ending") -> DataFrame:
    """Adds `asof`: now on bars that haven't ended, else null."""
    return bars.withColumn("asof", F.when(now <= F.col(ending), now))
