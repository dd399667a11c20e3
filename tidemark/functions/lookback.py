"""Functions of the last n bars of one series, as window columns.

`w` is a window with a partition by series (and segment) and an order by time. Early rows use the bars there are, as a frame of
`n - 1 preceding and current row` does. Results are plain columns of the frame they are added to; to nest them, add the inner one
first (Spark takes no window function inside another). Each says how many bars it looks back, so that a query can read no more.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import number, time
from .reach import UNBOUNDED, looks_back


def positive(n: int, name: str) -> int:
    if not isinstance(n, int) or n <= 0:
        raise ValueError(f"{name} takes a positive integer, not {n!r}")
    return n


def last(n: int, w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def values(n: int, x: Column, w: WindowSpec) -> Column:
    """The last n values, oldest first, null as 0."""
    return F.collect_list(number(x)).over(last(n, w))


@looks_back(lambda n, *_: n)
def offset(n: int, x: Column, w: WindowSpec) -> Column:
    return F.lag(x, positive(n, "offset")).over(w)


@looks_back(lambda n, *_: n - 1)
def highest(n: int, x: Column, w: WindowSpec) -> Column:
    return F.max(x).over(last(positive(n, "highest"), w))


@looks_back(lambda n, *_: n - 1)
def lowest(n: int, x: Column, w: WindowSpec) -> Column:
    return F.min(x).over(last(positive(n, "lowest"), w))


@looks_back(lambda n, *_: n - 1)
def direction(n: int, x: Column, w: WindowSpec) -> Column:
    """1 or -1 as the current value is above or below the last different one among n; 0 if there is none."""
    other = F.filter(values(positive(n, "direction"), x, w), lambda v: v != number(x))
    return F.when(F.size(other) == 0, 0).when(F.try_element_at(other, F.size(other)) < number(x), 1).otherwise(-1)


@looks_back(lambda n, *_: n - 1)
def age_of_high(n: int, x: Column, w: WindowSpec) -> Column:
    """Bars since the first of the highest values among n."""
    v = values(positive(n, "age_of_high"), x, w)
    return (F.size(v) - F.array_position(v, F.array_max(v))).cast("int")


@looks_back(lambda n, *_: n - 1)
def sma(n: int, x: Column, w: WindowSpec) -> Column:
    return F.avg(number(x)).over(last(positive(n, "sma"), w))


@looks_back(lambda n, *_: 10 * n - 1 if n > 1 else 0)
def ema(n: int, x: Column, w: WindowSpec) -> Column:
    """Over the last 10 n values; starts from the mean of the first n of them."""
    if positive(n, "ema") == 1:
        return x
    v, a = values(10 * n, x, w), 2 / (n + 1)
    first = F.slice(v, 1, n)
    seed = F.aggregate(first, F.lit(0.0), lambda s, y: s + y) / F.size(first)
    return F.aggregate(F.slice(v, n + 1, 10 * n), seed, lambda m, y: y * a + m * (1 - a))


def _changes(x: Column, w: WindowSpec) -> Column:
    return number(x) - F.lag(number(x)).over(w)


def with_profit_factor(df: DataFrame, name: str, n: int, x: Column, w: WindowSpec) -> DataFrame:
    """Gains over losses of the last n changes; null without a loss."""
    frame = last(positive(n, "profit_factor"), w)
    step = df.withColumn("_change", _changes(x, w))
    gain = F.sum(F.when(F.col("_change") > 0, F.col("_change")).otherwise(0.0)).over(frame)
    loss = F.sum(F.when(F.col("_change") < 0, -F.col("_change")).otherwise(0.0)).over(frame)
    return step.withColumn(name, F.try_divide(gain, loss)).drop("_change")


@looks_back(lambda n, *_: n - 1)
def regression_slope(n: int, x: Column, i: Column, w: WindowSpec) -> Column:
    """100 times the slope over the mean; i: the bar's number in the series."""
    frame = last(positive(n, "regression_slope"), w)
    return F.try_divide(F.regr_slope(number(x), i.cast("double")).over(frame) * 100, F.avg(number(x)).over(frame))


@looks_back(lambda n, *_: n - 1)
def r_squared(n: int, x: Column, i: Column, w: WindowSpec) -> Column:
    return F.regr_r2(number(x), i.cast("double")).over(last(positive(n, "r_squared"), w)) * 100


@looks_back(lambda n, *_: n - 1)
def stdev(n: int, x: Column, w: WindowSpec) -> Column:
    """Of the population; 0 becomes 1."""
    s = F.stddev_pop(number(x)).over(last(positive(n, "stdev"), w))
    return F.coalesce(F.nullif(s, F.lit(0.0)), F.lit(1.0))


@looks_back(lambda n, *_: n + 249)
def rsi(n: int, x: Column, w: WindowSpec) -> Column:
    """Wilder's, over the last n + 250 values; smoothing starts from the mean of the first n changes; without a loss 100."""
    v = values(positive(n, "rsi") + 250, x, w)
    change = F.zip_with(F.slice(v, 2, n + 250), F.slice(v, 1, n + 250), lambda b, a: b - a)
    change = F.filter(change, lambda c: c.isNotNull())

    def step(s: Column, c: Column) -> Column:
        """Sums up the first n changes, smooths from their mean on: both sides in one pass."""
        k = s["k"]
        side = lambda was, x: F.when(k < n, was + x).when(k == n, (was / n * (n - 1) + x) / n).otherwise((was * (n - 1) + x) / n)
        return F.struct((k + 1).alias("k"), side(s["up"], F.greatest(c, F.lit(0.0))).alias("up"), side(s["down"], F.greatest(-c, F.lit(0.0))).alias("down"))

    def ratio(s: Column) -> Column:
        few = F.when(s["k"] <= n, F.nullif(s["k"], F.lit(0)).cast("double")).otherwise(1.0)
        gain, loss = s["up"] / few, s["down"] / few
        return F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))

    return F.aggregate(change, F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down")), step, ratio)


def _returns(n: int, x: Column, w: WindowSpec) -> Column:
    v = values(n + 1, x, w)
    r = F.zip_with(F.slice(v, 2, n + 1), F.slice(v, 1, n + 1), lambda b, a: F.try_divide(b - a, a))
    return F.slice(r, 1, F.greatest(F.size(v) - 1, F.lit(0)))


def _mean_sd(r: Column) -> tuple[Column, Column]:
    """Mean and sample deviation of an array."""
    n = F.size(r).cast("double")
    mean = F.try_divide(F.aggregate(r, F.lit(0.0), lambda s, y: s + y), n)
    square = F.aggregate(r, F.lit(0.0), lambda s, y: s + (y - mean) * (y - mean))
    return mean, F.sqrt(F.try_divide(square, F.nullif(n - 1, F.lit(0.0))))


def with_value_at_risk(df: DataFrame, name: str, pct: int, n: int, x: Column, w: WindowSpec, beyond: bool = False) -> DataFrame:
    """The return at a percentile of the normal curve through the last n returns, negated up to the 50th; no return: 0. With `beyond`
    the mean of the returns past it, or that value if there are none. Steps are columns of their own, so that none is computed anew
    for each element."""
    z = NormalDist().inv_cdf(positive(pct, name) / 100)
    r = df.withColumn("_r", _returns(positive(n, name), x, w))
    mean, sd = _mean_sd(F.col("_r"))
    r = r.withColumn("_risk", F.coalesce(sd, F.lit(0.0)) * z + mean)
    out = F.col("_risk")
    if beyond:
        r = r.withColumn("_past", F.filter("_r", (lambda y: y < F.col("_risk")) if z <= 0 else (lambda y: y > F.col("_risk"))))
        out = F.coalesce(F.try_divide(F.aggregate("_past", F.lit(0.0), lambda s, y: s + y), F.size("_past").cast("double")), out)
    return r.withColumn(name, F.when(F.size("_r") == 0, 0.0).otherwise(-out if z <= 0 else out)).drop("_r", "_risk", "_past")


def same_time_of_day(keys: list[str], ending: Column, order: str) -> WindowSpec:
    """A window over the bars at the same time of day, for any function of this module."""
    return W.partitionBy(*keys, time(ending)).orderBy(order)


@looks_back(lambda *_: UNBOUNDED)
def in_session(value: Column, ending: Column, opens: str, closes: str, w: WindowSpec) -> Column:
    """A value computed on the bars of normal hours alone (open < time <= close), carried on to the bars outside them."""
    inside = (time(ending) > opens) & (time(ending) <= closes)
    return F.last(F.when(inside, value), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def since(keys: list[str], ending: Column, x: Column, anchor: Column, most: int, reduce: Callable[[Column], Column], days: int) -> Column:
    """reduce(array) over the values of the first `most` bars of a series after an anchor, which lies no more than `days` times 24
    hours back. The frame is of time, so that it reaches the anchor however many bars lie between."""
    w = W.partitionBy(*keys).orderBy(F.unix_micros(ending)).rangeBetween(-positive(days, "since") * 86_400_000_000, 0)
    recent = F.collect_list(F.struct(ending.alias("t"), number(x).alias("x"))).over(w)
    after = F.slice(F.filter(recent, lambda b: b["t"] > anchor), 1, most)
    return reduce(F.transform(after, lambda b: b["x"]))


def workdays_span(days: int) -> int:
    """The most days from the start of a day n weekdays ago to the end of today."""
    return positive(days, "workdays_span") + 2 * (days // 5 + 1) + 1


def days_ago(ending: Column, days: int) -> Column:
    """The anchor of the past n times 24 hours, two days more on Sundays and Mondays."""
    extra = F.when(F.dayofweek(ending) <= 2, positive(days, "days_ago") + 2).otherwise(days)
    return ending - F.make_dt_interval(days=extra)


@looks_back(lambda *_: 0)
def bollinger(n: int, deviations: float, x: Column, w: WindowSpec) -> tuple[Column, Column, Column]:
    """Lower band, middle and upper band."""
    m, s = sma(n, x, w), stdev(n, x, w)
    return m - s * deviations, m, m + s * deviations


@looks_back(lambda *_: 0)
def stochastic(n: int, high: Column, low: Column, close: Column, w: WindowSpec) -> Column:
    lo, hi = lowest(n, low, w), highest(n, high, w)
    return F.try_divide(number(close) - lo, hi - lo) * 100


@looks_back(lambda *_: 0)
def macd(fast: int, slow: int, x: Column, w: WindowSpec) -> Column:
    return ema(fast, x, w) - ema(slow, x, w)
