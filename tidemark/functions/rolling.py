"""Functions over the rows retained so far, of one security or of all.

Rows have a `temporal` (time), a `seq` (rank within the time, by precedence) and an `index` (the security); `segment`, if given,
parts the time line. n counts times, not rows. A frame over all securities never needs one ordered pass over all rows, nor over all
times: what a time or a span of times adds is summed up first; totals of the spans before (one row a span) and of the rows before in
the span are put together. Frames of n times are windows over numbered spans of times that overlap by n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .medians import running

#: Times in one span of a frame of n times, at least.
SPAN = 4096


class Retained:
    """Retained rows with the columns that order them: `_time` numbers the times of a segment, `_span` holds an hour of them (or, of
    times that are numbers, 4,096 units)."""

    def __init__(self, df: DataFrame, temporal: str = "temporal", seq: str = "seq", index: str = "index", segment: list[str] | None = None):
        self.temporal, self.seq, self.index, self.segment = temporal, seq, index, segment or []
        df = df.drop("_time", "_span")
        kind = df.schema[temporal].dataType.typeName()
        span = F.date_trunc("hour", temporal) if kind.startswith("timestamp") else F.trunc(temporal, "month") if kind == "date" else F.floor(F.col(temporal) / SPAN)
        times = df.select(*self.segment, temporal).distinct().withColumn("_span", span)
        sizes = times.groupBy(*self.segment, "_span").agg(F.count(F.lit(1)).alias("_n"))
        w = W.partitionBy(*self.segment).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)  # one row a span
        sizes = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
        within = F.row_number().over(W.partitionBy(*self.segment, "_span").orderBy(temporal))
        numbered = times.withColumn("_within", within).join(sizes, [*self.segment, "_span"])
        numbered = numbered.select(*self.segment, temporal, "_span", (F.col("_first") + F.col("_within")).cast("long").alias("_time"))
        self.df = df.join(numbered, [*self.segment, temporal])

    @property
    def own(self):  # noqa: ANN201
        """The window of one security, by time."""
        return W.partitionBy(*self.segment, self.index).orderBy("_time")

    @property
    def here(self):  # noqa: ANN201
        """The rows before this one at the same time."""
        return W.partitionBy(*self.segment, self.temporal).orderBy(self.seq).rowsBetween(W.unboundedPreceding, -1)

    def times(self, *aggs: Column) -> DataFrame:
        return self.df.groupBy(*self.segment, "_time", "_span").agg(*aggs)

    def totals(self, made: dict[str, tuple[Column, Column, Callable[[str], Column], Callable[[Column, Column], Column]]]) -> DataFrame:
        """Columns over all rows so far, this one included. Each: what is taken over the rows of a span so far, what a span comes to, how
        spans are combined, and how the two are put together."""
        here = W.partitionBy(*self.segment, "_span").orderBy("_time", self.seq).rowsBetween(W.unboundedPreceding, 0)
        before = W.partitionBy(*self.segment).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)  # one row a span
        spans = self.df.groupBy(*self.segment, "_span").agg(*[whole.alias(f"_t{i}") for i, (_, whole, _, _) in enumerate(made.values())])
        spans = spans.select(*self.segment, "_span", *[combine(f"_t{i}").over(before).alias(f"_past{i}") for i, (_, _, combine, _) in enumerate(made.values())])
        df = self.df.withColumns({f"_here{i}": some.over(here) for i, (some, _, _, _) in enumerate(made.values())}).join(spans, [*self.segment, "_span"])
        df = df.withColumns({name: fold(F.col(f"_here{i}"), F.col(f"_past{i}")) for i, (name, (_, _, _, fold)) in enumerate(made.items())})
        return df.drop(*[f"_{n}{i}" for n in ("here", "past") for i in range(len(made))])

    def replaced(self, df: DataFrame) -> Retained:
        """With the same rows, under other columns."""
        out = object.__new__(Retained)
        out.__dict__.update(self.__dict__, df=df)
        return out

    def recent(self, of: DataFrame, combine, n: int) -> DataFrame:  # noqa: ANN001
        """of: one row a time with `_t` -> _time and `_past`, combined over the n times before."""
        size = max(SPAN, n)
        part = F.floor(F.col("_time") / size)
        dealt = of.withColumn("_part", F.explode(F.array(part, part + 1)))  # the next one looks back into it
        w = W.partitionBy(*self.segment, "_part").orderBy("_time").rangeBetween(-n, -1)
        return dealt.withColumn("_past", combine("_t").over(w)).where(F.col("_part") == part).select(*self.segment, "_time", "_past")

    # of this security

    def prev(self, name: str, column: str, default: object = None) -> DataFrame:
        return self.df.withColumn(name, F.lag(column, 1, default).over(self.own))

    def _prev(self, name: str, agg: Column, n: int | None, empty: Column) -> DataFrame:
        if n is None:
            return self.df.withColumn(name, empty)
        w = self.own.rangeBetween(-n, -1)
        return self.df.withColumn(name, F.coalesce(agg.over(w), empty))

    def count_prev(self, name: str, column: str, n: int | None = None, where: Column | None = None) -> DataFrame:
        return self._prev(name, F.count(F.when(_ok(where), F.col(column))), n, F.lit(0).cast("long"))

    def sum_prev(self, name: str, column: str, n: int | None = None, where: Column | None = None) -> DataFrame:
        return self._prev(name, F.sum(F.when(_ok(where), F.col(column))), n, F.lit(0.0))

    def max_prev(self, name: str, column: str, n: int | None = None, where: Column | None = None) -> DataFrame:
        return self._prev(name, F.max(F.when(_ok(where), F.col(column))), n, F.lit(None).cast("double"))

    def min_prev(self, name: str, column: str, n: int | None = None, where: Column | None = None) -> DataFrame:
        return self._prev(name, F.min(F.when(_ok(where), F.col(column))), n, F.lit(None).cast("double"))

    # of the rows before this one, and n times back

    def _before(self, agg, combine, value: Column, n: int | None, name: str) -> DataFrame:  # noqa: ANN001
        df = self.df.withColumn("_here", agg(value).over(self.here))
        if not n:
            return df.withColumn(name, F.col("_here")).drop("_here")
        past = self.recent(self.times(agg(value).alias("_t")), combine, n)
        return df.join(past, [*self.segment, "_time"], "left")

    def count_prec(self, name: str, column: str | None = None, n: int | None = None, where: Column | None = None) -> DataFrame:
        value = F.when(_ok(where), F.col(column) if column else F.lit(1))
        df = self._before(F.count, F.sum, value, n, name)
        return _folded(df, name, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))

    def sum_prec(self, name: str, column: str, n: int | None = None, where: Column | None = None) -> DataFrame:
        df = self._before(F.sum, F.sum, F.when(_ok(where), F.col(column)), n, name)
        return _folded(df, name, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))

    def max_prec(self, name: str, column: str, n: int | None = None, where: Column | None = None) -> DataFrame:
        return _folded(self._before(F.max, F.max, F.when(_ok(where), F.col(column)), n, name), name, F.greatest)

    def min_prec(self, name: str, column: str, n: int | None = None, where: Column | None = None) -> DataFrame:
        return _folded(self._before(F.min, F.min, F.when(_ok(where), F.col(column)), n, name), name, F.least)

    def prec(self, name: str, column: str, default: object = None) -> DataFrame:
        """The row before this one at the same time, else the last of the time before."""
        final = self.times(F.max_by(F.struct(F.col(column).alias("v")), self.seq).alias("_before"))
        final = final.select(*self.segment, (F.col("_time") + 1).alias("_time"), "_before")
        here = W.partitionBy(*self.segment, self.temporal).orderBy(self.seq)
        df = self.df.withColumn("_here", F.lag(F.struct(F.col(column).alias("v"))).over(here)).join(final, [*self.segment, "_time"], "left")
        got = F.coalesce("_here", "_before")
        return df.withColumn(name, F.when(got.isNull(), F.lit(default)).otherwise(got["v"])).drop("_here", "_before")

    def lookup(self, name: str, column: str, where: Column) -> DataFrame:
        """The value of the most recent row that matches, this one included."""
        found = F.when(where, F.struct(F.col(column).alias("v")))
        some, whole = F.last(found, ignorenulls=True), F.max_by(found, F.when(where, F.struct("_time", self.seq)))
        return self.totals({name: (some, whole, lambda t: F.last(t, ignorenulls=True), lambda a, b: F.coalesce(a, b)["v"])})

    # of all rows so far, this one included

    def count_total(self, name: str, x: Column | None = None) -> DataFrame:
        return self.totals({name: self._count(F.lit(1) if x is None else x)})

    def sum_total(self, name: str, x: Column) -> DataFrame:
        return self.totals({name: self._sum(x)})

    def min_total(self, name: str, x: Column) -> DataFrame:
        return self.totals({name: (F.min(x), F.min(x), F.min, F.least)})

    def max_total(self, name: str, x: Column) -> DataFrame:
        return self.totals({name: (F.max(x), F.max(x), F.max, F.greatest)})

    def _count(self, x: Column):  # noqa: ANN202
        return F.count(x), F.count(x), F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))

    def _sum(self, x: Column):  # noqa: ANN202
        return F.sum(x), F.sum(x), F.sum, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))

    def stdev_total(self, name: str, x: Column) -> DataFrame:
        """Of the population so far; 0 becomes 1. A value adds to the squared deviations what it is off the mean before it, squared, times
        n / (n + 1) for the n before it; these are sums of what is never negative, so large values close together lose nothing."""
        held = self.replaced(self.df.withColumn("_x", x.cast("double")))
        df = held.totals({"_s": self._sum(F.col("_x")), "_n": self._count(F.col("_x"))})
        n = F.col("_n") - 1
        off = F.col("_x") - (F.col("_s") - F.col("_x")) / n
        df = df.withColumn("_d", F.when(F.col("_x").isNotNull(), F.when(n > 0, off * off * (n / F.col("_n"))).otherwise(0.0)))
        df = self.replaced(df).totals({"_q": self._sum(F.col("_d"))})
        return df.withColumn(name, F.coalesce(F.nullif(F.sqrt(F.col("_q") / F.nullif("_n", F.lit(0))), F.lit(0.0)), F.lit(1.0))).drop("_x", "_s", "_n", "_d", "_q")

    def median_total(self, name: str, x: Column) -> DataFrame:
        """The mean of the two middle values when their number is even; see `medians`."""
        held = self.df.withColumn("_value", x)
        return running(held, ["_time", self.seq], "_value", name, self.segment).drop("_value")


def _ok(where: Column | None) -> Column:
    return F.lit(True) if where is None else where


def _folded(df: DataFrame, name: str, fold) -> DataFrame:  # noqa: ANN001
    """Joins what stands at the same time (_here) with what stands before (_past)."""
    if "_here" not in df.columns:
        return df.withColumn(name, fold(F.col(name), F.lit(None)))
    return df.withColumn(name, fold(F.col("_here"), F.col("_past"))).drop("_here", "_past")
