"""Derived series: expressions over aligned inputs and rolling regressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.lookback import last

OUTPUT = ("open", "high", "low", "close", "volume", "adj_close")


def model(inputs: DataFrame, output: dict[str, Column], symbol: str, market: str, now: Column | None = None) -> DataFrame:
    """Bars of a derived series: each output is an expression over the inputs' struct columns (see operators.asof.align); rows where
    the close is null are no bars. With `now` the last, unfinished bar is marked."""
    out = inputs.select(F.lit(symbol).alias("symbol"), F.lit(market).alias("market"), "ending", *[output.get(c, F.lit(None).cast("double")).cast("double").alias(c) for c in OUTPUT])
    out = out.where("close is not null").withColumn("adj_close", F.coalesce("adj_close", "close"))
    return out if now is None else out.withColumn("asof", F.when(now <= F.col("ending"), now))


def ratio(inputs: DataFrame, a: str, b: str, symbol: str, market: str) -> DataFrame:
    return model(inputs, {c: F.try_divide(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in ("open", "high", "low", "close", "adj_close")}, symbol, market)


def with_regression(df: DataFrame, y: Column, x: Column, n: int, w: WindowSpec) -> DataFrame:
    """Slope and intercept of y on x over the last n rows."""
    frame = last(n, w)
    return df.withColumn("slope", F.regr_slope(y, x).over(frame)).withColumn("intercept", F.regr_intercept(y, x).over(frame))


def with_multiple_regression(df: DataFrame, y: str, xs: list[str], n: int, w: WindowSpec, name: str = "coefficients") -> DataFrame:
    """Coefficients (intercept first) of y on several columns over the last n rows: null where there are no more rows than columns, or where
    the columns depend on each other. Rows with a null or non-finite value don't count.

    The normal equations of the centred columns are window aggregates; they are solved by elimination, a column of the frame at a time."""
    frame, k = last(n, w), len(xs)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf"))
    whole = finite(y)
    for x in xs:
        whole = whole & finite(x)
    value = {c: F.when(whole, F.col(c).cast("double")) for c in (y, *xs)}
    made = {"_n": F.count(F.when(whole, 1)).over(frame), **{f"_m{i}": F.avg(value[x]).over(frame) for i, x in enumerate((*xs, y))}}
    for i, a in enumerate(xs):
        made |= {f"_a{i}_{j}": F.covar_pop(value[a], value[b]).over(frame) for j, b in enumerate((*xs, y)) if j >= i}
    out = df.withColumns(made).withColumns({f"_a{i}_{j}": F.col(f"_a{j}_{i}") for i in range(k) for j in range(i)})
    ok = F.col("_n") > k
    out = out.withColumns({f"_v{i}": F.col(f"_a{i}_{i}") for i in range(k)})
    for p in range(k):  # no exchange of rows: pivots of such a matrix are positive, unless a column depends on those before it
        ok = ok & (F.col(f"_a{p}_{p}") > F.col(f"_v{p}") * 1e-6)
        rows = {}
        for i in range(k):
            if i != p:
                rows |= {f"_a{i}_{j}": F.col(f"_a{i}_{j}") - F.try_divide(F.col(f"_a{i}_{p}") * F.col(f"_a{p}_{j}"), F.col(f"_a{p}_{p}")) for j in range(p + 1, k + 1)}
        out = out.withColumns(rows)
    slopes = [F.try_divide(F.col(f"_a{i}_{k}"), F.col(f"_a{i}_{i}")) for i in range(k)]
    intercept = F.col(f"_m{k}")
    for i, slope in enumerate(slopes):
        intercept = intercept - slope * F.col(f"_m{i}")
    return out.withColumn(name, F.when(ok, F.array(intercept, *slopes))).select(*df.columns, name)


def matched(assets: DataFrame, symbol: str, market: str, interval: str) -> DataFrame:
    """The model that stands for a symbol: of the assets (market, symbol, symbol_pattern, intervals: array, and what else) of the market,
    those that name the interval or none, and the symbol, a pattern that it matches, or neither; of several the one of shortest name."""
    name, pattern = F.col("symbol"), F.col("symbol_pattern")
    fits = (F.col("market") == market) & (F.col("intervals").isNull() | F.array_contains("intervals", interval)) & (name.isNull() | (name == "") | (name == symbol))
    fits = fits & (pattern.isNull() | (pattern == "") | F.regexp_like(F.lit(symbol), pattern))
    called = F.coalesce(F.nullif(pattern, F.lit("")), F.nullif(name, F.lit("")), F.lit(""))
    return assets.where(fits).orderBy(F.length(called), called).limit(1)


def evaluated(expressions: dict[str, Callable[[dict[str, object]], object]], parameters: dict[str, object]) -> dict[str, object]:
    """A model's parameters: its expressions, each a function of the parameters, the evaluated ones before it included, over those given."""
    out = dict(parameters)
    for name, e in expressions.items():
        out[name] = e(out)
    return out
