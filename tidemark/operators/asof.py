"""Joins in time: as-of joins by union and window, so that each side is shuffled once and nothing is paired off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _side(df: DataFrame, keys: list[str], on: str, is_left: bool, left_cols: list[str], right_cols: list[str], left: DataFrame, right: DataFrame) -> DataFrame:
    kind = lambda cols, src, mine: F.struct(*[F.col(c) for c in cols]) if mine else F.lit(None).cast(src.select(F.struct(*cols)).schema[0].dataType)
    return df.select(*keys, F.col(on).alias("_on"), F.lit(1 if is_left else 0).alias("_is_left"), kind(left_cols, left, is_left).alias("_left"), kind(right_cols, right, not is_left).alias("_right"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str, name: str, forward: bool = False, strict: bool = False, span: str | None = None) -> DataFrame:
    """Each left row with the right row of greatest `on` not after its own (forward: of least `on` not before it), as a struct column
    `name`, null if there is none. strict: an equal `on` doesn't count. Right rows should be unique by (keys, on).
    span (a unit of date_trunc; not forward): rows of a key are dealt by spans of time, each with the last right row of the spans before,
    so that no task holds a whole key. Else a key is one task's."""
    if span and forward:
        raise ValueError("spans look back only")
    left_cols, right_cols = left.columns, [c for c in right.columns if c not in keys]
    both = _side(left, keys, on, True, left_cols, right_cols, left, right).unionByName(_side(right, keys, on, False, left_cols, right_cols, left, right))
    # equal times: the right row stands first if it is to be seen, whichever way the window looks
    seen_first = F.col("_is_left") if not strict else -F.col("_is_left")
    order = [F.col("_on").desc(), seen_first] if forward else [F.col("_on"), seen_first]
    if span:
        both = both.withColumn("_span", F.date_trunc(span, "_on"))
        last = both.groupBy(*keys, "_span").agg(F.max_by("_right", F.when(F.col("_is_left") == 0, F.col("_on"))).alias("_right"))  # a row a span
        before = F.last("_right", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1))
        brought = last.withColumn("_right", before).withColumn("_is_left", F.lit(0)).where(F.col("_right").isNotNull())
        both = both.unionByName(brought, allowMissingColumns=True)  # without a time, so it stands first
    w = W.partitionBy(*keys, *(["_span"] if span else [])).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn(name, F.last("_right", ignorenulls=True).over(w)).where("_is_left = 1")
    return found.select("_left.*", name)


def with_intervals(fine: DataFrame, coarse: dict[str, DataFrame], keys: list[str], fine_name: str) -> DataFrame:
    """Points of several intervals: one row for each ending of the finest bars, or of a coarse bar that falls between them (with the
    last fine bar before it), and a struct column for each interval with its last bar by then."""
    out = fine.select(*keys, "ending", F.struct(*[c for c in fine.columns if c not in keys]).alias(fine_name))
    for name, bars in coarse.items():
        other = bars.select(*keys, "ending", F.struct(*[c for c in bars.columns if c not in keys]).alias(name))
        out = out.join(other, [*keys, "ending"], "full")
    w = W.partitionBy(*keys).orderBy("ending").rowsBetween(W.unboundedPreceding, 0)
    filled = out.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in (fine_name, *coarse)})
    return filled.where(F.col(fine_name).isNotNull())


def align(series: dict[str, DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """Several series on the union of their endings, each with its last bar by then, as struct columns."""
    out: DataFrame | None = None
    for name, df in series.items():
        s = df.select(*keys, "ending", F.struct(*columns).alias(name))
        out = s if out is None else out.join(s, [*keys, "ending"], "full")
    w = W.partitionBy(*keys).orderBy("ending").rowsBetween(W.unboundedPreceding, 0)
    return out.withColumns({name: F.last(name, ignorenulls=True).over(w) for name in series})


def first_match(left: DataFrame, rules: DataFrame, condition: Column, left_key: list[str], rule_order: str) -> DataFrame:
    """Each left row with the first rule (by rule_order) whose condition holds; rules are a small dimension, broadcast by Spark if its
    size says so."""
    rest = [c for c in rules.columns if c not in left.columns]
    joined = left.join(rules, condition, "left")
    own = [c for c in left.columns if c not in left_key]
    best = joined.groupBy(*left_key).agg(*[F.any_value(c).alias(c) for c in own], F.min_by(F.struct(*rest), rule_order).alias("_rule"))
    return best.select(*left.columns, "_rule.*")


def exchange_rate(rows: DataFrame, rates: DataFrame, base: str, quote: str, on: str, name: str, days: int = 7) -> DataFrame:
    """Adds what one unit of the base currency is in the quote currency at each row's time: by the last rate of the pair, no older than so
    many days; else by that of the inverse pair; else 1, as for a currency in itself.

    rates: base, quote, ending, close, one row a pair and ending. base, quote and on name columns of rows."""
    keys = ["_base", "_quote"]
    left = rows.withColumn("_base", F.col(base)).withColumn("_quote", F.col(quote))
    pair = lambda a, b: rates.select(F.col(a).alias("_base"), F.col(b).alias("_quote"), F.col("ending").alias(on), F.col("ending").alias("_ending"), "close")
    both = asof_join(asof_join(left, pair("base", "quote"), keys, on, "_direct", span="hour"), pair("quote", "base"), keys, on, "_inverse", span="hour")
    recent = lambda c: F.when(F.col(f"{c}._ending") >= F.col(on) - F.make_dt_interval(days=F.lit(days)), F.col(f"{c}.close"))
    rate = F.coalesce(recent("_direct"), F.try_divide(F.lit(1.0), recent("_inverse")), F.lit(1.0))
    same = F.col("_base") == F.col("_quote")
    return both.withColumn(name, F.when(same, 1.0).otherwise(rate)).select(*rows.columns, name)
