"""Corporate actions: adjustment factors, splits and dividends over time, and correlation between series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import asof_join

KEYS = ["symbol", "market"]


def split_ratio(text: Column) -> Column:
    """Shares after for each share before, of 'a:b' (a for b) or 'b/a'; 1 where either part is missing or 0."""
    slash = F.contains(text, F.lit("/"))
    parts = F.when(slash, F.reverse(F.split(text, "/"))).otherwise(F.split(text, ":"))
    a, b = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.coalesce(F.when((a != 0) & (b != 0), a / b), F.lit(1.0))


def adjustment_factors(actions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """actions (keys, exdate, dividend, split, cum_close), one row an exdate -> those with adj, adj_dividend_only and adj_split_only:
    what a price before the exdate is multiplied by, for it and every later action.

    cum_close is first brought to today's shares; a dividend takes its share of it off, a split divides. The products run from the
    latest action back, as sums of logarithms would, but exactly: a fold over each series' few actions, inside the JVM."""
    a = actions.select(*keys, F.struct("exdate", F.coalesce("dividend", F.lit(0.0)).alias("dividend"), F.coalesce("split", F.lit(1.0)).alias("split"), F.coalesce("cum_close", F.lit(0.0)).alias("cum_close")).alias("a"))
    grouped = a.groupBy(*keys).agg(F.sort_array(F.collect_list("a"), asc=False).alias("a"))  # one series' actions
    row = "struct<exdate:date,dividend:double,split:double,cum_close:double,adj:double,adj_dividend_only:double,adj_split_only:double>"
    start = F.struct(F.lit(1.0).alias("adj"), F.lit(1.0).alias("d"), F.lit(1.0).alias("s"), F.array().cast(f"array<{row}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["s"] / x["split"]
        close = x["cum_close"] / s
        share = F.when((x["dividend"] != 0) & (x["cum_close"] != 0), (close - x["dividend"]) / close).otherwise(1.0)
        adj, d = acc["adj"] / x["split"] * share, acc["d"] * share
        made = F.struct(x["exdate"].cast("date").alias("exdate"), x["dividend"].alias("dividend"), x["split"].alias("split"), close.alias("cum_close"), adj.alias("adj"), d.alias("adj_dividend_only"), s.alias("adj_split_only"))
        return F.struct(adj.alias("adj"), d.alias("d"), s.alias("s"), F.concat(acc["out"], F.array(made.cast(row))).alias("out"))

    return grouped.select(*keys, F.explode(F.aggregate("a", start, step, lambda acc: acc["out"])).alias("r")).select(*keys, "r.*")


#: A split of at most so many shares on the day of a dividend stands for a large dividend; splits by so much or more (or its
#: inverse) are in the dividends that a source reports for earlier days.
PSEUDO_SPLIT, IN_DIVIDENDS = 2, 3


def reported_factors(actions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Adjustment factors of actions as a source reports them: keys, exdate, dividend, split (a ratio as text, see split_ratio; null with a
    dividend) and cum_close, dividends and splits in rows of their own. One row an exdate comes out, as of adjustment_factors.

    From the latest action back: a day's split meets its dividend. A split above 1 and up to PSEUDO_SPLIT then is no split but the
    source's adjustment for a large dividend: it leaves no split behind, and the day's factors are those of the later days with the
    dividend alone; earlier dividends, and closes, are reported after it, and are scaled back. Earlier dividends are also scaled by each
    split that sources put into them."""
    ratio = split_ratio(F.coalesce("split", F.lit("1:1")))
    is_split = F.col("split").isNotNull().cast("int")
    item = F.struct("exdate", (1 - is_split).alias("turn"), F.coalesce("dividend", F.lit(0.0)).cast("double").alias("dividend"), ratio.alias("split"), F.coalesce("cum_close", F.lit(0.0)).cast("double").alias("cum_close"))
    grouped = actions.select(*keys, item.alias("a")).groupBy(*keys).agg(F.sort_array(F.collect_list("a"), asc=False).alias("a"))  # one series' actions
    row = "struct<exdate:date,dividend:double,split:double,cum_close:double,adj:double,adj_dividend_only:double,adj_split_only:double>"
    state = "struct<adj:double,d:double,s:double,y:double,out:array<" + row + ">>"
    start = F.struct(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.array().cast(f"array<{row}>")).cast(state)
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc["out"], F.lit(-1))
        again = F.coalesce(last["exdate"] == x["exdate"].cast("date"), F.lit(False))
        kept = F.when(again, F.slice(acc["out"], 1, F.size(acc["out"]) - 1)).otherwise(acc["out"])
        dividend = x["dividend"] * acc["y"] + F.when(again, last["dividend"]).otherwise(0.0)
        split = x["split"] * F.when(again, last["split"]).otherwise(1.0)
        met = F.struct(kept.alias("out"), dividend.alias("dividend"), split.alias("split"), (again & (dividend != 0) & (split > 1) & (split <= PSEUDO_SPLIT)).alias("pseudo"))

        def decided(m: Column) -> Column:
            later = F.try_element_at(m["out"], F.lit(-1))
            was = lambda name, field: F.when(m["pseudo"], F.coalesce(later[field], F.lit(1.0))).otherwise(acc[name])
            split = F.when(m["pseudo"], 1.0).otherwise(m["split"])
            scale = F.when(m["pseudo"] | (m["split"] >= IN_DIVIDENDS) | (m["split"] < 1 / IN_DIVIDENDS), m["split"]).otherwise(1.0)
            s = was("s", "adj_split_only") / m["split"]  # closes are reported after it either way
            begun = F.struct((was("adj", "adj") / split).alias("adj"), was("d", "adj_dividend_only").alias("d"), s.alias("s"), (acc["y"] * scale).alias("y"), split.alias("split"), (x["cum_close"] / s).alias("close"))

            def closed(b: Column) -> Column:
                share = F.when((m["dividend"] != 0) & (x["cum_close"] != 0), (b["close"] - m["dividend"]) / b["close"]).otherwise(1.0)
                made = F.struct(x["exdate"].cast("date"), m["dividend"], b["split"], b["close"], b["adj"] * share, b["d"] * share, b["s"]).cast(row)
                return F.struct(b["adj"] * share, b["d"] * share, b["s"], b["y"], F.concat(m["out"], F.array(made))).cast(state)

            return let(begun, closed)

        return let(met, decided)

    found = F.aggregate("a", start, step, lambda acc: acc["out"])
    return grouped.select(*keys, F.explode(found).alias("r")).select(*keys, "r.*")


def adjust(bars: DataFrame, factors: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """adj_close of each bar by the earliest action whose exdate is after the bar's day; none leaves the close."""
    on = bars.withColumn("_day", F.to_date("ending"))
    joined = asof_join(on, factors.withColumn("_day", F.col("exdate").cast("date")), keys, "_day", "_a", forward=True, strict=True)
    return joined.withColumn("adj_close", F.col("close") * F.coalesce("_a.adj", F.lit(1.0))).drop("_a", "_day")


def _in_range(points: DataFrame, actions: DataFrame, keys: list[str], ref: str, exdate: str) -> DataFrame:
    """Each point (with a row id) and the actions between its two dates, the earlier excluded, the later included."""
    p = points.withColumn("_lo", F.least(ref, exdate)).withColumn("_hi", F.greatest(ref, exdate)).withColumn("_back", F.col(ref) > F.col(exdate))
    a = actions.select(*keys, F.col("exdate").alias("_ex"), F.coalesce("split", F.lit(1.0)).alias("_split"), F.coalesce("dividend", F.lit(0.0)).alias("_div"))
    return p.join(a, [*[p[k] == a[k] for k in keys], a["_ex"] > p["_lo"], a["_ex"] <= p["_hi"]], "left").select(*[p[c] for c in p.columns], "_ex", "_split", "_div")


def with_split(points: DataFrame, actions: DataFrame, row: str, ref: str, exdate: str, name: str = "split", keys: list[str] = KEYS) -> DataFrame:
    """Shares on exdate for each share on the reference date; the reciprocal if the dates are the other way round."""
    found = _in_range(points, actions, keys, ref, exdate).groupBy(row).agg(F.product(F.coalesce("_split", F.lit(1.0))).alias("_p"), F.first("_back").alias("_b"))
    return points.join(found.select(row, F.when(F.col("_b"), 1 / F.col("_p")).otherwise(F.col("_p")).alias(name)), row)


def with_dividend(points: DataFrame, actions: DataFrame, row: str, ref: str, exdate: str, rate: float = 0.0, name: str = "dividend", keys: list[str] = KEYS) -> DataFrame:
    """Dividends between the dates for each share held on the reference date: discounted by the rate, times the splits before them;
    if the dates are the other way round, what the holder would have had to give."""
    hits = _in_range(points, actions, keys, ref, exdate)
    value = F.col("_div") * F.exp(F.datediff(F.col(ref), F.col("_ex")) * (rate / 365))
    listed = hits.groupBy(row).agg(F.first("_back").alias("_b"), F.sort_array(F.collect_list(F.when(F.col("_ex").isNotNull(), F.struct("_ex", value.alias("v"), F.col("_split").alias("s"))))).alias("_a"))
    forth = F.aggregate(F.reverse("_a"), F.lit(0.0), lambda d, x: (d + x["v"]) * x["s"])
    back = F.aggregate("_a", F.lit(0.0), lambda d, x: d / x["s"] - x["v"])
    return points.join(listed.select(row, F.when(F.col("_b"), back).otherwise(forth).alias(name)), row)


def max_correlation(rows: DataFrame, value: str, n: int, temporal: str = "temporal", index: str = "index", seq: str = "seq", where: Column | None = None) -> DataFrame:
    """For each row the largest correlation, over the last n times, between its series and those of the rows before it at the same
    time; 0 if there is none. Pairs are of series, joined on the time; `where` says which rows before count."""
    ok = F.lit(True) if where is None else where
    one = rows.select(F.col(temporal), F.col(index).alias("_i"), F.col(seq).alias("_s"), F.col(value).alias("_x"), ok.alias("_ok_i"))
    two = rows.select(F.col(temporal), F.col(index).alias("_j"), F.col(seq).alias("_t"), F.col(value).alias("_y"), ok.alias("_ok_j"))
    pairs = one.join(two, temporal).where("_i < _j")  # each pair of series once; it counts for the one that stands later at the time
    w = W.partitionBy("_i", "_j").orderBy(temporal).rowsBetween(-(n - 1), 0)
    later = F.when(F.col("_t") < F.col("_s"), F.struct(F.col("_i").alias("k"), F.col("_ok_j").alias("ok"))).when(F.col("_s") < F.col("_t"), F.struct(F.col("_j").alias("k"), F.col("_ok_i").alias("ok")))
    c = pairs.withColumn("_c", F.corr("_x", "_y").over(w)).withColumn("_l", later).where("_l.ok").groupBy(F.col("_l.k").alias("_i"), temporal).agg(F.max("_c").alias("max_correl"))
    joined = rows.join(c.withColumnRenamed("_i", index), [index, temporal], "left")
    return joined.withColumn("max_correl", F.coalesce("max_correl", F.lit(0.0)))
