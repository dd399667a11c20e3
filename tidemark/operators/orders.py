"""Orders against bars, positions over time, and what to trade to reach desired positions: joins, groups and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import workday
from ..sources.scratch import stored
from .asof import asof_join
from .touch import first_touch, numbered


def _traded(o: Column, h: Column, lo: Column, c: Column) -> Column:
    """The price at which an order trades in a bar: null if it doesn't."""
    kind, limit, buy = F.col("order_type"), F.col("limit"), F.col("action") == "BUY"
    within = lambda p: F.when((p >= lo) & (p <= h), p)
    good = lambda p: F.when(F.when(buy, p <= limit).otherwise(p >= limit), p)
    return (
        F.when(kind.isin("MKT", "MOO"), o)
        .when(kind == "MOC", c)
        .when(kind == "LOO", good(o))
        .when(kind == "LOC", good(c))
        .when(kind == "LMT", within(limit))
        .when(kind.isin("STP", "MIT"), within(F.col("stop")))
    )


def _waiting() -> tuple[Column, Column]:
    """What a waiting order looks at, and the price it waits for: bars that hold it (LMT, STP, MIT), or opens (LOO) or closes (LOC) that
    are no worse."""
    kind = F.col("order_type")
    side = F.when(F.col("action") == "BUY", "buy").otherwise("sell")
    looks = F.when(kind == "LOO", F.concat(F.lit("open "), side)).when(kind == "LOC", F.concat(F.lit("close "), side)).otherwise("range")
    return looks.alias("_looks"), F.when(kind.isin("STP", "MIT"), F.col("stop")).otherwise(F.col("limit")).cast("double").alias("x")


def _reaches() -> Column:
    """What a bar reaches, for each way of looking: an order to buy takes an open as high as its price, one to sell as low."""
    none = F.lit(None).cast("double")
    ways = {"range": ("_low", "_high"), "open buy": ("_open", None), "open sell": (None, "_open"), "close buy": ("_close", None), "close sell": (None, "_close")}
    cell = lambda c: none if c is None else F.col(c).cast("double")
    rows = [F.when(F.concat(*[F.col(c).cast("string") for c in ends if c]).isNotNull(), F.struct(F.lit(way).alias("_looks"), cell(ends[0]).alias("lo"), cell(ends[1]).alias("hi"))) for way, ends in ways.items()]
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def fills(orders: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """Each order with its first fill (traded_at, traded_price) and what became of it: filled, cancelled or working.

    orders: order_ref (unique), posted_at, action, quant, order_type, limit, stop, tif and the keys. Bars end after the order is posted;
    without one the order works on. DAY orders have the first bar only, IOC orders no more than its open, GTC orders all bars. MKT and MOO
    trade at the first open, MOC at the first close; LMT at its limit, STP and MIT at their stop, in the first bar that holds it; LOO and
    LOC in the first bar whose open or close is no worse than the limit, at that. Of what didn't trade, GTC orders of LMT, STP and MIT
    work on and all others are cancelled.

    The first bar is found as of the order's time. A GTC order that it leaves open finds its bar by `first_touch`, over gaps too."""
    prices = ("open", "high", "low", "close")
    b = numbered(bars.select(*keys, F.col("ending").alias("_ending"), *[F.col(c).alias(f"_{c}") for c in prices]), keys, "_ending")
    b = stored(b, "bars")  # like the orders, each step below needs them
    asked = asof_join(orders, b.withColumn("posted_at", F.col("_ending")), keys, "posted_at", "_first", forward=True, strict=True)
    first = {c: F.col(f"_first._{c}") for c in prices}
    at_once = F.when(F.col("tif") == "IOC", _traded(*[first["open"]] * 4)).otherwise(_traded(*first.values()))
    asked = stored(asked.withColumn("_at", F.col("_first._ending")).withColumn("_after", F.col("_first._pos")).withColumn("_price", at_once).drop("_first"), "orders")
    waits = F.col("order_type").isin("LMT", "STP", "MIT", "LOO", "LOC")
    left = asked.where(F.col("_at").isNotNull() & F.col("_price").isNull() & (F.col("tif") == "GTC") & waits).drop("_price")
    waiting = left.select("order_ref", *keys, "_after", *_waiting())
    ways = waiting.select(*keys, "_looks").distinct()  # a few for each series that is asked for
    reaches = b.select(*keys, "_pos", F.explode(_reaches()).alias("_r")).select(*keys, "_r._looks", "_pos", "_r.lo", "_r.hi").join(ways, [*keys, "_looks"], "left_semi")
    touched = left.drop("_after").join(first_touch(waiting, reaches, [*keys, "_looks"], "order_ref"), "order_ref")
    hit = touched.join(b, [*keys, "_pos"]).select("order_ref", F.struct("_ending", _traded(*[F.col(f"_{c}") for c in prices]).alias("_p")).alias("_f"))
    out = asked.join(hit, "order_ref", "left")
    now = F.col("_price").isNotNull()
    at, traded = F.when(now, F.col("_at")).otherwise(F.col("_f._ending")), F.coalesce("_price", "_f._p")
    open_ = F.col("_at").isNull() | ((F.col("tif") == "GTC") & F.col("order_type").isin("LMT", "STP", "MIT"))
    status = F.when(traded.isNotNull(), "filled").when(open_, "working").otherwise("cancelled")
    return out.select(*orders.columns, at.alias("traded_at"), traded.alias("traded_price"), status.alias("status"))


def combo_fills(legs: DataFrame, group: str = "combo_ref") -> DataFrame:
    """Legs filled at the same bar fill their combination; else none of them does."""
    every = legs.groupBy(group).agg(F.bool_and(F.col("status") == "filled").alias("_all"), (F.min("traded_at") == F.max("traded_at")).alias("_same"))
    ok = F.coalesce(F.col("_all") & F.col("_same"), F.lit(False))
    out = legs.join(every, group)
    return out.withColumn("status", F.when(ok, "filled").otherwise("working")).withColumn("traded_price", F.when(ok, F.col("traded_price"))).withColumn("traded_at", F.when(ok, F.col("traded_at"))).drop("_all", "_same")


def positions(trades: DataFrame, bars: DataFrame, keys: list[str], commission: float | Column = 0.0, multiplier: float = 1.0, minimum: float | Column = 0.0) -> DataFrame:
    """At each bar the position after its trades, its value, and the profit since the bar before (mark to market): the change of value,
    less what was bought, and what the trades cost, plus the dividend on the position that the bar began with.

    trades: keys, ending, quant (signed), price. commission: of each unit, and minimum: of each trade at least; numbers, or columns of
    trades (as first_match finds them). bars may have a dividend. Amounts are not rounded to cents.

    action says what the bar did: opened or added to (BTO, STO), closed or reduced (BTC, STC), turned to the other side (BOT, SLD), traded
    within the bar only (DAY), held (LONG, SHORT) or nothing."""
    fee = F.greatest(F.abs("quant") * (commission if isinstance(commission, Column) else F.lit(float(commission))), minimum if isinstance(minimum, Column) else F.lit(float(minimum)))
    t = trades.groupBy(*keys, "ending").agg(F.sum("quant").alias("quant"), F.sum(F.col("quant") * F.col("price")).alias("spent"), F.sum(fee).alias("commission"), F.sum(F.abs("quant")).alias("_total"))
    paid = F.coalesce("dividend", F.lit(0.0)) if "dividend" in bars.columns else F.lit(0.0)
    b = bars.select(*keys, "ending", "close", paid.alias("_paid")).join(t, [*keys, "ending"], "left").fillna(0.0, ["quant", "spent", "commission", "_total"])
    w = W.partitionBy(*keys).orderBy("ending")
    b = b.withColumn("position", F.sum("quant").over(w.rowsBetween(W.unboundedPreceding, 0)))
    b = b.withColumn("value", F.col("position") * F.col("close") * multiplier)
    before, held = (F.coalesce(F.lag(c).over(w), F.lit(0.0)) for c in ("value", "position"))
    b = b.withColumn("dividend", F.col("_paid") * held * multiplier)
    b = b.withColumn("mtm", F.col("value") - before - F.col("spent") * multiplier + F.col("dividend") - F.col("commission"))
    q, now = F.col("quant"), F.col("position")
    action = F.when((now == 0) & (F.col("_total") == 0), "").when((q == 0) & (now > 0), "LONG").when((q == 0) & (now < 0), "SHORT")
    action = action.when((held >= 0) & (now >= 0) & (q != 0), F.when(q > 0, "BTO").otherwise("STC")).when((held <= 0) & (now <= 0) & (q != 0), F.when(q < 0, "STO").otherwise("BTC"))
    return b.withColumn("action", action.when(q > 0, "BOT").when(q < 0, "SLD").otherwise("DAY")).drop("_paid", "_total")


def balances(positions_: DataFrame, deposits: DataFrame) -> DataFrame:
    """Net worth by time and currency: deposits so far and the sum of profits so far. positions: ending, currency, mtm; deposits:
    ending, currency, amount."""
    flow = positions_.groupBy("ending", "currency").agg(F.sum("mtm").alias("x")).unionByName(deposits.groupBy("ending", "currency").agg(F.sum("amount").alias("x")))
    daily = flow.groupBy("ending", "currency").agg(F.sum("x").alias("x"))
    w = W.partitionBy("currency").orderBy("ending").rowsBetween(W.unboundedPreceding, 0)  # one row a time
    return daily.withColumn("net", F.sum("x").over(w)).withColumn("peak", F.max("net").over(w)).drop("x")


def cash(positions_: DataFrame, deposits: DataFrame, settle_days: int | Column = 0, multiplier: float = 1.0, futures: Column | None = None) -> DataFrame:
    """By time and currency: net worth, cash that has settled, and cash that has accrued but not settled yet.

    What a position's bar brings in is its sales less its purchases, its dividend and its costs; of futures (where `futures` holds) it is
    the bar's profit. Unless it is 0 it accrues at once and settles some working days later at the same time of day, which has a row even
    if nothing else happens then. Deposits, and what futures bring, settle at once. positions: ending, currency and what `positions` returns;
    settle_days may be a column of them, null counts as 0. deposits: ending, currency, amount."""
    future = F.coalesce(F.lit(False) if futures is None else futures, F.lit(False))
    brought = F.when(future, F.col("mtm")).otherwise(F.col("dividend") - F.col("spent") * multiplier - F.col("commission"))
    days = F.when(future, 0).otherwise(F.coalesce(settle_days if isinstance(settle_days, Column) else F.lit(settle_days), F.lit(0)))
    p = positions_.select("ending", "currency", "mtm", brought.alias("_in"), days.cast("int").alias("_days"))
    p = p.groupBy("ending", "currency", "_days").agg(F.sum("mtm").alias("mtm"), F.sum("_in").alias("_in"))  # before rows are doubled
    entry = lambda at, net, settled, accrued: F.struct(at.alias("ending"), net.alias("net"), settled.alias("settled"), accrued.alias("accrued"))
    zero, now, brings = F.lit(0.0), F.col("ending"), F.col("_in")
    later = F.array(entry(now, F.col("mtm"), zero, brings), entry(workday(now, F.col("_days")), zero, brings, -brings))
    flows = p.select("currency", F.explode(F.when((F.col("_days") > 0) & (brings != 0), later).otherwise(F.array(entry(now, F.col("mtm"), brings, zero)))).alias("_f")).select("_f.ending", "currency", "_f.net", "_f.settled", "_f.accrued")
    paid = deposits.select("ending", "currency", F.col("amount").cast("double").alias("net"), F.col("amount").cast("double").alias("settled"), zero.alias("accrued"))
    daily = flows.unionByName(paid).groupBy("ending", "currency").agg(*[F.sum(c).alias(c) for c in ("net", "settled", "accrued")])
    w = W.partitionBy("currency").orderBy("ending").rowsBetween(W.unboundedPreceding, 0)  # one row a time
    return daily.select("ending", "currency", *[F.sum(c).over(w).alias(c) for c in ("net", "settled", "accrued")])


def cash_figures(balances_: DataFrame, currency: str | None = None) -> DataFrame:
    """At each time the settled and the accrued cash in one currency (without one: those whose rate is 1), and the total cash: both of
    them in a cash account, which has no margin in any currency, else those of all currencies at their rates, in units of the first
    local currency. balances: ending, currency, rate, settled, accrued and margin; the last two may be missing, nulls count as 0."""
    have = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in balances_.columns else F.lit(0.0)
    local = F.coalesce((F.col("currency") == currency) if currency else (F.col("rate") == 1), F.lit(False))
    margin = F.col("margin").isNotNull() if "margin" in balances_.columns else F.lit(False)
    both = have("settled") + have("accrued")
    sums = balances_.groupBy("ending").agg(
        F.sum(F.when(local, have("settled")).otherwise(0.0)).alias("settled_cash"), F.sum(F.when(local, have("accrued")).otherwise(0.0)).alias("accrued_cash"),
        F.bool_or(margin).alias("_margin"), F.sum(both * F.coalesce("rate", F.lit(0.0))).alias("_worth"), F.min_by(F.when(local, F.col("rate")), F.when(local, F.col("currency"))).alias("_rate"),
    )
    total = F.when(F.col("_margin"), F.try_divide("_worth", F.coalesce("_rate", F.lit(1.0)))).otherwise(F.col("settled_cash") + F.col("accrued_cash"))
    return sums.select("ending", "settled_cash", "accrued_cash", total.alias("total_cash"))


def netted(positions_: DataFrame, keys: list[str]) -> DataFrame:
    return positions_.groupBy(*keys).agg(F.sum("position").alias("position"))


def reconcile(desired: DataFrame, actual: DataFrame, keys: list[str], threshold: float = 0.0, threshold_pct: float = 0.0, close_unknown: bool = True) -> DataFrame:
    """The orders that lead from actual to desired positions: action and quant; none where the difference is below the threshold (in
    contracts, or in per cent of the desired position), or where a position nobody desires is to be left alone."""
    d = netted(desired, keys).withColumnRenamed("position", "desired")
    a = netted(actual, keys).withColumnRenamed("position", "actual")
    j = d.join(a, keys, "full").withColumn("known", F.col("desired").isNotNull()).fillna(0.0, ["desired", "actual"])
    diff = F.col("desired") - F.col("actual")
    small = (F.abs(diff) < threshold) | (F.abs(diff) * 100 < F.abs("desired") * threshold_pct)
    keep = (diff != 0) & ~(small & (F.col("desired") != 0)) & (F.col("known") | F.lit(close_unknown))
    return j.where(keep).select(*keys, "desired", "actual", F.when(diff > 0, "BUY").otherwise("SELL").alias("action"), F.abs(diff).alias("quant"))


def combined_legs(legs: DataFrame, group: str = "order_ref") -> DataFrame:
    """Legs as one order: the greatest common divisor of their quantities, and the net limit for one unit."""
    gcd = lambda x, y: F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(x.alias("a"), y.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))), lambda s: s["a"])
    q = legs.groupBy(group).agg(F.collect_list(F.col("quant").cast("long")).alias("_q"))
    unit = F.aggregate("_q", F.lit(0).cast("long"), lambda s, x: gcd(x, s))
    per = legs.join(q.select(group, unit.alias("unit")), group)
    side = F.when(F.col("action") == "BUY", 1).otherwise(-1)
    return per.groupBy(group).agg(F.first("unit").alias("quant"), F.sum(side * F.col("limit") * F.col("quant") / F.col("unit")).alias("limit"))


def allocation(balances_: DataFrame, allocation_pct: float = 100.0, peak_pct: float = 0.0, reserve: float = 0.0, least: float | None = None, most: float | None = None) -> DataFrame:
    """What may be invested at each time: a share of the net worth plus a share of its peak, less a reserve, within bounds."""
    a = F.col("net") * (allocation_pct / 100) + F.col("peak") * (peak_pct / 100) - reserve
    a = F.greatest(a, F.lit(0.0 if least is None else float(least)))
    return balances_.withColumn("net_allocation", a if most is None else F.least(a, F.lit(float(most))))
