"""Row-local functions, windows and indicators on literal values."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import common as fn
from tidemark.functions import indicators as ind
from tidemark.functions import lookback as lb


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x




def test_arithmetic_takes_null_as_zero(spark):
    null = F.lit(None).cast("double")
    cases = [
        (fn.add(null, 2), 2), (fn.subtract(1, null), 1), (fn.product(2, 3, null), 0), (fn.divide(1, 0), None), (fn.divide(1, null), None), (fn.divide(6, 4), 1.5),
        (fn.mod(8, 3), 2), (fn.mod(8, -3), -1), (fn.mod(-8, 3), 1), (fn.mod(1, 0), None), (fn.power(2, 10), 1024), (fn.power(0, -1), None), (fn.sqrt(-1), None), (fn.sqrt(9), 3),
        (fn.ln(0), None), (fn.exp(1000), None), (fn.absolute(null), 0), (fn.sign(-4), -1), (fn.sign(null), None), (fn.ceiling(2.1), 3), (fn.ceiling(21, 5.0), 25), (fn.floor(-2.1), -3),
        (fn.round_half_away(-2.5), -3), (fn.round_half_away(2.345, 2), 2.35), (fn.trunc(-2.7), -2), (fn.change(110, 100), 10), (fn.change(1, 0), None), (fn.negative(null), 0),
        (fn.maximum(null, F.lit(-5.0)), None), (fn.maximum(null, F.lit(5.0)), 5), (fn.minimum(null, F.lit(5.0)), None), (fn.minimum(F.lit(5.0), null), 5), (fn.maximum(1, null, 3), 3),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for i, (_, want) in enumerate(cases):
        assert row[i] == (want if want is None else pytest.approx(want)), i


def test_logic_returns_operands(spark):
    null = F.lit(None).cast("double")
    cases = [
        (fn.and_(F.lit(2.0), F.lit(5.0)), 5), (fn.and_(F.lit(0.0), F.lit(5.0)), 0), (fn.and_(null, F.lit(5.0)), None), (fn.or_(F.lit(0.0), F.lit(7.0)), 7), (fn.or_(F.lit(3.0), F.lit(7.0)), 3),
        (fn.not_(null), 1), (fn.xor(1, 1, 1), 1), (fn.equals(null, null), 1), (fn.equals(null, F.lit(0.0)), 0), (fn.less_than(null, 1), 1), (fn.not_less_than(null, 0), 1), (fn.if_(0, 1, 0, 2), None), (fn.if_(0, 1, 9), 9),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert [row[i] for i in range(len(cases))] == [w for _, w in cases]


def test_text_and_dates(spark):
    t = F.lit("2014-03-01 15:30:15").cast("timestamp")
    cases = [
        (fn.left(F.lit("abc"), 2), "ab"), (fn.left(F.lit("abc"), -1), ""), (fn.right(F.lit("abc"), 2), "bc"), (fn.mid(F.lit("abcd"), 2, 2), "bc"), (fn.mid(F.lit("abcd"), 0, 2), None), (fn.concat("a", None, 1), "a1"),
        (fn.replace(F.lit("abcdef"), 3, 2, "X"), "abXef"), (fn.search("C", F.lit("abc")), 3), (fn.search("z", F.lit("abc")), None), (fn.trim(F.lit("  a   b ")), "a b"), (fn.trim(F.lit("")), None), (fn.number_value(F.lit("12.5kg")), 12.5),
        (fn.number_value(F.lit("kg")), None), (fn.text(F.lit(1234.5), ",.2f"), "1,234.50"), (fn.text(F.lit(0.256), ".1%"), "25.6%"), (fn.text(t, "YYYY-MM-DD HH:mm"), "2014-03-01 15:30"), (fn.date(t), "2014-03-01"), (fn.time(t), "15:30:15"),
        (fn.weekday(t), 7), (fn.weeknum(t), 9), (fn.weeknum(F.lit("2014-12-29").cast("timestamp")), 1), (fn.weeknum(t, 2), 9), (fn.date_value(F.lit("1900-01-01").cast("timestamp")), 1), (fn.hour(t), 15.504166667), (fn.time_value(t), 0.646006944),
        (fn.date(fn.workday(t, 1)), "2014-03-03"), (fn.date(fn.workday(t, -1)), "2014-02-27"), (fn.date(fn.edate(F.lit("2014-01-31").cast("timestamp"), 1)), "2014-02-28"), (fn.date(fn.edate(t, "P1Y2M")), "2015-05-01"),
        (fn.networkdays(F.lit("2014-03-03"), F.lit("2014-03-10")), 6), (fn.networkdays(F.lit("2014-03-10"), F.lit("2014-03-03")), -6), (fn.days(F.lit("2014-03-03 12:00:00"), F.lit("2014-03-01 13:00:00")), 1), (fn.datetime(t), "2014-03-01T15:30:15.000Z"),
        (fn.date_of(2014, 3, 5), "2014-03-05"), (fn.time(t, "America/New_York"), "10:30:15"), (fn.length(F.lit(None).cast("string")), None),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for i, (_, want) in enumerate(cases):
        assert row[i] == (pytest.approx(want, abs=1e-8) if isinstance(want, float) else want), (i, row[i], want)


def test_durations():
    assert fn.duration("P1Y2M") == (14, 0, 0.0) and fn.duration("-P1W") == (0, -7, 0.0) and fn.duration("PT5M") == (0, 0, 300.0)
    with pytest.raises(ValueError):
        fn.duration("5 days")


def test_normal_and_options(spark):
    row = spark.range(1).select(fn.normsdist(1.96), fn.normsdist(-9), fn.normsinv(0.975), fn.normsinv(0), fn.black_scholes(100, 100, 365, 20, 5, "C"), fn.black_scholes(100, 100, 365, 20, 5, "P")).first()
    assert row[0] == pytest.approx(0.9750021048517795, abs=1e-12) and row[1] == pytest.approx(1.1285884059538e-19, rel=1e-6)
    assert row[2] == pytest.approx(1.959963984540054, abs=1e-7) and row[3] is None
    assert row[4] == pytest.approx(10.4506, abs=1e-4) and row[4] - row[5] == pytest.approx(100 - 100 * math.exp(-0.05), abs=1e-9)
    assert one(spark, fn.implied_volatility(10.450583572185565, 100, 100, 365, 5, "C")) == pytest.approx(20, abs=1e-6)
    assert one(spark, fn.implied_volatility(fn.black_scholes(90, 110, 200, 35, 3, "P"), 90, 110, 200, 3, "P")) == pytest.approx(35, abs=1e-6)
    assert one(spark, fn.implied_volatility(5, 100, 0, 30, 1, "C")) == pytest.approx(1e-3) and one(spark, fn.implied_volatility(5, 0, 100, 30, 1, "C")) == pytest.approx(1e3)
    assert one(spark, fn.implied_volatility(5, 100, 90, 0, 1, "C")) == pytest.approx(1e-3) and one(spark, fn.implied_volatility(50, None, None, None, None, "C")) == pytest.approx(1e3)


def series(spark, values, **more):
    rows = [("a", "m", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), *[float(c[i]) for c in more.values()], float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, market string, ending timestamp, " + "".join(f"{k} double, " for k in more) + "close double")


W1 = lambda: W.partitionBy("symbol", "market").orderBy("ending")
C = lambda: F.col("close")


def last(df, c):
    return df.select("ending", c.alias("x")).orderBy(F.desc("ending")).first().x


def test_regression_literals(spark):
    df = series(spark, [357.14, 53.57, 48.78, 10.48]).withColumn("i", F.row_number().over(W1()))
    assert last(df, lb.regression_slope(4, C(), F.col("i"), W1())) == pytest.approx(-88.92, abs=0.005)
    assert last(df, lb.r_squared(4, C(), F.col("i"), W1())) == pytest.approx(70.25, abs=0.005)


def test_lookback_edges(spark):
    df = series(spark, [1, 3, 3, 2, 2])
    assert last(df, lb.direction(5, C(), W1())) == -1 and last(df, lb.age_of_high(5, C(), W1())) == 3
    assert last(series(spark, [4, 4]), lb.stdev(5, C(), W1())) == 1 and last(series(spark, [4, 4]), lb.direction(5, C(), W1())) == 0
    assert last(series(spark, [1, 2, 3]), lb.rsi(2, C(), W1())) == 100
    assert last(series(spark, [5]), lb.ema(3, C(), W1())) == 5
    with pytest.raises(ValueError):
        lb.sma(0, C(), W1())


def test_parabolic_stop_by_hand(spark):
    highs, lows, closes = [10, 11, 12, 11], [9, 10, 11, 8], [9.5, 10.5, 11.5, 8.5]
    df = series(spark, closes, open=closes, high=highs, low=lows, volume=[1, 1, 1, 1], adj_close=closes).select("symbol", "market", "ending", "open", "high", "low", "close", "volume", "adj_close")

    def by_hand():
        up, stop, ep, af = False, 10.0, 9.0, 0.02
        for h, lo in zip(highs, lows, strict=True):
            extended = h > ep if up else lo < ep
            ep2, a = (max(ep, h) if up else min(ep, lo)), min(af + 0.02, 0.2) if extended else af
            s = stop + a * (ep2 - stop)
            if lo >= s if up else h <= s:
                stop, ep, af = s, ep2, a
            else:
                far = ep2 - 0.02 * (ep2 - lo) if up else ep2 + 0.02 * (h - ep2)
                up, stop, ep, af = not up, far, (lo if up else h), 0.02
        return stop

    assert ind.with_parabolic_sar(df, "x", 0.02, 0.2, 10, W1()).orderBy(F.desc("ending")).first().x == pytest.approx(by_hand())
    with pytest.raises(ValueError):
        ind.with_stop_and_buy(df, "x", 0, 0.2, 10, W1())


def profile_by_hand(window, pct=None, skip=0):
    """Level by level: the volume between each price and the one below it."""
    prices = sorted({p for bar in window for p in bar[:4] if p > 0})
    prices = [p for p in prices if p <= prices[len(prices) // 2] * 100]
    close = window[-1][3]
    if not prices:
        return None
    if pct is not None and not 0 < pct < 100:
        return prices[0] if pct <= 0 else prices[-1]
    if pct is None and not prices[0] < close < prices[-1]:
        return 0.0 if close <= prices[0] else 100.0
    at = [0.0] * len(prices)
    for o, h, lo, c, v in window[: len(window) - skip]:
        bottom, top = sorted((o or c, c))
        lo, h = lo or bottom, h or top
        levels = [k for k, p in enumerate(prices) if p >= lo]
        for k in levels:
            if k > 0 and prices[k - 1] >= h:
                break
            if k == levels[0]:
                at[k] += 0.0 if prices[k] < h else 1.0
            else:
                at[k] += (prices[k] - prices[k - 1]) * (2 if bottom < prices[k] <= top else 1) * (v or 1) / (h - lo + top - bottom)
    if pct is None:
        return sum(x for x, p in zip(at, prices, strict=True) if p <= close) * 100 / sum(at) if sum(at) else None
    below, target = 0.0, sum(at) * pct / 100
    for k, x in enumerate(at):
        if below + x >= target:
            return prices[k] if k == 0 or below + x <= target else prices[k - 1] + (prices[k] - prices[k - 1]) * (target - below) / x
        below += x
    return prices[-1]


def test_volume_profile(spark):
    import random

    rng = random.Random(11)
    closes = [round(rng.uniform(5, 20), 2) for _ in range(60)]
    opens, highs, lows, volume = [], [], [], []
    for k, c in enumerate(closes):
        o = 0.0 if k % 13 == 5 else round(rng.uniform(5, 20), 2)
        opens.append(o)
        highs.append(c if k % 7 == 3 else 0.0 if k % 11 == 4 else 1e5 if k == 30 else round(max(o, c) + rng.random(), 2))
        lows.append(c if k % 7 == 3 else 0.0 if k % 17 == 6 else round(min(o or c, c) - rng.random(), 2))
        volume.append(0 if k % 9 == 2 else rng.randrange(1, 1000))
    df = series(spark, closes, open=opens, high=highs, low=lows, volume=volume, adj_close=closes)
    window = [*zip(opens, highs, lows, closes, volume, strict=True)]
    for kw in ({"pct": 50}, {"pct": 5}, {"pct": 97.5}, {"pct": 0}, {"pct": 100}, {}, {"skip": 3}):
        got = [r.x for r in ind.with_volume_profile(df, "x", 10, W1(), **kw).orderBy("ending").collect()]
        want = [profile_by_hand(window[max(0, k - 9 - kw.get("skip", 0)) : k + 1], **kw) for k in range(60)]
        for k, (g, h) in enumerate(zip(got, want, strict=True)):
            assert (g is None and h is None) or g == pytest.approx(h, rel=1e-9), (kw, k)


def test_volume_profile_without_prices(spark):
    df = series(spark, [0.0, 0.0], open=[0.0, 0.0], high=[0.0, 0.0], low=[0.0, 0.0], volume=[1, 1], adj_close=[0.0, 0.0])
    for kw in ({"pct": 50}, {"pct": 0}, {}):
        assert [r.x for r in ind.with_volume_profile(df, "x", 2, W1(), **kw).collect()] == [None, None]


@pytest.mark.parametrize("name", ["ind_popv", "ind_povo"])
def test_volume_profile_of_ticks_at_zero(spark, tmp_path, name):
    """A tick at 0 is a price, and of levels that hold half of the volume the sum from the lowest up decides."""
    import random

    import duckdb

    from tidemark.plans import queries as core

    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    value = lambda k: 0.0 if k % 7 == 0 else round(rng.uniform(0, 100), 2)
    ticks = [(k, start + dt.timedelta(minutes=25 * k), "lone" if k % 40 < 12 else "view", value(k)) for k in range(1200)]
    spark.createDataFrame(ticks, "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {tuple(r[:3]): r[3] for r in c.execute(f"SELECT symbol, market, ending, x FROM ({core.SQL[name]})").fetchall()}
    got = {tuple(r[:3]): r[3] for r in core.QUERIES[name](spark, str(tmp_path)).select("symbol", "market", "ending", "x").collect()}
    assert got.keys() == want.keys() and len(got) > 400
    for k, x in want.items():
        assert (x is None and got[k] is None) or got[k] == pytest.approx(x, abs=1.1e-5), k


def test_obv_uses_adjusted_prices(spark):
    closes = [10.0, 20.0, 11.0]
    df = series(spark, closes, open=closes, high=closes, low=closes, volume=[5, 6, 7], adj_close=[10.0, 10.0, 11.0])
    # adjusted closes are 10, 10, 11: only the last bar counts, 3 * 7 * 2 / (3 * 2)
    assert ind.with_obv(df, "x", 1, W1()).orderBy(F.desc("ending")).first().x == pytest.approx(7.0)


def test_calendar_properties(spark):
    from tidemark.functions import calendar as cal

    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=f * 7, minutes=f),) for f in (0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987)]
    df, t = spark.createDataFrame(rows, "t timestamp"), F.col("t")
    for interval in ("m5", "m30", "m240", "day", "week", "month", "quarter", "year"):
        n = 5
        out = df.select(
            cal.floor(cal.floor(t, interval), interval) == cal.floor(t, interval), cal.ceil(cal.ceil(t, interval), interval) == cal.ceil(t, interval),
            cal.inc(cal.dec(t, interval, 2 * n), interval, n) == cal.dec(t, interval, n), cal.diff(cal.inc(t, interval, n), t, interval) == n,
            cal.diff(t, cal.inc(t, interval, n), interval) == -n, cal.floor(t, interval) <= t,
        )
        assert all(all(r) for r in out.collect()), interval
    s, e = cal.session(t, "17:00:00", "16:00:00")
    r = spark.createDataFrame([(dt.datetime(2024, 3, 8, 16, 30),), (dt.datetime(2024, 3, 6, 15, 0),)], "t timestamp").select(s, e).collect()
    assert tuple(r[0]) == (dt.datetime(2024, 3, 10, 17), dt.datetime(2024, 3, 11, 16)) and tuple(r[1]) == (dt.datetime(2024, 3, 5, 17), dt.datetime(2024, 3, 6, 16))
