"""Periods of sessions against a list of all boundaries, and the consistency of steps and distances."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.calendar import MINUTES, MONTHS, Sessions

MARKETS = {"stocks": ("09:30:00", "16:00:00"), "long": ("04:00:00", "20:00:00"), "fx": ("17:00:00", "17:00:00"), "futures": ("17:00:00", "16:00:00"), "mercantile": ("18:00:00", "17:00:00")}
INTERVALS = ["m5", "m30", "m60", "m240", "day", "week", "month", "quarter", "year"]


def clock(s):
    h, m, x = map(int, s.split(":"))
    return dt.timedelta(hours=h, minutes=m, seconds=x)


def periods(opens, closes, interval, first, last):
    """(start, end) of all periods, session by session."""
    o, c = clock(opens), clock(closes)
    night = dt.timedelta(days=int(c <= o))
    sessions = []
    d = first
    while d <= last:
        if d.weekday() < 5:
            sessions.append((d, d - night + o, d + c))
        d += dt.timedelta(days=1)
    if interval == "day":
        return [s[1:] for s in sessions]
    if interval in ("week", *MONTHS):
        group = {"week": lambda d: d.isocalendar()[:2], "month": lambda d: (d.year, d.month), "quarter": lambda d: (d.year, (d.month - 1) // 3), "year": lambda d: d.year}[interval]
        found = {}
        for d, a, b in sessions:
            found.setdefault(group(d), []).append((a, b))
        return [(x[0][0], x[-1][1]) for x in found.values()]
    step = dt.timedelta(minutes=MINUTES[interval])
    if -(-(night + c - o) // step) * step >= dt.timedelta(days=1):
        weeks = {}
        for d, a, b in sessions:
            weeks.setdefault(d.isocalendar()[:2], []).append((a, b))
        sessions = [(None, x[0][0], x[-1][1]) for x in weeks.values()]
    out = []
    for _, a, b in sessions:
        at = a
        while at < b:
            midnight = at.replace(hour=0, minute=0, second=0, microsecond=0)
            end = min(b, midnight + ((at - midnight) // step + 1) * step)
            out.append((at, end))
            at = end
    return out


@pytest.mark.parametrize("market", sorted(MARKETS))
def test_periods_of_a_market(spark, market):
    rng = random.Random(market)
    opens, closes = MARKETS[market]
    s = Sessions(opens, closes)
    base = dt.datetime(2023, 6, 1)
    moments = [base + dt.timedelta(seconds=rng.randrange(40 * 86400)) for _ in range(60)]
    for d in range(0, 14):
        moments += [base + dt.timedelta(days=d) + clock(x) + dt.timedelta(seconds=k) for x in (opens, closes, "00:00:00", "12:00:00") for k in (-1, 0, 1)]
    df = spark.createDataFrame([(t, moments[(7 * i) % len(moments)]) for i, t in enumerate(moments)], "t timestamp, u timestamp")
    for k in INTERVALS:
        made = [s.floor(F.col("t"), k).alias(f"{k}f"), s.ceil(F.col("t"), k).alias(f"{k}c"), s.inc(F.col("t"), k, 3).alias(f"{k}i"), s.dec(F.col("t"), k, 2).alias(f"{k}d"), s.diff(F.col("t"), F.col("u"), k).alias(f"{k}n"), s.dec(s.inc(F.col("t"), k, 4), k, 2).alias(f"{k}b"), s.inc(F.col("t"), k, 2).alias(f"{k}2"), s.inc(F.col("t"), k, 0).alias(f"{k}0")]
        rows = df.select("t", "u", *made).collect()
        wide = (dt.datetime(2019, 1, 1), dt.datetime(2028, 12, 31)) if k in MONTHS else (dt.datetime(2023, 4, 3), dt.datetime(2023, 9, 1))
        every = periods(opens, closes, k, *wide)
        starts, ends = [a for a, _ in every], [b for _, b in every]
        for r in rows:
            f = lambda t: bisect.bisect_right(ends, t)  # noqa: B023, E731
            e = lambda t: bisect.bisect_left(starts, t) - 1  # noqa: B023, E731
            assert r[f"{k}f"] == starts[f(r.t)], (k, r.t)
            assert r[f"{k}c"] == ends[e(r.t)], (k, r.t)
            assert r[f"{k}i"] == ends[f(r.t) + 2], (k, r.t)
            assert r[f"{k}d"] == ends[e(r.t) - 2], (k, r.t)
            want = max(0, e(max(r.t, r.u)) - f(min(r.t, r.u)) + 1)
            assert r[f"{k}n"] == (0 if r.t == r.u else want if r.t > r.u else -want), (k, r.t, r.u)
            assert r[f"{k}b"] == r[f"{k}2"]
            assert r[f"{k}0"] == min(r.t, ends[e(r.t)])


def test_the_exchange_has_a_clock_of_its_own(spark):
    s = Sessions("09:30:00", "16:00:00", "America/New_York")
    df = spark.createDataFrame([(dt.datetime(2014, 3, 7, 15, 0),), (dt.datetime(2014, 3, 10, 14, 0),)], "t timestamp")  # summer time begins between
    got = [tuple(r) for r in df.select(s.floor(F.col("t"), "day"), s.ceil(F.col("t"), "m30")).collect()]
    assert got == [(dt.datetime(2014, 3, 7, 14, 30), dt.datetime(2014, 3, 7, 15, 0)), (dt.datetime(2014, 3, 10, 13, 30), dt.datetime(2014, 3, 10, 14, 0))]
