"""First touch of waiting orders against a walk over the bars, on series with and without gaps."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import orders, touch


def series(rng, n, gaps):
    close = 100 + np.cumsum(rng.normal(0, 1, n)) * (20 if gaps else 1)
    span = np.abs(rng.normal(0, 0.01 if gaps else 1.0, n))
    return [(float(c), float(c + s), float(c - s), float(c + rng.normal(0, 0.3) * s)) for c, s in zip(close, span, strict=True)]


@pytest.mark.parametrize("gaps", [False, True])
def test_first_touch(spark, gaps, monkeypatch):
    monkeypatch.setattr(touch, "CHUNK_BITS", 3)  # many chunks
    rng = np.random.default_rng(4)
    reaches, asked, want = [], [], {}
    for s, n in (("a", 300), ("b", 40), ("c", 1)):
        bars = series(rng, n, gaps)
        reaches += [(s, i, low if i % 11 else None, high if i % 7 else None) for i, (_, high, low, _) in enumerate(bars) if i % 77]
        for k in range(200):
            x = float(rng.choice([b[3] for b in bars])) if k % 3 else float(rng.uniform(min(b[2] for b in bars) - 5, max(b[1] for b in bars) + 5))
            asked.append((f"{s}{k}", s, x, int(rng.integers(-1, n))))
    for ref, s, x, after in asked:
        hit = [i for t, i, lo, hi in reaches if t == s and i > after and (lo is None or lo <= x) and (hi is None or hi >= x)]
        want[ref] = min(hit, default=None)
    found = touch.first_touch(spark.createDataFrame(asked, "ref string, symbol string, x double, _after long"), spark.createDataFrame(reaches, "symbol string, _pos long, lo double, hi double"), ["symbol"], "ref")
    got = {r.ref: r._pos for r in found.collect()}
    assert got == {k: v for k, v in want.items() if v is not None} and len(got) > 200


def test_fills_over_gaps(spark):
    rng = np.random.default_rng(7)
    start = dt.datetime(2024, 1, 1)
    bars = [("s", "M", start + dt.timedelta(hours=7 * i), o, h, lo, c) for i, (o, h, lo, c) in enumerate(series(rng, 250, True))]
    frame = spark.createDataFrame(bars, "symbol string, market string, ending timestamp, open double, high double, low double, close double")
    kinds = ["LMT", "STP", "MIT", "LOO", "LOC", "MKT"]
    posted = []
    for k in range(400):
        at = start + dt.timedelta(hours=float(rng.uniform(-3, 7 * 250)))
        p = float(rng.choice([b[3 + k % 4] for b in bars])) if k % 2 else float(rng.uniform(60, 140))
        posted.append((k, "s", "M", at, "BUY" if rng.random() < 0.5 else "SELL", 1.0, kinds[k % 6], p, p, "GTC"))
    o = spark.createDataFrame(posted, "order_ref long, symbol string, market string, posted_at timestamp, action string, quant double, order_type string, limit double, stop double, tif string")
    got = {r.order_ref: (r.traded_at, r.traded_price) for r in orders.fills(o, frame, ["symbol", "market"]).collect()}

    def trade(kind, buy, p, b):
        _, _, _, op, hi, lo, cl = b
        if kind in ("LOO", "LOC"):
            x = op if kind == "LOO" else cl
            return x if (x <= p if buy else x >= p) else None
        return op if kind == "MKT" else p if lo <= p <= hi else None

    for k, _, _, at, action, _, kind, p, _, _ in posted:
        later = [b for b in bars if b[2] > at]
        hits = [(b[2], trade(kind, action == "BUY", p, b)) for b in (later[:1] if kind == "MKT" else later)]
        assert got[k] == next(((t, x) for t, x in hits if x is not None), (None, None)), k
    assert sum(t is not None for t, _ in got.values()) > 150


def test_rows_go_up_with_the_logarithm(spark):
    """What orders and bars are dealt as stays under the levels of the prices, however the bars jump."""
    rng = np.random.default_rng(1)
    n = 2000
    bars = spark.createDataFrame([("s", i, float(lo), float(lo + 0.001)) for i, lo in enumerate(rng.uniform(0, 100, n))], "symbol string, _pos long, lo double, hi double")
    asked = spark.createDataFrame([(k, "s", float(x), 0) for k, x in enumerate(rng.uniform(0, 100, n))], "ref long, symbol string, x double, _after long")
    numbers, ends = touch._numbers(asked, bars, ["symbol"])
    dealt = ends.select(F.size(touch._nodes(F.col("_a"), F.col("_b"))).alias("n")).agg(F.sum("n")).first()[0]
    assert numbers.count() == n and dealt <= 2 * 12 * n


def test_like_orders_are_asked_for_once_and_no_frame_shrinks(spark):
    """A frame that ends at the last row is summed up anew for each row, so that a chunk takes its rows squared."""
    bars = [("s", i, 10.0 - i % 7, None) for i in range(100)]
    asked = [(k, "s", 5.0 + k % 3, k % 5) for k in range(30_000)]
    found = touch.first_touch(spark.createDataFrame(asked, "ref long, symbol string, x double, _after long"), spark.createDataFrame(bars, "symbol string, _pos long, lo double, hi double"), ["symbol"], "ref")
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan
    got = {r.ref: r._pos for r in found.collect()}
    assert got == {k: next(i for _, i, lo, _ in bars if i > after and lo <= x) for k, _, x, after in asked}
