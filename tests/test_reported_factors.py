"""Adjustment factors of actions as reported: known series, and days with a dividend and a split."""

import datetime as dt
import random

import pytest

from tidemark.operators import corporate

SCHEMA = "symbol string, market string, exdate date, dividend double, split string, cum_close double"


def day(s):
    return dt.date.fromisoformat(s)


def found(spark, rows):
    df = spark.createDataFrame([("s", "m", *r) for r in rows], SCHEMA).repartition(3)
    return sorted(corporate.reported_factors(df).collect(), key=lambda r: r.exdate)


def test_splits_that_are_in_the_dividends(spark):
    rows = [(day("2014-02-06"), 3.05 / 7, None, 512.59 / 7), (day("2014-05-08"), 3.29 / 7, None, 592.33 / 7), (day("2014-06-09"), None, "7:1", 645.57 / 7), (day("2014-08-07"), 0.47, None, 94.96), (day("2014-11-06"), 0.47, None, 108.86)]
    got = found(spark, rows)
    assert [round(r.adj, 4) for r in got] == [0.1399, 0.1408, 0.1415, 0.9908, 0.9957]
    assert [round(r.dividend, 2) for r in got] == [3.05, 3.29, 0, 0.47, 0.47]
    assert [round(r.cum_close, 2) for r in got] == [512.59, 592.33, 645.57, 94.96, 108.86]
    rows = [(day("2016-03-23"), 1.08, None, 39.36), (day("2016-06-21"), 1.08, None, 41.36), (day("2016-09-26"), 1.16, None, 43.32), (day("2016-11-07"), None, "1:4", 41.72), (day("2016-12-21"), 0.85, None, 42.94)]
    got = found(spark, rows)
    assert [r.adj for r in got] == pytest.approx([3.61, 3.71, 3.81, 3.92, 0.98], abs=0.01)  # the inputs are rounded
    assert [round(r.cum_close, 2) for r in got] == [9.84, 10.34, 10.83, 10.43, 42.94]


def test_a_split_that_stands_for_a_dividend(spark):
    rows = [(day("2016-06-01"), 0.1, None, 19.0), (day("2016-09-19"), None, "1231:1000", 19.31), (day("2016-09-19"), 4.44, None, 19.31), (day("2016-12-16"), 0.1, None, 23.0)]
    first, big, last = found(spark, rows)
    assert big.split == 1 and big.dividend == pytest.approx(4.44)
    after = (23 - 0.1) / 23
    close = 19.31 * 1.231
    assert big.adj_split_only == pytest.approx(1 / 1.231) and big.cum_close == pytest.approx(close)
    assert big.adj == big.adj_dividend_only == pytest.approx(after * (close - 4.44) / close)
    assert first.dividend == pytest.approx(0.1 * 1.231)
    assert last.adj == pytest.approx(after)


def walk(rows):
    """rows by (exdate, split rows first); the same rules, one by one from the last."""
    adj = d = s = y = 1.0
    out = []
    for exdate, dividend, split, close in reversed(rows):
        div, ratio = (dividend or 0) * y, 1.0
        if split:
            a, b = map(float, split.split(":"))
            ratio = a / b if a and b else 1.0
        if out and out[-1][0] == exdate:
            last = out.pop()
            div, ratio = div + last[1], ratio * last[2]
            if div and 1 < ratio <= 2:
                adj, d, s = out[-1][4:] if out else (1.0, 1.0, 1.0)
                y, s, ratio = y * ratio, s / ratio, 1.0
        if ratio >= 3 or ratio < 1 / 3:
            y *= ratio
        s, adj = s / ratio, adj / ratio
        shown = close / s
        if div and close:
            d, adj = d * (shown - div) / shown, adj * (shown - div) / shown
        out.append((exdate, div, ratio, shown, adj, d, s))
    return out[::-1]


def test_any_days(spark):
    rng = random.Random(6)
    for _ in range(6):
        rows, at = [], day("2010-01-01")
        for _ in range(rng.randint(0, 14)):
            at += dt.timedelta(days=rng.randint(1, 90))
            close = rng.choice([0.0, 20.0, 55.5])
            if rng.random() < 0.5:
                rows.append((at, None, rng.choice(["2:1", "3:2", "7:1", "1:4", "1:0", "1:2"]), close))
            if rng.random() < 0.7:
                rows.append((at, rng.choice([0.1, 1.5]), None, close))
        got = [tuple(r[c] for c in ("exdate", "dividend", "split", "cum_close", "adj", "adj_dividend_only", "adj_split_only")) for r in found(spark, rows)]
        want = walk(rows)
        assert [g[0] for g in got] == [w[0] for w in want]
        for g, w in zip(got, want, strict=True):
            assert g[1:] == pytest.approx(w[1:])
