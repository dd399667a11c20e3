"""Sources in turn, models by name, sampled starts of searches, and the time of a query."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions import common as fn
from tidemark.operators import models, search
from tidemark.sources.catalog import first_success


def test_first_success(spark, tmp_path):
    some = spark.createDataFrame([("a", 1.0)], "symbol string, close double")
    asked = []

    def source(name, df):
        def read():
            asked.append(name)
            return df() if callable(df) else df

        return read

    missing = source("missing", lambda: spark.read.parquet(f"file://{tmp_path}/nowhere"))
    empty, full, last = source("empty", some.where("false")), source("full", some), source("last", some.withColumn("close", F.lit(2.0)))
    assert [tuple(r) for r in first_success([missing, empty, full, last]).collect()] == [("a", 1.0)]
    assert asked == ["missing", "empty", "full"]
    assert first_success([missing, empty]).count() == 0
    with pytest.raises(AnalysisException):
        first_success([missing, missing])
    with pytest.raises(ZeroDivisionError):  # a fault of the source's code isn't hidden
        first_success([lambda: 1 / 0, full])
    with pytest.raises(KeyError):
        first_success([])


def test_the_model_that_stands_for_a_symbol(spark):
    rows = [
        ("NYSE", "SPY", None, None, "by name"),
        ("NYSE", None, "^X..?$", ["day"], "by pattern"),
        ("NYSE", None, None, None, "any"),
        ("ARCA", "SPY", None, None, "elsewhere"),
        ("NYSE", "", "^XL.*", None, "longer pattern"),
    ]
    assets = spark.createDataFrame(rows, "market string, symbol string, symbol_pattern string, intervals array<string>, model string")
    of = lambda *a: [r.model for r in models.matched(assets, *a).collect()]
    assert of("IBM", "NYSE", "day") == ["any"] and of("IBM", "ARCA", "day") == []
    assert of("SPY", "ARCA", "m5") == ["elsewhere"]
    assert of("SPY", "NYSE", "day") == ["any"]  # the shortest name
    named = assets.where("model <> 'any'")
    assert [r.model for r in models.matched(named, "SPY", "NYSE", "day").collect()] == ["by name"]
    assert [r.model for r in models.matched(named, "XLF", "NYSE", "day").collect()] == ["longer pattern"]
    assert [r.model for r in models.matched(named, "XA", "NYSE", "day").collect()] == ["by pattern"]
    assert models.matched(named, "XA", "NYSE", "m5").count() == 0


def test_evaluated_parameters():
    got = models.evaluated({"b": lambda p: p["a"] + 1, "c": lambda p: p["b"] * 10, "a": lambda p: -p["a"]}, {"a": 2, "z": 0})
    assert got == {"a": -2, "z": 0, "b": 3, "c": 30}


def test_sampled_periods():
    begin, end = dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 1)
    periods = search.sample_periods(begin, end, dt.timedelta(days=10), 40)
    assert periods == search.sample_periods(begin, end, dt.timedelta(days=10), 40) and len(set(periods)) > 5
    assert all(begin <= a and b <= end and b - a == dt.timedelta(days=10) for a, b in periods)
    assert search.sample_periods(begin, end, dt.timedelta(days=90), 2) == [(begin, end)] * 2


def test_search_starts_from_what_does_best_in_samples(spark):
    """The best n is that of each half: 3 in the first, 8 in the second."""
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(days=d), 3.0 if d < 30 else 8.0) for d in range(60)], "at timestamp, goal double")
    halves = [(start, start + dt.timedelta(days=29)), (start + dt.timedelta(days=30), start + dt.timedelta(days=59))]
    found = search.from_samples(df, "at", halves, {"n": [float(k) for k in range(10)]}, lambda c: -F.avg(F.abs(F.col("goal") - c["n"])))
    assert found == [{"n": 3.0}, {"n": 8.0}]


def test_the_time_of_a_query(spark):
    one = spark.range(1)
    at = "2024-03-11 13:30:00"
    got = one.select(fn.now(F.lit(at)), fn.now(F.lit(at), "America/New_York"), fn.begin(F.lit("2024-01-05")), fn.end(F.lit("2024-02-01"), F.lit(at)), fn.end(F.lit("2025-02-01"), F.lit(at)), fn.end(None, F.lit(at))).first()
    assert [str(x) for x in got] == ["2024-03-11 13:30:00", "2024-03-11 09:30:00", "2024-01-05 00:00:00", "2024-02-01 00:00:00", at, at]
    assert abs((one.select(fn.now()).first()[0] - dt.datetime.now(dt.UTC).replace(tzinfo=None)).total_seconds()) < 86_400


def test_cash_settles_later(spark):
    from tidemark.operators import orders

    at = lambda d, h=16: dt.datetime(2024, 1, d, h)
    rows = [
        (at(4), "STK", 8577.0, 1.0, 0.0, -1.0), (at(5), "STK", -500.0, 1.0, 7.0, 20.0), (at(5), "FUT", 9000.0, 2.0, 0.0, 30.0), (at(8), "STK", 0.0, 0.0, 0.0, 5.0),
    ]  # Thursday, Friday, Monday
    p = spark.createDataFrame([(*r, "USD") for r in rows], "ending timestamp, kind string, spent double, commission double, dividend double, mtm double, currency string")
    d = spark.createDataFrame([(at(2), "USD", 10000.0)], "ending timestamp, currency string, amount double")
    got = lambda days: {r.ending.day: (r.net, r.settled, r.accrued) for r in orders.cash(p, d, days, futures=F.col("kind") == "FUT").collect()}
    assert got(0) == {2: (10000, 10000, 0), 4: (9999, 10000 - 8577 - 1, 0), 5: (10049, 1422 + 506 + 30, 0), 8: (10054, 1958, 0)}
    assert got(2) == {2: (10000, 10000, 0), 4: (9999, 10000, -8578), 5: (10049, 10030, -8072), 8: (10054, 1452, 506), 9: (10054, 1958, 0)}
    assert orders.cash(p.limit(0), d.limit(0)).count() == 0


def test_cash_figures(spark):
    from tidemark.operators import orders

    b = spark.createDataFrame([(1, "USD", 1.0, 100.0, 5.0, None), (1, "CAD", 0.8, 50.0, None, None), (2, "USD", 1.0, 100.0, 5.0, None), (2, "CAD", 0.8, 50.0, None, 10.0)], "ending int, currency string, rate double, settled double, accrued double, margin double")
    rows = lambda c: {r.ending: (r.settled_cash, r.accrued_cash, r.total_cash) for r in orders.cash_figures(b, c).collect()}
    assert rows(None) == {1: (100, 5, 105), 2: (100, 5, 145)}
    assert rows("CAD") == {1: (50, 0, 50), 2: (50, 0, pytest.approx(145 / 0.8))}


def test_asof_join_by_spans(spark):
    """The same rows as in one go, over empty spans and equal times, and no key whole in one task."""
    from tidemark.operators import asof

    left = spark.sql("SELECT 'k' AS k, id AS n, timestamp_seconds(1704067200 + id * 613) AS at FROM range(500)")
    right = spark.sql("SELECT 'k' AS k, timestamp_seconds(1704067200 + 6130 + id * 9195) AS at, id AS v FROM range(25)")
    for strict in (False, True):
        whole = {r.n: r.r and r.r.v for r in asof.asof_join(left, right, ["k"], "at", "r", strict=strict).collect()}
        spans = asof.asof_join(left, right, ["k"], "at", "r", strict=strict, span="hour")
        assert {r.n: r.r and r.r.v for r in spans.collect()} == whole and len(set(whole.values())) == 26
    assert "hashpartitioning(k#" in (plan := spans._jdf.queryExecution().executedPlan().toString()) and "_span" in plan
