"""Operators on small frames, streams against batches, and the queries against SQL."""

import datetime as dt
import os
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions.rolling import Retained
from tidemark.operators import asof, bars, collect, corporate, models, orders, search
from tidemark.plans import queries as core
from tidemark.plans.quote import Quote
from tidemark.plans.tables import event_bars
from tidemark.sources import catalog, files
from tidemark.streaming import bars as streaming

SF = "/root/testdata/sf0.001"
T = lambda d, h=0: dt.datetime(2024, 1, d, h)


def bar(spark, rows):
    return files.inline(spark, [(s, "M", t, c, c + 1, c - 1, c, 10.0, a) for s, t, c, a in rows])


def test_adjusted_roll_up(spark):
    b = bar(spark, [("a", T(2), 10.0, 5.0), ("a", T(3), 6.0, 6.0)])
    r = bars.roll_up(b, "month", adjust=True).first()
    assert (r.open, r.high, r.low, r.close, r.volume, r.adj_close) == (5.0, 7.0, 4.5, 6.0, 20.0, 6.0)


def test_last_weekday_and_incomplete(spark):
    f = spark.createDataFrame([(dt.datetime(2024, 3, 5, 16, 30),)], "t timestamp").select(bars.last_weekday(F.col("t"), "month").alias("m"), bars.last_weekday(F.col("t"), "week").alias("w")).first()
    assert f.m == dt.datetime(2024, 3, 29, 16, 30) and f.w == dt.datetime(2024, 3, 8, 16, 30)
    m = bars.marked_incomplete(bar(spark, [("a", T(2), 1.0, 1.0), ("a", T(5), 1.0, 1.0)]), F.lit(T(3)).cast("timestamp")).orderBy("ending").collect()
    assert [r["asof"] for r in m] == [None, T(3)]


def test_asof_join_directions_and_ties(spark):
    left = spark.createDataFrame([("a", i) for i in (1, 3, 5)], "k string, t int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 4, "y"), ("b", 1, "z")], "k string, t int, v string")
    get = lambda **o: [r.m and r.m.v for r in asof.asof_join(left, right, ["k"], "t", "m", **o).orderBy("t").collect()]
    assert get() == [None, "x", "y"] and get(strict=True) == [None, None, "y"]
    assert get(forward=True) == ["x", "x", None] and get(forward=True, strict=True) == ["x", "y", None]


def test_split_ratio_and_factors(spark):
    r = spark.createDataFrame([("2:1",), ("1/2",), ("1/0",), (None,), ("7",)], "s string").select(corporate.split_ratio(F.col("s"))).collect()
    assert [x[0] for x in r] == [2.0, 2.0, 1.0, 1.0, 1.0]
    a = spark.createDataFrame([("a", "M", dt.date(2024, 1, 10), 1.0, 1.0, 50.0), ("a", "M", dt.date(2024, 2, 10), 0.0, 2.0, 60.0)], "symbol string, market string, exdate date, dividend double, split double, cum_close double")
    f = {r.exdate.month: r for r in corporate.adjustment_factors(a).collect()}
    assert f[2].adj == 0.5 and f[1].cum_close == 100.0 and f[1].adj == pytest.approx(0.5 * 0.99)


def test_fold_and_segments(spark):
    rows = [(f"s{i % 2}", T(1 + i), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "index string, temporal timestamp, x double")

    def step(state, row):
        if row.x % 5 == 0:
            return None
        state["n"] = state.get("n", 0.0) + row.x
        return {"n": state["n"]}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = {r.x: r.n for r in collect.fold(df, ["index"], ["temporal"], dict, step, "n double").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, sums = {}, {}
    for k, _, x in rows:
        if x % 5:
            sums[k] = sums.get(k, 0.0) + x
            want[x] = sums[k]
    assert got == want
    s = collect.segments(df, "2024-01-01", "2024-01-21", "P7D").groupBy("segment").count().orderBy("segment").collect()
    assert [(r.segment, r["count"]) for r in s] == [(1, 7), (2, 7), (3, 6)]
    back = collect.segments(df, "2024-01-01", "2024-01-21", "-P7D").groupBy("segment").count().orderBy("segment").collect()
    assert [r["count"] for r in back] == [6, 7, 7]


def test_orders(spark):
    b = bar(spark, [("a", T(2), 10.0, 10.0), ("a", T(3), 20.0, 20.0)])  # highs and lows are one off
    rows = [
        (1, "BUY", "LMT", 19.5, None, "GTC"), (2, "SELL", "LMT", 30.0, None, "DAY"), (3, "BUY", "STP", None, 20.5, "GTC"), (4, "SELL", "LMT", 30.0, None, "GTC"), (5, "BUY", "MOC", None, None, "IOC"), (6, "BUY", "LOO", 5.0, None, "IOC"),
        (7, "BUY", "LMT", 10.5, None, "IOC"), (8, "BUY", "LMT", 10.5, None, "DAY"), (9, "SELL", "LOC", 15.0, None, "GTC"), (10, "SELL", "LOO", 25.0, None, "GTC"), (11, "SELL", "MKT", None, None, "DAY"), (12, "BUY", "MIT", None, 15.0, "DAY"),
    ]
    o = spark.createDataFrame([(r, T(1), a, 1.0, k, li, st, tif, "a", "M") for r, a, k, li, st, tif in rows] + [(20, T(5), "BUY", 1.0, "LOC", 1.0, None, "DAY", "a", "M")], "order_ref int, posted_at timestamp, action string, quant double, order_type string, limit double, stop double, tif string, symbol string, market string")
    f = {r.order_ref: (r.status, r.traded_price) for r in orders.fills(o, b, ["symbol", "market"]).collect()}
    assert f == {1: ("filled", 19.5), 2: ("cancelled", None), 3: ("filled", 20.5), 4: ("working", None), 5: ("filled", 10.0), 6: ("cancelled", None), 7: ("cancelled", None), 8: ("filled", 10.5), 9: ("filled", 20.0), 10: ("cancelled", None), 11: ("filled", 10.0), 12: ("cancelled", None), 20: ("working", None)}
    # a limit far below the open fills at the limit, once a bar holds it, and a price that is jumped over waits on
    jumps = bar(spark, [("a", T(2), 10.0, 10.0), *[("a", T(3, h), 30.0 if h % 2 else 10.0, 1.0) for h in range(10)], ("a", T(4), 20.0, 20.0)])
    o = spark.createDataFrame([(1, T(1), "BUY", 1.0, "LMT", 20.0, None, "GTC", "a", "M")], o.schema)
    assert [(r.traded_at, r.traded_price) for r in orders.fills(o, jumps, ["symbol", "market"]).collect()] == [(T(4), 20.0)]
    o = spark.createDataFrame([(r, T(1), a, 1.0, k, li, st, tif, "a", "M") for r, a, k, li, st, tif in (*rows[:6], rows[10])], o.schema)
    legs = orders.fills(o, b, ["symbol", "market"]).withColumn("combo_ref", F.when(F.col("order_ref").isin(5, 11), 1).otherwise(2))
    assert {r.order_ref: r.status for r in orders.combo_fills(legs).collect()} == {5: "filled", 11: "filled", 1: "working", 2: "working", 3: "working", 4: "working", 6: "working"}
    c = spark.createDataFrame([("x", "BUY", 4.0, 2.0), ("x", "SELL", 6.0, 1.0)], "order_ref string, action string, quant double, limit double")
    r = orders.combined_legs(c).first()
    assert r.quant == 2 and r.limit == pytest.approx(2 * 2.0 - 3 * 1.0)


def test_positions(spark):
    """A short position turned long, a dividend, a minimum fee, and a trade within one bar; amounts of an order of two at 161 by hand."""
    b = bar(spark, [("a", T(d), c, c) for d, c in ((2, 161.0), (3, 160.0), (4, 162.0), (5, 162.0), (6, 162.0), (7, 163.0))]).withColumn("dividend", F.when(F.dayofmonth("ending") == 3, 0.5).otherwise(0.0))
    t = spark.createDataFrame([("a", "M", T(2), -5.0, 161.0), ("a", "M", T(4), 10.0, 161.5), ("a", "M", T(5), -5.0, 162.0), ("a", "M", T(6), 2.0, 161.0), ("a", "M", T(6), -2.0, 163.0)], "symbol string, market string, ending timestamp, quant double, price double")
    r = orders.positions(t, b, ["symbol", "market"], 0.01, 1.0, 1.0).orderBy("ending").collect()
    assert [x.action for x in r] == ["STO", "SHORT", "BOT", "STC", "DAY", ""]
    assert [x.position for x in r] == [-5, -5, 5, 0, 0, 0] and [x.commission for x in r] == [1, 0, 1, 1, 2, 0]
    assert [round(x.mtm, 6) for x in r] == [-1.0, 5 - 2.5, (5 * 162 + 5 * 160) - 10 * 161.5 - 1, -1.0, 4 - 2, 0.0]


def test_order_of_texts_and_lookup_and_deviation(spark):
    df = spark.createDataFrame([("x", T(1), 1, "b", 1e9), ("y", T(1), 2, None, 1e9 + 1), ("x", T(2), 1, "10", 1e9), ("y", T(2), 2, "9", None), ("z", T(2), 3, "a", 1e9 + 1)], "index string, temporal timestamp, seq int, name string, v double")
    assert [r.name for r in collect.ordered(df, [("name", False)]).collect()] == [None, "9", "10", "a", "b"]
    assert [r.name for r in collect.ordered(df, [("name", True)], head=2).collect()] == ["b", "a"]
    r = Retained(df)
    found = {(x["index"], x.temporal): x.f for x in r.lookup("f", "v", F.col("index") == "x").collect()}
    assert found["x", T(1)] == 1e9 and found["z", T(2)] == 1e9 and found["y", T(1)] == 1e9
    own = {x.seq: x.f for x in r.lookup("f", "name", F.col("name") == "a").where(F.col("temporal") == T(2)).collect()}
    assert own == {1: None, 2: None, 3: "a"}  # the row itself counts
    d = {(x["index"], x.temporal): x.d for x in r.stdev_total("d", F.col("v")).collect()}
    assert d["x", T(1)] == 1.0 and d["y", T(1)] == pytest.approx(0.5) and d["z", T(2)] == pytest.approx(0.5) and d["x", T(2)] == pytest.approx((2 / 9) ** 0.5)


def test_search(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    peak = lambda c: F.sum(F.lit(0.0)) - (c["a"] - 37) ** 2 - (c["b"] - 12) ** 2
    values = {"a": [float(i) for i in range(60)], "b": [float(i) for i in range(60)]}
    (score, found), *_ = search.optimize(df, values, peak, exhaustive=10_000)
    assert score == 0 and found == {"a": 37.0, "b": 12.0}
    (score, found), *_ = search.optimize(df, values, peak, exhaustive=10, generations=25)
    assert score > -40
    top, strategy = search.strategize(df, {"big": F.col("x") > 4, "even": F.col("x") % 2 == 0, "no": F.lit(False)}, lambda s: F.sum(F.when(s, 1.0).otherwise(0.0)), disjunction_cost=0.5)
    assert strategy == (("big",), ("even",)) and top == 7.5


def test_sources(spark, tmp_path):
    b = event_bars(spark, SF)
    path = f"file://{tmp_path}/blocks"
    files.write_blocks(b, path, "m60")
    one = files.read_blocks(spark, path, "m60", "click", "2024-01-05", "2024-01-08")
    want = b.where("symbol = 'click' and ending between '2024-01-05' and '2024-01-08'")
    assert one.count() == want.count() > 0
    files.write_delimited(b.limit(5), f"file://{tmp_path}/csv", "\t", gzip=True)
    assert files.read_delimited(spark, f"file://{tmp_path}/csv", files.BAR_SCHEMA, "\t").count() == 5
    c = catalog.Catalog().add("day", lambda: bars.roll_up(b, "day"))
    assert c.fetch("week", "click").count() == bars.roll_up(bars.roll_up(b.where("symbol = 'click'"), "day"), "week").count()
    with pytest.raises(ValueError):
        c.fetch("day", begin="2024-02-01", end="2024-01-01")
    names = spark.createDataFrame([("AB", "X", None, "usd"), ("ABC", "X", "Abc", None)], "symbol string, market string, name string, currency string")
    more = spark.createDataFrame([("AB", "X", "Ab inc", "eur")], "symbol string, market string, name string, currency string")
    assert [(r.symbol, r.name, r.currency) for r in catalog.lookup([names, more], "ab").collect()] == [("AB", "Ab inc", "usd"), ("ABC", "Abc", None)]
    o = catalog.option_symbol(spark.createDataFrame([("SPX   141122P00019500",), ("SPX",)], "symbol string")).collect()
    assert (o[0].root, o[0].right, o[0].strike, o[0].expiry) == ("SPX", "P", 19.5, dt.date(2014, 11, 22)) and o[1].root is None
    d = spark.createDataFrame([("a", "M", dt.date(2024, 1, 1), 1.0)], "symbol string, market string, exdate date, dividend double")
    assert [r.exdate for r in catalog.expected_dividends(d, 2).collect()] == [dt.date(2024, 4, 1), dt.date(2024, 7, 1)]
    t = files.transposed(spark.createDataFrame([("x", 1, 2), ("y", 3, 4)], "k string, a int, b int"), "k").orderBy("column").collect()
    assert [tuple(r) for r in t] == [("a", "1", "3"), ("b", "2", "4")]


def test_quote_masks_and_ranges(spark):
    b = event_bars(spark, SF)
    with pytest.raises(ValueError):
        Quote({}, variables={"close": lambda w: F.col("close")})(b)
    q = Quote({"n": lambda w: F.count("close").over(w)}, begin="2024-01-10", end="2024-01-12")(b).toPandas()
    assert q.n.min() > 1 and str(q.ending.max()) <= "2024-01-12 00:00:00"


def test_stream_is_the_batch(spark, tmp_path):
    ticks = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):
        ticks.where(F.col("event_id") % 3 == i).coalesce(1).write.parquet(f"file://{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    made = streaming.tumbling(stream, "1 hour", "60 days", F.col("event_type"), F.col("value"))
    store = f"file://{tmp_path}/out"
    streaming.run_to_end(made, f"file://{tmp_path}/cp", streaming.upsert(spark, store, ["symbol", "ending"], "volume", F.date_format("ending", "yyyy-MM-dd")))
    got = spark.read.parquet(store).select("symbol", "ending", "close", "volume").toPandas().sort_values(["symbol", "ending"]).reset_index(drop=True)
    want = event_bars(spark, SF).select("symbol", "ending", "close", "volume").toPandas().sort_values(["symbol", "ending"]).reset_index(drop=True)
    assert got.equals(want)


def test_models(spark):
    b = bar(spark, [("a", T(1), 10.0, 10.0), ("a", T(3), 30.0, 30.0)])
    c = bar(spark, [("b", T(2), 5.0, 5.0)])
    j = asof.align({"a": b, "b": c}, ["market"], ["open", "high", "low", "close", "adj_close"])
    r = models.ratio(j, "a", "b", "R", "M").orderBy("ending").collect()
    assert [(x.ending, x.close) for x in r] == [(T(2), 2.0), (T(3), 6.0)]


def equal(a, b):
    return bool(pd.isna(a) and pd.isna(b)) or not (pd.isna(a) or pd.isna(b)) and a == b


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want, got = c.sql(core.SQL[name]).df(), core.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want) > 0
    for x, y in zip(want[cols].sort_values(cols).itertuples(index=False), got[cols].sort_values(cols).itertuples(index=False), strict=True):
        assert all(equal(p, q) for p, q in zip(x, y, strict=True)), (name, x, y)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_works_without_the_text_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    os.mkdir(tmp_path / "tidemark")
    for p in os.listdir(f"{root}/tidemark"):
        if p not in ("llm", "__pycache__"):
            os.symlink(f"{root}/tidemark/{p}", tmp_path / "tidemark" / p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op1') or k == 'pipeline' for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
