"""The block store: commits, streams that come again, overlaps, and reads that reach back no further than they must."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import common as fn
from tidemark.functions import lookback as lb
from tidemark.plans.quote import Quote
from tidemark.sources.files import BAR_SCHEMA
from tidemark.sources.store import BlockStore
from tidemark.streaming import bars as streaming


def T(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def frame(spark, rows):
    """(symbol, ending, close)"""
    return spark.createDataFrame([(s, "M", t, c, c, c, c, 1.0, c) for s, t, c in rows], BAR_SCHEMA)


def held(store):
    return sorted((r.symbol, r.ending, r.close) for r in store.read().collect())


@pytest.fixture
def store(spark, tmp_path):
    return BlockStore(spark, f"file://{tmp_path}/store", "m60")


def test_two_streams_with_the_same_epochs(spark, store):
    store.upsert(frame(spark, [("a", T(0), 1.0)]), "volume", "one", 0)
    store.upsert(frame(spark, [("a", T(1), 2.0), ("b", T(40), 3.0)]), "volume", "two", 0)
    store.upsert(frame(spark, [("a", T(9), 9.0)]), "volume", "two", 0)  # comes again
    assert held(store) == [("a", T(0), 1.0), ("a", T(1), 2.0), ("b", T(40), 3.0)]
    assert store.applied("two", 0) and not store.applied("two", 1) and not store.applied("three", 0)


def test_upsert_of_late_and_changed_bars(spark, store):
    rows = [("a", T(d), float(d)) for d in range(0, 90, 3)]
    store.upsert(frame(spark, rows), "volume")
    late = frame(spark, [("a", T(1), 100.0), ("a", T(3), 33.0)]).withColumn("volume", F.lit(2.0))
    store.upsert(late, "volume")
    store.upsert(frame(spark, [("a", T(3), 44.0)]), "volume")  # an older version
    want = {t: c for _, t, c in rows} | {T(1): 100.0, T(3): 33.0}
    assert held(store) == sorted(("a", t, c) for t, c in want.items())
    assert store.vacuum() > 0
    assert held(store) == sorted(("a", t, c) for t, c in want.items())


def test_a_broken_commit_leaves_nothing(spark, store, monkeypatch):
    store.upsert(frame(spark, [("a", T(0), 1.0)]), "volume", "s", 0)
    with monkeypatch.context() as m:
        m.setattr(store, "_swap", lambda *_: (_ for _ in ()).throw(OSError("broken off")))
        with pytest.raises(OSError, match="broken off"):
            store.upsert(frame(spark, [("a", T(0), 5.0), ("a", T(1), 6.0)]).withColumn("volume", F.lit(9.0)), "volume", "s", 1)
    assert held(store) == [("a", T(0), 1.0)] and not store.applied("s", 1)
    store.upsert(frame(spark, [("a", T(0), 5.0), ("a", T(1), 6.0)]).withColumn("volume", F.lit(9.0)), "volume", "s", 1)
    assert held(store) == [("a", T(0), 5.0), ("a", T(1), 6.0)]
    assert store.vacuum() >= 1
    assert held(store) == [("a", T(0), 5.0), ("a", T(1), 6.0)]


def test_of_two_commits_at_once_one_fails(spark, store):
    store.upsert(frame(spark, [("a", T(0), 1.0)]), "volume")
    number = store._number()
    store.upsert(frame(spark, [("a", T(1), 2.0)]), "volume")
    with pytest.raises(RuntimeError, match="another commit"):
        store._commit(number, frame(spark, [("a", T(2), 3.0)]), lambda b: b.where("false"), None, None)
    assert held(store) == [("a", T(0), 1.0), ("a", T(1), 2.0)]


def test_append_checks_the_overlap(spark, store):
    first = [(s, T(d), float(d)) for s in ("a", "b", "c") for d in range(28, 34)]
    assert {r.kind for r in store.append(frame(spark, first)).collect()} == {"new"}
    source = {"a": 1.0, "b": 0.5, "c": 0.25, "d": 1.0}  # b and c were split since

    def bars(keys, since):
        return frame(spark, [(s, T(d), d * source[s]) for s in keys for d in range(since, 36)])

    more = bars("ad", 32).unionByName(bars("bc", 32))
    got = store.append(more, reload=lambda series: bars([r.symbol for r in series.collect() if r.symbol == "b"], 28).unionByName(bars("c", 28)))
    assert {r.symbol: r.kind for r in got.collect()} == {"a": "extended", "b": "replaced", "c": "replaced", "d": "new"}
    want = [(s, T(d), d * k) for s, k in source.items() for d in range(32 if s == "d" else 28, 36)]
    assert held(store) == sorted(want)


def test_append_without_the_overlap_changes_nothing(spark, store):
    store.append(frame(spark, [("a", T(d), float(d)) for d in range(5)] + [("one", T(0), 1.0)]))
    got = store.append(frame(spark, [("a", T(4), 4.0), ("a", T(5), 5.0), ("one", T(0), 1.0), ("one", T(1), 2.0)]))
    assert {r.symbol: r.kind for r in got.collect()} == {"a": "incompatible", "one": "incompatible"}
    assert len(held(store)) == 6
    got = store.append(frame(spark, [("a", T(3), 3.0), ("a", T(4), 4.5), ("a", T(5), 5.0)]), stream="s", epoch=3)
    assert [r.kind for r in got.collect()] == ["extended"]
    assert [c for s, _, c in held(store) if s == "a"] == [0.0, 1.0, 2.0, 3.0, 4.5, 5.0]
    assert store.append(frame(spark, [("a", T(4), 4.5), ("a", T(5), 6.0)]), stream="s", epoch=3).count() == 0


def test_streams_into_one_table_with_checkpoints_of_their_own(spark, tmp_path):
    """A second stream begins at epoch 0 again; its batches are its own."""
    target = f"file://{tmp_path}/table"
    each = streaming.upsert(spark, target, ["k"], "v", F.lit("p"))
    for n, rows in enumerate(([("a", 1)], [("a", 2), ("b", 2)])):
        spark.createDataFrame(rows, "k string, v int").write.parquet(f"{tmp_path}/in{n}")
        streaming.run_to_end(spark.readStream.schema("k string, v int").parquet(f"{tmp_path}/in{n}"), f"file://{tmp_path}/cp{n}", each)
    assert sorted((r.k, r.v) for r in spark.read.parquet(target).collect()) == [("a", 2), ("b", 2)]


QUOTE = dict(
    variables={"was": lambda w: lb.offset(1, F.col("close"), w), "mean": lambda w: lb.sma(4, F.col("was"), w)},
    columns={"close": lambda _: F.col("close"), "top": lambda w: lb.highest(3, F.col("mean"), w)},
    criteria=[lambda w: fn.greater_than(F.col("close"), F.col("was"))],
)


def test_expressions_say_how_far_they_look_back(spark):
    assert Quote(**QUOTE).looks_back() == 1 + 3 + 2
    assert Quote(columns={"x": lambda w: lb.macd(3, 5, F.col("close"), w)}).looks_back() == 49
    assert Quote(columns={"x": lambda w: lb.rsi(14, F.col("close"), w) + lb.offset(300, F.col("close"), w)}).looks_back() == 300
    assert Quote(columns={"x": lambda w: F.sum("close").over(w)}).looks_back() is None
    assert Quote(columns={"x": lambda w: lb.sma(3, F.col("close"), w) + F.sum("close").over(w)}).looks_back() is None
    assert Quote(variables={"t": lambda w: F.sum("close").over(w)}, columns={"x": lambda w: lb.sma(3, F.col("t"), w)}).looks_back() is None
    assert Quote(columns={"x": lambda w: lb.sma(3, F.col("close"), lb.same_time_of_day(["symbol"], F.col("ending"), "ending"))}).looks_back() is None
    assert Quote(columns={"x": lambda _: F.col("close") * 2}).looks_back() == 0


def test_quote_reads_the_blocks_that_it_looks_back_to(spark, store):
    rows = [("a", T(d, h), float(d * 24 + h)) for d in range(120) for h in (9, 12)] + [("thin", T(d), float(d)) for d in range(0, 120, 20)]
    bars = frame(spark, rows)
    store.upsert(bars, "volume")
    one = {"where": F.col("symbol") == "a"}
    spec = dict(QUOTE, begin="2024-04-02", end="2024-04-10", pad_begin=2)
    whole = Quote(**spec)(bars).orderBy("symbol", "ending").collect()
    assert Quote(**spec)(store).orderBy("symbol", "ending").collect() == whole and len(whole) > 10
    # series "a" has 8 bars in March; "thin" needs them back to January
    assert {r.m for r in store.read("2024-04-02", "2024-04-10", 8, **one).select(F.date_format("ending", "MM").alias("m")).distinct().collect()} == {"03", "04"}
    assert store.reach("2024-04-02", 6) == "b2024-01"
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = store.read("2024-04-02", "2024-04-10", 8, **one)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "(block#" in filters and ">= b2024-03" in filters and "commit#" in filters
