"""Collections with feedback and resets: one plan for all spans, and the same rows as a plan a span."""

import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lookback as lb
from tidemark.operators import collect
from tidemark.plans.collect import Collect
from tidemark.plans.tables import event_bars

SF = "/root/testdata/sf0.001"


def by_span(c):
    parts = [replace(c, begin=a, end=b, reset_every=None)() for _, a, b in c.spans()]
    return [tuple(r) for p in parts for r in p.collect()]


@pytest.mark.parametrize("more", [{}, {"order": [("close", True)], "head": 2, "tail": 1}, {"pad_leading": 2, "filter": 15}])
def test_resets_in_one_plan(spark, more):
    if "filter" in more:
        more = more | {"filter": [F.col("close") > more["filter"]]}
    c = Collect(
        event_bars(spark, SF).cache(), "2024-01-02", "2024-01-23", columns={"close": lambda _: F.col("close"), "mean": lambda w: lb.sma(3, F.col("close"), w)}, criteria=[F.col("close") > 10],
        precedence=[F.desc("close")], rolling={"total": lambda r, n: r.sum_total(n, F.col("close")), "was": lambda r, n: r.prev(n, "close", 0.0)}, reset_every="P1W", **more,
    )
    got, want = [tuple(r) for r in c().collect()], by_span(c)
    near = lambda rows: sorted((*r[:3], *[None if x is None else round(x, 6) for x in r[3:]]) for r in rows)
    assert near(got) == near(want) and len(got) >= 9
    if "order" in more:
        assert [r[:3] for r in got] == [r[:3] for r in want]


def test_a_year_of_daily_spans_is_planned_in_seconds(spark):
    b = event_bars(spark, SF)
    c = Collect(b, "2023-06-01", "2024-06-01", columns={"close": lambda _: F.col("close")}, rolling={"total": lambda r, n: r.sum_total(n, F.col("close"))}, reset_every="P1D")
    assert len(c.spans()) == 366
    began = time.time()
    assert c().count() == b.count()
    assert time.time() - began < 40


def test_feedback_keeps_its_state_over_rows_that_go(spark):
    rows = [(s, t, k, float(x)) for k, s in enumerate("abcd") for t, x in enumerate([5, 7, 20, 1] * 40)]
    df = spark.createDataFrame(rows, "index string, temporal int, seq int, x double")
    few = collect.Feedback("security", {"sum": ("double", 0.0), "n": ("int", 0)}, lambda s, r: {"sum": s["sum"] + r["x"], "n": s["n"] + 1}, {"sum": "double"}, lambda s, r: (r["x"] < 20) & (s["n"] < 100))
    want, state = [], {}
    for i, t, k, x in sorted(rows, key=lambda r: (r[0], r[1])):
        total, n = state.get(i, (0.0, 0))
        if x < 20 and n < 100:
            state[i] = (total + x, n + 1)
            want.append((i, t, k, x, total + x))
    assert sorted(tuple(r) for r in collect.walked(df, few).collect()) == sorted(want)
    share = collect.Feedback("time", {"left": ("double", 30.0)}, lambda s, r: {"left": s["left"] - r["x"]}, {"left": "double"}, lambda s, r: r["left"] >= 0)
    got = {(r.temporal % 4, r["index"]): r.left for r in collect.walked(df, share).collect()}
    assert got == {(0, "a"): 25, (0, "b"): 20, (0, "c"): 15, (0, "d"): 10, (1, "a"): 23, (1, "b"): 16, (1, "c"): 9, (1, "d"): 2, (2, "a"): 10, (3, "a"): 29, (3, "b"): 28, (3, "c"): 27, (3, "d"): 26}
    plan = collect.walked(df, few)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
