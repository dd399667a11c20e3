"""Queries over many securities on one time line: what each has by itself, what it has by those before it, and which rows are shown."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import Retained
from ..operators import collect
from .quote import Expression, Quote

Rolling = Callable[[Retained, str], DataFrame]


@dataclass
class Collect:
    """portfolio: a frame of bars of many securities, or a dict of name -> such a frame or a query of this kind, whose rows then stand for
    bars. columns, variables and parameters are those of each security's own quote. Rows of a time are ranked by precedence (columns;
    ties by index); criteria say which are retained by themselves, feedback which are by what those retained before them came to (and adds
    columns that depend on them). rolling: name -> function of the retained rows and the name that adds that column,
    in order, so that one may go over another. filter leaves rows out of the result only; order sorts it (column, descending), head and
    tail take its first and last rows. pad_leading weekdays before begin are gone through and not shown. With reset_every (an ISO
    duration, from begin, or if negative back from end) each span is a collection of its own, with what leads up to it, its order, its
    head and its tail, and the results follow each other.

    A nested query that ends before begin, or begins after end, is not run; a column that only it has is null. Others are run within
    begin and end. The result has index, temporal, seq and the columns."""

    portfolio: DataFrame | dict[str, DataFrame | Collect]
    begin: str
    end: str
    columns: dict[str, Expression] = field(default_factory=dict)
    variables: dict[str, Expression] = field(default_factory=dict)
    parameters: dict[str, object] = field(default_factory=dict)
    precedence: list[Column] = field(default_factory=list)
    criteria: list[Column] = field(default_factory=list)
    feedback: list[collect.Feedback] = field(default_factory=list)
    rolling: dict[str, Rolling] = field(default_factory=dict)
    filter: list[Column] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    head: int | None = None
    tail: int | None = None
    pad_leading: int = 0
    reset_every: str | None = None
    warm_up: str | None = None

    def names(self) -> set[str]:
        return {*self.columns, *self.rolling}

    def since(self) -> str:
        """Begin, less the weekdays gone through before it."""
        at = pd.Timestamp(self.begin)
        weekday = min(at.weekday(), 4) - self.pad_leading  # a day of the weekend counts as its Friday
        return str(at + pd.Timedelta(days=weekday // 5 * 7 + weekday % 5 - at.weekday()) if self.pad_leading else at)

    def spans(self) -> list[tuple[str, str, str]]:
        """(what leads up to it, begin, end) of each span between resets; none without resets."""
        if self.reset_every is None:
            return []
        starts = collect.bounds(self.begin, self.end, self.reset_every)
        ends = [*(b - pd.Timedelta(microseconds=1) for b in starts[1:]), pd.Timestamp(self.end)]  # a span's first moment isn't the last of the one before
        return [(replace(self, begin=str(a)).since(), str(a), str(b)) for a, b in zip(starts, ends, strict=True)]

    def _rows(self) -> DataFrame:
        """What the securities have by themselves."""
        own = lambda bars, keys: Quote(self.columns, self.variables, begin=self.since(), end=self.end, keys=keys, warm_up=self.warm_up, parameters=self.parameters)(bars)
        if isinstance(self.portfolio, DataFrame):
            return own(self.portfolio, ["symbol", "market"]).withColumn("index", F.concat_ws(".", "symbol", "market")).withColumn("temporal", F.col("ending")).drop("symbol", "market", "ending")
        out: DataFrame | None = None
        lost: set[str] = set()
        first, last = pd.Timestamp(self.since()), pd.Timestamp(self.end)
        for name, member in self.portfolio.items():
            if isinstance(member, Collect):
                if pd.Timestamp(member.end) <= first or pd.Timestamp(member.begin) >= last:
                    lost |= member.names()
                    continue
                inner = replace(member, begin=str(max(first, pd.Timestamp(member.begin))), end=str(min(last, pd.Timestamp(member.end))))
                rows = inner().withColumn("symbol", F.concat(F.lit(f"{name}."), "index")).withColumn("ending", F.col("temporal")).drop("index", "temporal", "seq")
                rows = own(rows, ["symbol"]) if self.columns or self.variables else rows
                rows = rows.withColumn("index", F.col("symbol")).withColumn("temporal", F.col("ending")).drop("symbol", "ending")
            else:
                rows = own(member, ["symbol", "market"]).withColumn("index", F.lit(name)).withColumn("temporal", F.col("ending")).drop("symbol", "market", "ending")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            raise ValueError("no member of the portfolio lies within begin and end")
        return out.withColumns({c: F.lit(None).cast("double") for c in sorted(lost - set(out.columns))})

    def __call__(self) -> DataFrame:
        spans = self.spans()
        if spans and not isinstance(self.portfolio, DataFrame):  # members reset with it, each in each span
            parts = [replace(self, begin=str(a), end=str(b), reset_every=None)() for _, a, b in spans]
            return reduce(lambda out, part: out.unionByName(part, allowMissingColumns=True), parts)
        segment = ["segment"] if spans else []
        df = self._rows()
        clash = {c.lower() for c in df.columns} & {"segment", "_begin"}
        if spans and clash:
            raise ValueError(f"columns are named like those of spans: {sorted(clash)}")
        df = collect.in_spans(df, spans) if spans else df
        df = collect.ranked(collect.retain(df, self.criteria), self.precedence, segment)
        for walk in self.feedback:
            df = collect.walked(df, walk, segment)
        shown = [c for c in df.columns if c not in ("index", "temporal", "seq", "segment", "_begin")]
        shown += [c for c in self.rolling if c not in df.columns]
        if self.rolling:
            held = Retained(df, segment=segment)
            for name, roll in self.rolling.items():
                held = held.replaced(roll(held, name))
            df = held.df
        if self.pad_leading:
            df = df.where(F.col("temporal") >= (F.col("_begin") if spans else F.lit(self.begin).cast("timestamp")))
        df = collect.retain(df, self.filter)
        if self.order or self.head is not None or self.tail is not None:
            df = collect.ordered(df, self.order, self.head, self.tail, segment)
        return df.select("index", "temporal", "seq", *shown)
