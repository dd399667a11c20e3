"""Queries of one interval or several: project, filter and window bars, with the range of bars a query needs to read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import reach
from ..functions.common import edate
from ..operators.asof import with_intervals
from ..operators.bars import KEYS, trim
from ..sources.store import BlockStore

Stage = Callable[[DataFrame, WindowSpec], DataFrame]
Expression = Callable[[WindowSpec], Column]


@dataclass
class Quote:
    """columns: name -> expression of the series' window; without any, all fields. variables: named columns that others may use, added in
    order, so that a window function can go over another; parameters: the same of one value each. criteria: conditions on any of them.

    Bars are one frame, or a frame for each interval, the finest first: fields then go by "interval.field", and a row stands for each
    ending of the finest bars, or of another that falls between them. Rows are those from begin to end, pad_begin bars before and pad_end
    bars after, of which the criteria leave some. Windows see the bars before: all of them, or those of the warm_up (an ISO duration)
    alone, which is then all that is read."""

    columns: dict[str, Expression] = field(default_factory=dict)
    variables: dict[str, Expression] = field(default_factory=dict)
    criteria: list[Expression] = field(default_factory=list)
    begin: str | None = None
    end: str | None = None
    keys: list[str] = field(default_factory=lambda: list(KEYS))
    ending: str = "ending"
    pad_begin: int = 0
    pad_end: int = 0
    warm_up: str | None = None
    parameters: dict[str, object] = field(default_factory=dict)

    def _read(self, bars: DataFrame) -> DataFrame:
        """The bars that can matter; these filters reach the scan."""
        at = F.col(self.ending)
        if self.end is not None and not self.pad_end:  # no window looks ahead, so this may go below them
            bars = bars.where(at <= F.lit(self.end).cast("timestamp"))
        if self.begin is not None and self.warm_up is not None:
            bars = bars.where(at >= edate(F.lit(self.begin).cast("timestamp"), f"-{self.warm_up}"))
        return bars

    def looks_back(self) -> int | None:
        """How many bars before its own a row depends on; None if that can't be told."""
        w = W.partitionBy(*self.keys).orderBy(self.ending)
        before = reach.summed({name: reach.measured(e, w) for name, e in self.variables.items()})
        shown = [reach.through(*reach.measured(e, w), before) for e in (*self.columns.values(), *self.criteria)]
        return reach.longest(shown)

    def _stored(self, store: BlockStore) -> DataFrame:
        """The bars of a store that can matter."""
        bars = self.looks_back()
        end = None if self.pad_end else self.end
        return store.read(self.begin, end, bars_before=None if bars is None or self.warm_up is not None else bars + self.pad_begin)

    def __call__(self, bars: DataFrame | BlockStore | dict[str, DataFrame]) -> DataFrame:
        if isinstance(bars, BlockStore):
            bars = self._stored(bars)
        if isinstance(bars, dict):
            parts = {name: self._read(b) for name, b in bars.items()}
            finest = next(iter(parts))
            df = with_intervals(parts[finest], {n: b for n, b in parts.items() if n != finest}, self.keys, finest)
            fields = {f"{n}.{c}": F.col(n)[c] for n, b in parts.items() for c in b.columns if c not in self.keys and c != self.ending}
        else:
            df = self._read(bars)
            fields = {c: F.col(c) for c in bars.columns if c not in (*self.keys, self.ending)}
        named = [*self.variables, *self.parameters]
        clash = sorted({n.lower() for n in named} & {c.lower() for c in df.columns})
        if clash:
            raise ValueError(f"variables or parameters are named like fields: {clash}")
        w = W.partitionBy(*self.keys).orderBy(self.ending)
        df = df.withColumns({name: F.lit(value) for name, value in self.parameters.items()})
        for name, e in self.variables.items():
            df = df.withColumn(name, e(w))
        columns = {n: e(w) for n, e in self.columns.items()} if self.columns else fields
        made = {f"_c{i}": c for i, c in enumerate(columns.values())}
        tests = {f"_t{i}": F.coalesce(e(w).cast("boolean"), F.lit(False)) for i, e in enumerate(self.criteria)}
        df = df.withColumns(made | tests) if made or tests else df
        edge = lambda t, other: F.lit(other if t is None else t).cast("timestamp")
        begin, end = edge(self.begin, "0001-01-01"), edge(self.end, "9999-12-31")
        if self.pad_begin or self.pad_end:
            df = trim(df, begin, end, self.pad_begin, self.pad_end, self.keys, self.ending)
        elif self.begin is not None:
            df = df.where(F.col(self.ending) >= begin)
        for t in tests:
            df = df.where(F.col(t))
        return df.select(*self.keys, self.ending, *[F.col(f"_c{i}").alias(n) for i, n in enumerate(columns)])


def islands(df: DataFrame, kept: Column, keys: list[str] = KEYS, ending: str = "ending") -> DataFrame:
    """Runs of consecutive rows that meet a condition: adds `run` (null outside) and `exit`, whether the row after closes the run."""
    w = W.partitionBy(*keys).orderBy(ending)
    d = df.withColumn("_k", F.coalesce(kept.cast("boolean"), F.lit(False)).cast("int"))
    d = d.withColumn("_new", F.when((F.col("_k") == 1) & (F.coalesce(F.lag("_k").over(w), F.lit(0)) == 0), 1).otherwise(0))
    run = F.when(F.col("_k") == 1, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.withColumn("run", run).withColumn("exit", (F.col("_k") == 1) & (F.lead("_k").over(w) == 0)).drop("_k", "_new")
