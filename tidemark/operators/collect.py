"""Many securities on one time line: precedence, criteria, retained rows, order, head and tail, and columns that feed back."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import duration


def union(members: dict[str, DataFrame], temporal: str = "ending") -> DataFrame:
    """The rows of all members with their `index` and `temporal`; a column that a member lacks is null there."""
    out: DataFrame | None = None
    for name, df in members.items():
        tagged = df.withColumn("index", F.lit(name)).withColumn("temporal", F.col(temporal))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def ranked(df: DataFrame, precedence: list[Column], segment: list[str] | None = None) -> DataFrame:
    """Adds `seq`: the rank among the rows of one time; ties by index."""
    return df.withColumn("seq", F.row_number().over(W.partitionBy(*(segment or []), "temporal").orderBy(*precedence, "index")))


def sort_keys(df: DataFrame, column: str) -> list[Column]:
    """What orders a column as the comparator does: numbers, null as 0; texts by their characters. Of a column of texts, those that are
    numbers (and nulls, and empty ones, as 0) are put before the others and go by their value."""
    x, kind = F.col(column), df.schema[column].dataType.typeName()
    if kind in ("string", "varchar", "char"):
        number = F.when(F.coalesce(x, F.lit("")) == "", 0.0).otherwise(x.try_cast("double"))
        return [number.isNull(), F.coalesce(number, F.lit(0.0)), F.when(number.isNull(), x)]
    if kind in ("boolean", "byte", "short", "integer", "long", "float", "double", "decimal"):
        return [F.coalesce(x.cast("double") if kind == "boolean" else x, F.lit(0))]
    return [x]


def retain(df: DataFrame, criteria: list[Column]) -> DataFrame:
    """Rows that meet criteria of their own columns; ranks and rolling columns are taken after it, on what is retained."""
    for c in criteria:
        df = df.where(F.coalesce(c.cast("boolean"), F.lit(False)))
    return df


def bounds(begin: str, end: str, every: str) -> list[pd.Timestamp]:
    """Where the spans of an ISO duration begin, counted from begin (negative: back from end). A last span shorter than a twentieth of the
    duration joins the one before it."""
    months, days, seconds = duration(every)
    found, stop = [pd.Timestamp(begin)], pd.Timestamp(end)
    step = lambda k: pd.DateOffset(months=abs(months) * k, days=abs(days) * k, seconds=abs(seconds) * k)
    k = 1
    if months < 0 or days < 0 or seconds < 0:
        found = [stop]
        while found[-1] > pd.Timestamp(begin):
            found.append(stop - step(k))
            k += 1
        found = [pd.Timestamp(begin), *sorted(b for b in found if pd.Timestamp(begin) < b < stop)]
        if len(found) > 2 and found[1] - found[0] < (found[2] - found[1]) / 20:
            del found[1]
    else:
        while (at := pd.Timestamp(begin) + step(k)) < stop:
            found.append(at)
            k += 1
        if len(found) > 1 and stop - found[-1] < (found[-1] - found[-2]) / 20:
            found.pop()
    return found


def segments(df: DataFrame, begin: str, end: str, every: str) -> DataFrame:
    """Adds `segment`: which of the spans of a duration (see bounds) a row's time falls into."""
    starts = F.array(*[F.lit(str(b)).cast("timestamp") for b in bounds(begin, end, every)])
    return df.withColumn("segment", F.size(F.filter(starts, lambda s: s <= F.col("temporal"))))


def in_spans(df: DataFrame, spans: list[tuple[str, str, str]]) -> DataFrame:
    """Each row once for each span (since, begin, end) whose since to end holds its time; adds `segment` (the span's number, from 0) and
    `_begin`. Spans overlap where one leads up to what the one before shows."""
    made = "array<struct<since:timestamp,begin:timestamp,end:timestamp>>"
    rows = json.dumps([{"since": str(a), "begin": str(b), "end": str(c)} for a, b, c in spans])
    every = F.from_json(F.lit(rows), made, {"timestampFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"})
    numbered = F.transform(every, lambda s, i: F.struct(i.alias("segment"), s["since"].alias("since"), s["begin"].alias("begin"), s["end"].alias("end")))
    held = F.filter(numbered, lambda s: (s["since"] <= F.col("temporal")) & (F.col("temporal") <= s["end"]))
    return df.withColumn("_span", F.explode(held)).withColumn("segment", F.col("_span.segment")).withColumn("_begin", F.col("_span.begin")).drop("_span")


def ordered(df: DataFrame, order: list[tuple[str, bool]], head: int | None = None, tail: int | None = None, segment: list[str] | None = None) -> DataFrame:
    """order: (column, descending). Rows in order, ties by time and seq: all, the first, the last, or the first followed by the last
    (a row can be in both). With segment each segment has its own order, first and last rows; the segments follow each other."""
    spec = [*[(k, down) for c, down in order for k in sort_keys(df, c)], (F.col("temporal"), False), (F.col("seq"), False)]
    forth, back = ([c.desc() if down != turn else c.asc() for c, down in spec] for turn in (False, True))
    parts_by = segment or []
    if head is None and tail is None:
        return df.orderBy(*parts_by, *forth)

    def first(by: list[Column], n: int) -> DataFrame:
        if not segment:
            return df.orderBy(*by).limit(n)
        return df.withColumn("_nth", F.row_number().over(W.partitionBy(*segment).orderBy(*by))).where(F.col("_nth") <= n).drop("_nth")  # a limit before the shuffle, too

    parts = [first(by, n).withColumn("_part", F.lit(i)) for i, (by, n) in enumerate(((forth, head), (back, tail))) if n is not None]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.orderBy(*parts_by, "_part", *forth).drop("_part")


@dataclass
class Feedback:
    """Columns and criteria that depend on what rows before came to, gone through in order.

    scope: "time" (the rows before at the same time, by seq) or "security" (the rows before of the same security, by time). start: name of
    a state value -> its type and what it is before the first row. step(state, row): names -> columns, of state values what they become
    and of `added` (name -> type) what the row is given; keep(state, row), if given, sees both: a row that isn't kept leaves the state as
    it was and is not in the result."""

    scope: str
    start: dict[str, tuple[str, object]]
    step: Callable[[Column, Column], dict[str, Column]]
    added: dict[str, str]
    keep: Callable[[Column, Column], Column] | None = None


#: Rows in one block of a walk: arrays are put together block by block, so that a long one isn't copied once a row.
BLOCK = 64


def walked(df: DataFrame, feedback: Feedback, segment: list[str] | None = None) -> DataFrame:
    """df (index, temporal, seq) with the added columns, without the rows that aren't kept. One fold inside the JVM of the rows of a time,
    or of a series between two resets, which are brought together as an array: as many as there are securities, or as the series has
    bars. What needs neither bound is `fold`."""
    keys, order = {"time": (["temporal"], ["seq"]), "security": (["index"], ["temporal", "seq"])}[feedback.scope]
    keys = [*(segment or []), *keys]
    known = {**{k: t for k, (t, _) in feedback.start.items()}, **feedback.added}
    row_type = T.StructType([f for f in df.schema.fields if f.name not in known])
    names = row_type.names
    out_type = T.ArrayType(T.StructType([*row_type.fields, *T.StructType.fromDDL(", ".join(f"`{k}` {t}" for k, t in known.items() if k in feedback.added)).fields]))
    begin = F.struct(*[F.lit(v).cast(t).alias(k) for k, (t, v) in feedback.start.items()])
    nothing = F.array().cast(out_type)
    carried = lambda state, out: F.struct(state.alias("state"), out.alias("out"))

    def one(at: Column, row: Column) -> Column:
        state = at["state"]
        made = feedback.step(state, row)
        became = F.struct(*[made[k].cast(t).alias(k) if k in made else state[k].alias(k) for k, t in known.items()])

        def settled(m: Column) -> Column:
            full = F.struct(*[row[c].alias(c) for c in names], *[m[c].alias(c) for c in feedback.added])
            seen = F.struct(*[row[c].alias(c) for c in names], *[m[c].alias(c) for c in known])
            after = carried(F.struct(*[m[k].alias(k) for k in feedback.start]), F.concat(at["out"], F.array(full)))
            return after if feedback.keep is None else F.when(F.coalesce(feedback.keep(state, seen).cast("boolean"), F.lit(False)), after).otherwise(at)

        return F.element_at(F.transform(F.array(became), settled), 1)

    def block(at: Column, rows: Column) -> Column:
        done = F.aggregate(rows, carried(at["state"], nothing), one)
        return F.element_at(F.transform(F.array(done), lambda d: carried(d["state"], F.concat(at["out"], d["out"]))), 1)

    held = F.struct(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order)], F.struct(*names).alias("_r"))
    grouped = df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(held)), lambda r: r["_r"]).alias("_rows"))
    blocks = F.transform(F.sequence(F.lit(0), ((F.size("_rows") - 1) / BLOCK).cast("int")), lambda b: F.slice("_rows", b * BLOCK + 1, F.lit(BLOCK)))
    done = F.aggregate(blocks, carried(begin, nothing), block, lambda at: at["out"])
    return grouped.select(F.explode(done).alias("_r")).select("_r.*")


State = dict[str, Any]


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], State], step: Callable[[State, Any], dict[str, Any] | None], schema: str) -> DataFrame:
    """Columns that depend on what earlier rows came to: walks the rows of each key in order and calls step(state, row), which changes
    the state and returns the columns to add, or None to leave the row out (it is then not in anyone's history).

    schema names the added columns and their types. Keys are dealt over tasks, rows come batch by batch in order, and only the state
    is carried between batches, so a long series takes no more memory than a short one. With only per-security references the keys
    are segment and index; a fold over all securities has the segment alone, and its rows pass through one task per segment."""
    added = T.StructType.fromDDL(schema)
    names = added.names
    base = [f for f in df.schema.fields if f.name not in names]
    out_schema = T.StructType([*base, *added.fields])
    columns = [f.name for f in base]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), {}
        for frame in frames:
            rows, extra = [], []
            for i, row in enumerate(frame.itertuples(index=False)):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    current, state = key, start()
                made = step(state, row)
                if made is not None:
                    rows.append(i)
                    extra.append(made)
            if rows:
                kept = frame.iloc[rows][columns].reset_index(drop=True)
                yield pd.concat([kept, pd.DataFrame(extra, columns=names)], axis=1)

    dealt = (df.repartition(*keys) if keys else df.coalesce(1)).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(walk, out_schema)
