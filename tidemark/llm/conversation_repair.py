"""Conversations put right: blank, repeated and cut-off turns found, and the cheapest edits after which roles alternate.

Rows are dealt by ranges of (conversation, turn), so a conversation lies in one task or in neighbouring ones, in order. A task solves
the conversations that lie in it whole (see `auction`); those at its edges, and those of more than WHOLE rows, go on as rows. They are
cut into blocks of BLOCK rows: each block's table of least costs from state to state is made by auctions of its own, a stream over the
tables (a few numbers a block) carries prices back from each conversation's end, one over the states that follow carries the state
forward, and each block then traces its own edits. So no task ever holds a conversation of many rows, only its tables, one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .auction import AFTER_FITTING, AFTER_KEPT, AT_END, DELETE, INF, START, STATES, USER, between, trace
from .common import stored

WHOLE, BLOCK = 128, 64
#: Characters of a text that deal it out among rows of one conversation, turn and role.
PREFIX = 64
SPACE = " \t\n\v\f\r"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

_ROW = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]
_PLACE = [("part", pa.int64()), ("place", pa.int64())]
_RESULT = [*[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired", pa.string())]
_BLOCK = [("conv_id", pa.int64()), *_PLACE, ("shape", pa.string()), ("forced", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), *[(c, pa.int64()) for c in COUNTS[1:5]], ("rows", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("least", pa.int64()), ("most", pa.int64()), ("distinct", pa.int64()), ("costs", pa.list_(pa.int64()))]
_DDL = {pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.string()): "array<string>"}


def over(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], fields: list[tuple[str, pa.DataType]], batch: int = 1000) -> DataFrame:
    """df.mapInArrow with a generator over rows (as dicts), in order, each batch converted at once."""
    schema = pa.schema(fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield from b.to_pylist()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in fn(rows(batches)):
            held.append(row)
            if len(held) >= batch:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return df.mapInArrow(each, ", ".join(f"`{name}` {_DDL[kind]}" for name, kind in fields))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes its ends of sentences,
    3 repeats it, 4 makes it the user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def combined(rows: DataFrame) -> DataFrame:
    """Equal rows of a batch as one with its copies, before anything is dealt out; rows that are gone keep their conversation's id alone."""
    gone = F.col("copies") == 0
    light = rows.select("conv_id", "turn", *[F.when(gone, "").otherwise(F.col(c)).alias(c) for c in ("role", "text")], "copies")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(["conv_id", "turn", "role", "text"], use_threads=False).aggregate([("copies", "sum")])
            yield from t.rename_columns({"copies_sum": "copies"}).select([name for name, _ in _ROW]).cast(pa.schema(_ROW)).to_batches()

    return light.mapInArrow(each, "conv_id bigint, turn bigint, role string, text string, copies bigint")


class Block:
    """What is known of consecutive rows of a conversation."""

    def __init__(self) -> None:
        self.shape: list[str] = []
        self.forced = [0]
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = self.distinct = 0
        self.first = self.last = self.least = self.most = None

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> None:
        """Adds equal rows; rows come by turn. seen: an earlier row has this role and text."""
        if not copies:
            return
        initial, kept = role[:1], text.rstrip(SPACE)
        if self.rows:
            self.illegal += (self.last, initial) not in LEGAL
        else:
            self.first = initial
        self.illegal += copies - 1
        self.last = initial
        self.rows += copies
        if turn is not None and turn != self.most:
            self.distinct += 1
            self.most = turn
            self.least = turn if self.least is None else self.least
        if not kept.strip(SPACE):
            self.blank += copies
            self.forced[-1] += copies
            return
        self.duplicate += copies - (not seen)
        if seen:
            self.forced[-1] += copies
            return
        cut = kept[-1] not in ".!?"
        self.truncated += cut
        symbol = initial if initial in ("s", "u", "a") else "o"
        self.shape.append(symbol.upper() if cut else symbol)
        self.roles.append(role)
        self.texts.append(text)
        self.forced.append(copies - 1)

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.distinct


def edited(shape: str, forced: list[int], roles: list[str], texts: list[str], source: int, exits: tuple[int, ...], last: bool) -> tuple[int, str, str]:
    """(cost, audit, repaired rows) of the rows, from a state on. Rows that must go do so before anything is put in where they stood; after
    the last row the pattern is made whole."""
    cost, letters, state = trace(shape, source, exits)
    cost += DELETE * sum(forced) - (0 if last else exits[state])
    audit, out, row, q = ["D" * forced[0]], [], 0, source
    for letter in letters:
        audit.append(letter)
        fitting = "assistant" if q == USER else "user"
        if letter == "I":
            out.append(f"{fitting}:")
            q = AFTER_FITTING[q]
            continue
        if letter != "D":
            role = roles[row] if letter == "K" else fitting
            out.append(f"{role}:{texts[row]}")
            q = AFTER_KEPT[shape[row].lower()][q] if letter == "K" else AFTER_FITTING[q]
        row += 1
        audit.append("D" * forced[row])
    if last:
        rest = {0: (), 5: ("assistant:",), 10: ("user:", "assistant:")}[AT_END[state]]
        audit.append("I" * len(rest))
        out += rest
    return cost, "".join(audit), "\n".join(out)


def solved(conv_id: int | None, rows: list[dict]) -> dict:
    """The result of a conversation whose rows are all here."""
    block, seen = Block(), set()
    for r in rows:
        key = (r["role"], r["text"])
        block.add(r["turn"], *key, r["copies"], key in seen)
        if r["copies"]:
            seen.add(key)
    cost, audit, repaired = edited("".join(block.shape), block.forced, block.roles, block.texts, START, AT_END, True)
    return {"conv_id": conv_id, "gaps": block.gaps, "blank": block.blank, "duplicate": block.duplicate, "truncated": block.truncated, "illegal": block.illegal, "cost": cost, "audit": audit, "repaired": repaired}


def whole_or_rows(whole: int) -> Callable[[Iterator[dict]], Iterator[dict]]:
    """Over rows in order: results of the conversations that lie here whole, and the numbered rows of the others."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        part, place = TaskContext.get().partitionId(), 0
        held: list[dict] = []
        edge = spilling = True  # the first conversation may have begun in the task before

        def numbered(some: list[dict]) -> Iterator[dict]:
            nonlocal place
            for r in some:
                yield r | {"part": part, "place": place}
                place += 1

        for r in rows:
            if held and r["conv_id"] != held[-1]["conv_id"]:
                if edge or spilling:
                    yield from numbered(held)
                else:
                    yield solved(held[0]["conv_id"], held)
                held, edge, spilling = [], False, False
            if held and all(r[c] == held[-1][c] for c in ("turn", "role", "text")):
                held[-1]["copies"] += r["copies"]
                continue
            held.append(r)
            if len(held) > whole:
                yield from numbered(held[:-1])
                held, spilling = held[-1:], True
        yield from numbered(held)

    return run


def blocks_of(size: int) -> Callable[[Iterator[dict]], Iterator[dict]]:
    """Over numbered rows in order, each with whether an earlier row is equal to it: the conversations' blocks."""

    def closed(key: tuple, place: int, block: Block) -> dict:
        shape = "".join(block.shape)
        out = {"conv_id": key[0], "part": key[1], "place": place, "shape": shape, "costs": list(between(shape))}
        return out | {c: getattr(block, c) for c in ("forced", "roles", "texts", "blank", "duplicate", "truncated", "illegal", "rows", "first", "last", "least", "most", "distinct")}

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        at, place, block = None, 0, Block()
        for r in rows:
            key = (r["conv_id"], r["part"], r["place"] // size)
            if key != at:
                if at is not None:
                    yield closed(at, place, block)
                at, place, block = key, r["place"], Block()
            block.add(r["turn"], r["role"], r["text"], r["copies"], r["seen"])
        if at is not None:
            yield closed(at, place, block)

    return run


def backward(rows: Iterator[dict]) -> Iterator[dict]:
    """Over blocks from each conversation's last one on: the prices after each block."""
    conv, exits = object(), AT_END
    for r in rows:
        last = r["conv_id"] != conv
        if last:
            conv, exits = r["conv_id"], AT_END
        yield {"part": r["part"], "place": r["place"], "exits": list(exits), "ends": int(last)}
        costs = r["costs"]
        exits = tuple(min(INF, *[costs[q * STATES + to] + exits[to] for to in range(STATES)]) for q in range(STATES))


def follow(rows: Iterator[dict]) -> Iterator[dict]:
    """For each block the state after it, by the state before."""
    for r in rows:
        ways = [trace(r["shape"], q, tuple(r["exits"])) for q in range(STATES)]
        yield {"conv_id": r["conv_id"], "part": r["part"], "place": r["place"], "goes": [-1 if w is None else w[2] for w in ways]}


def forward(rows: Iterator[dict]) -> Iterator[dict]:
    """Over blocks from each conversation's first one on: the state before each."""
    conv, state = object(), START
    for r in rows:
        if r["conv_id"] != conv:
            conv, state = r["conv_id"], START
        yield {"part": r["part"], "place": r["place"], "source": state}
        state = r["goes"][state]


def traced(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        cost, audit, repaired = edited(r["shape"], r["forced"], r["roles"], r["texts"], r["source"], tuple(r["exits"]), bool(r["ends"]))
        yield {name: r[name] for name, _ in _PIECE[: -len(_TRACED)]} | {"cost": cost, "audit": audit, "repaired": repaired}


_TRACED = [("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.string())]
_PIECE = [*[f for f in _BLOCK if f[0] not in ("shape", "forced", "roles", "texts", "costs")], *_TRACED]


def joined(rows: Iterator[dict]) -> Iterator[dict]:
    """Over pieces in order: a row a conversation, its repaired text as a digest that is carried along."""
    for conv, pieces in in_turn(rows):
        total = dict.fromkeys(COUNTS, 0)
        audit, digest, said, last = [], hashlib.sha256(), False, None
        least = most = None
        distinct = 0
        for p in pieces:
            for c in COUNTS[1:]:
                total[c] += p[c]
            if p["rows"]:
                total["illegal"] += last is not None and (last, p["first"]) not in LEGAL
                last = p["last"]
            if p["least"] is not None:
                distinct += p["distinct"] - (p["least"] == most)
                least, most = p["least"] if least is None else least, p["most"]
            audit.append(p["audit"])
            if p["repaired"]:
                digest.update((("\n" if said else "") + p["repaired"]).encode())
                said = True
        total["gaps"] = 0 if least is None else most - least + 1 - distinct
        yield {"conv_id": conv, **total, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def in_turn(rows: Iterator[dict]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Groups of consecutive rows of one conversation, each read while it comes."""
    yield from groupby(rows, lambda r: r["conv_id"])


def pieces(conversations: DataFrame, damage: bool = False, whole: int = WHOLE, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Two stored frames: results of conversations solved at once (conv_id, counts, audit, repaired), and the pieces of the others
    (conv_id, part, place, counts of the piece, audit, repaired), in the order of part and place."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    rows = combined(damaged(rows) if damage else rows.withColumn("copies", F.lit(1).cast("long")))
    ranges = rows.withColumn("prefix", F.substring("text", 1, PREFIX)).repartitionByRange("conv_id", "turn", "role", "prefix").drop("prefix")
    first = over(ranges.sortWithinPartitions("conv_id", "turn", "role", "text"), whole_or_rows(whole), [*_ROW, *_PLACE, *_RESULT])
    first = stored(first, "conversations")
    some = first.where("part is not null")
    keyed = some.where("copies > 0").select("conv_id", "role", F.sha2("text", 256).alias("digest"), "part", "place")
    fresh = keyed.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("part", "place")).alias("_f")).select("_f.part", "_f.place", F.lit(False).alias("_seen"))
    marked = some.select(*[name for name, _ in [*_ROW, *_PLACE]]).join(fresh, ["part", "place"], "left").withColumn("seen", F.coalesce("_seen", F.lit(True)))
    dealt = marked.withColumn("block", F.floor(F.col("place") / size)).repartition("part", "block").sortWithinPartitions("part", "place")
    blocks = stored(over(dealt, blocks_of(size), _BLOCK, 64), "blocks")
    at = [("part", pa.int64()), ("place", pa.int64())]
    tables = blocks.select("conv_id", "part", "place", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("place"))
    exits = stored(over(tables, backward, [*at, ("exits", pa.list_(pa.int64())), ("ends", pa.int64())]), "exits")
    keys = ["part", "place"]
    ways = over(blocks.select("conv_id", "shape", *keys).join(exits, keys), follow, [("conv_id", pa.int64()), *at, ("goes", pa.list_(pa.int64()))])
    sources = over(ways.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place"), forward, [*at, ("source", pa.int64())])
    others = stored(over(blocks.join(exits, keys).join(sources, keys), traced, _PIECE, 64), "pieces")
    return first.where("part is null").select("conv_id", *COUNTS, "audit", "repaired"), others


def repair(conversations: DataFrame, damage: bool = False, whole: int = WHOLE, size: int = BLOCK) -> DataFrame:
    """Returns a row a conversation: conv_id; gaps (turns missing between the least and the greatest); blank, duplicate and truncated rows
    (the first fault of each counts); illegal (neighbours whose roles' initials aren't su, ua or au); cost and audit of the cheapest
    edits (Keep 0, Rerole 1, Delete 2, Insert 5, a truncated row left in 5 more; blank and duplicate rows must go) after which the
    roles' initials read `(s?(ua)+)?`, of several the least string; repaired_sha256 of the repaired rows (`role:text`, joined by line
    feeds).

    Nulls of role and text are one space. Rows are taken by turn (nulls first), rows of one turn by role and text; repeated rows are
    rows, of which all but one are duplicates. Rows without a conv_id are one conversation. Other columns are left behind; an empty
    table gives no rows. damage: faults are put in first (see `damaged`); a conversation with no rows left has zeros, an empty audit
    and the digest of nothing.

    The digest of a conversation is read in order by one task, piece by piece; its audit is one value."""
    done, others = pieces(conversations, damage, whole, size)
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    here = done.withColumn("repaired_sha256", F.sha2(F.col("repaired").cast("binary"), 256)).select(*names)
    ordered = others.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return here.unionByName(over(ordered, joined, [("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())], 16))
