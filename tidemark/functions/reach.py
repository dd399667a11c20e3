"""How many bars before its own an expression looks at, found by making the expression.

Functions that look back say how far (`looks_back`). While an expression is made under `measured`, what they say is noted; an expression
with a window that none of them accounts for, or that goes over another window than its series', may look at any bar before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, WindowSpec

UNBOUNDED = None
Note = tuple[int | None, int]  # bars, windows in what was returned
_notes: ContextVar[tuple[WindowSpec, list[Note]] | None] = ContextVar("_notes", default=None)


def windows(made: object) -> int:
    """Windows in a column's text, or in those of several."""
    return sum(map(windows, made)) if isinstance(made, tuple) else repr(made).count(" OVER (") if isinstance(made, Column) else 0


def longest(bars: Iterable[int | None]) -> int | None:
    held = list(bars)
    return UNBOUNDED if any(b is UNBOUNDED for b in held) else max(held, default=0)


def looks_back(bars: Callable[..., int | None]) -> Callable:
    """For a function whose last argument is the window: bars(its arguments) is how many bars before its own it looks at."""

    def add(f: Callable) -> Callable:
        @wraps(f)
        def made(*args, **named):  # noqa: ANN002, ANN003, ANN202
            held = _notes.get()
            if held is None:
                return f(*args, **named)
            w, notes = held
            inner: list[Note] = []
            token = _notes.set((w, inner))
            try:
                out = f(*args, **named)
            finally:
                _notes.reset(token)
            over = named.get("w", args[-1] if args else None)
            own = bars(*args, **named) if over is w else UNBOUNDED
            notes.append((longest([own, *[b for b, _ in inner]]), windows(out)))
            return out

        return made

    return add


def measured(make: Callable[[WindowSpec], Column], w: WindowSpec) -> tuple[Column, int | None]:
    """The expression over the window, and how many bars before its own it looks at."""
    notes: list[Note] = []
    token = _notes.set((w, notes))
    try:
        out = make(w)
    finally:
        _notes.reset(token)
    known = windows(out) <= sum(n for _, n in notes)
    return out, longest(b for b, _ in notes) if known else UNBOUNDED


def summed(variables: dict[str, tuple[Column, int | None]]) -> dict[str, int | None]:
    """For each variable its own bars and those of the variables before it that it names, the furthest of them."""
    out: dict[str, int | None] = {}
    for name, (column, own) in variables.items():
        out[name] = through(column, own, out)
    return out


def through(column: Column, own: int | None, before: dict[str, int | None]) -> int | None:
    """A column's own bars and those of what it names. A name that merely looks like a variable's counts too: that reads more, not less."""
    text = repr(column)
    named = longest(bars for name, bars in before.items() if re.search(rf"(?<![\w]){re.escape(name)}(?![\w])", text, re.IGNORECASE))
    return UNBOUNDED if own is UNBOUNDED or named is UNBOUNDED else own + named
