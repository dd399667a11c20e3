"""Cheapest repairs of a sequence of turns, by the auction algorithm for shortest paths.

A row is one of the symbols s, u, a, o: the initial of its role (o: any other), upper case where leaving it in costs TRUNCATED more.
What is left must read `(s?(ua)+)?`: nodes are (rows done, state), arcs are the edits. Node prices start at a lower bound (what each row
costs at least) and no price ever exceeds an arc's cost plus the price at its head. The path is extended along an arc that meets this
bound, else its last node's price is raised to the least of the bounds and the path contracts. When it reaches the end, prices along all
cheapest paths are tight, so the arcs of the cheapest repairs are read off the prices and the least string of letters is traced.
"""

from __future__ import annotations

from functools import lru_cache

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
INF = 1 << 60
#: What is to be paid after the last row, by state: rows are put in until the pattern is whole.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
AT_END = (0, 2 * INSERT, INSERT, 0)
#: The state after a row of each role.
AFTER_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
#: The state after a row put in, or given the role that fits.
AFTER_FITTING = (USER, USER, ASSISTANT, USER)
#: From which states each state can be reached at all.
COMES_FROM = ({START}, {START, SYSTEM}, set(range(STATES)), set(range(STATES)))


def lattice(shape: str, exits: tuple[int, ...]) -> list[list[tuple[str, int, int]]]:
    """Arcs (letter, cost, head) of each node; the last node is the end, reached from each state after the last row at the price given
    by exits. Letters come in order. Rows put in after the last one aren't arcs: exits hold their cost."""
    n = len(shape)
    end = STATES * (n + 1)
    useful = set().union(*[COMES_FROM[q] for q in range(STATES) if exits[q] < INF])
    arcs: list[list[tuple[str, int, int]]] = []
    for i, symbol in enumerate(shape):
        left = TRUNCATED if symbol.isupper() else 0
        kept = AFTER_KEPT[symbol.lower()]
        for q in range(STATES):
            fitting = AFTER_FITTING[q]
            out = [("D", DELETE, q), ("I", INSERT, fitting - STATES), ("R", REROLE + left, fitting)]
            if q in kept:
                out.insert(2, ("K", left, kept[q]))
            arcs.append([(letter, cost, STATES * (i + 1) + to) for letter, cost, to in out if to % STATES in useful] if q in useful else [])
    arcs += [[("", exits[q], end)] if exits[q] < INF else [] for q in range(STATES)]
    return [*arcs, []]


def prices(shape: str, arcs: list[list[tuple[str, int, int]]], exits: tuple[int, ...], sources: tuple[int, ...]) -> list[int]:
    """Prices at which the cheapest paths from the sources (states before the first row) to the end are tight; INF where there is none."""
    n = len(shape)
    end = STATES * (n + 1)
    least = min(exits)
    price = [0] * (end + 1)
    for i in range(n, -1, -1):
        bound = least if i == n else price[STATES * (i + 1)] + (DELETE if shape[i].isupper() else 0)
        price[STATES * i : STATES * (i + 1)] = [bound] * STATES
    for source in sources:
        path = [source]
        while path[-1] != end and price[source] < INF:
            at, best, to = path[-1], INF, -1
            for _, cost, head in arcs[at]:
                if cost + price[head] < best:
                    best, to = cost + price[head], head
            if price[at] < best:
                price[at] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    return price


@lru_cache(maxsize=100_000)
def trace(shape: str, source: int, exits: tuple[int, ...]) -> tuple[int, str, int] | None:
    """(cost, letters, state after the last row) of the cheapest way from a state, of several the least letters; None without one."""
    arcs = lattice(shape, exits)
    price = prices(shape, arcs, exits, (source,))
    if price[source] >= INF:
        return None
    tight = [[arc for arc in out if price[at] == arc[1] + price[arc[2]]] for at, out in enumerate(arcs)]
    leads = [False] * len(arcs)
    leads[-1] = True
    for i in range(len(shape), -1, -1):  # a row's states may lead to each other, at most by two rows put in
        for _ in range(3):
            for at in range(STATES * i, STATES * (i + 1)):
                leads[at] = leads[at] or any(leads[head] for _, _, head in tight[at])
    letters, at, last = [], source, len(arcs) - 1
    while at < last - STATES:
        letter, _, at = next(arc for arc in tight[at] if leads[arc[2]])
        letters.append(letter)
    return price[source], "".join(letters), at % STATES


@lru_cache(maxsize=20_000)
def between(shape: str) -> tuple[int, ...]:
    """The least cost from each state before the rows to each state after them, row by row of the 4 by 4 table; INF where there is no way."""
    table = [[INF] * STATES for _ in range(STATES)]
    for to in range(STATES):
        exits = tuple(0 if q == to else INF for q in range(STATES))
        sources = tuple(sorted(COMES_FROM[to]))
        price = prices(shape, lattice(shape, exits), exits, sources)
        for source in sources:
            table[source][to] = min(price[source], INF)
    return tuple(x for row in table for x in row)
