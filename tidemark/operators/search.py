"""Search over parameters and signals: candidates are rows or columns of one Spark job, never a job each."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from itertools import product
from random import Random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Candidate = dict[str, float]


def grid(values: dict[str, list[float]], valid: Callable[[Candidate], bool] | None = None) -> list[Candidate]:
    """All combinations of parameter values that are valid, in order."""
    names = list(values)
    found = (dict(zip(names, v, strict=True)) for v in product(*values.values()))
    return [c for c in found if valid is None or valid(c)]


def scored(df: DataFrame, candidates: list[Candidate], score: Callable[[Candidate], Column], batch: int = 200) -> list[tuple[float | None, Candidate]]:
    """The score, an aggregate column of df, of each candidate: a batch is one pass over df with an aggregate each. Columns that
    candidates share (such as a moving average of one length) belong in df, once."""
    out = []
    for i in range(0, len(candidates), batch):
        some = candidates[i : i + batch]
        row = df.agg(*[score(c).alias(f"s{j}") for j, c in enumerate(some)]).first()
        out += [(row[j], c) for j, c in enumerate(some)]
    return out


def best(scores: list[tuple[float | None, Candidate]], solutions: int = 1) -> list[tuple[float, Candidate]]:
    """The best first; ties as they came; candidates without a score are out."""
    return sorted((s for s in scores if s[0] is not None), key=lambda s: -s[0])[:solutions]


def optimize(df: DataFrame, values: dict[str, list[float]], score: Callable[[Candidate], Column], valid: Callable[[Candidate], bool] | None = None, solutions: int = 1, exhaustive: int = 2000, generations: int = 12, population: int = 16, seed: int = 1, start: list[Candidate] | None = None) -> list[tuple[float, Candidate]]:
    """The parameters of the best score. Up to `exhaustive` combinations are all tried; beyond that an evolution strategy goes on from
    the best half of each generation, changing values by steps along their lists; `start` are candidates of the first, as those that
    did best on sampled periods. Each generation is one pass."""
    size = 1
    for v in values.values():
        size *= len(v)
    if size <= exhaustive:
        return best(scored(df, grid(values, valid), score), solutions)
    rng, known = Random(seed), {}
    key = lambda c: tuple(c[k] for k in values)
    fresh = lambda: {k: rng.choice(v) for k, v in values.items()}
    parents: list[Candidate] = []
    for _ in range(generations):
        wanted: dict[tuple, Candidate] = {key(c): c for c in start or [] if key(c) not in known and (valid is None or valid(c))}
        for _ in range(50 * population):
            if len(wanted) >= population:
                break
            c = fresh() if not parents or rng.random() < 0.2 else dict(rng.choice(parents))
            for k, v in values.items():
                if parents and rng.random() < 0.7:
                    at = v.index(c[k]) + round(rng.gauss(0, max(1.0, len(v) / 8)))
                    top = len(v) - 1
                    c[k] = v[min(top, abs(at) if at < 0 else at if at <= top else max(0, 2 * top - at))]
            if key(c) not in known and (valid is None or valid(c)):
                wanted[key(c)] = c
        if not wanted:
            break
        known |= {key(c): (s, c) for s, c in scored(df, list(wanted.values()), score)}
        parents = [c for _, c in best(list(known.values()), population // 2)]
    return best(list(known.values()), solutions)


def sample_periods(begin: datetime, end: datetime, length: timedelta, count: int, seed: int = 1) -> list[tuple[datetime, datetime]]:
    """So many periods of a length, each at a day chosen at random, all within begin and end."""
    rng, days = Random(seed), max(0, (end - begin - length).days)
    return [(at, min(end, at + length)) for at in (begin + timedelta(days=rng.randint(0, days)) for _ in range(count))]


def from_samples(df: DataFrame, time: str, periods: list[tuple[datetime, datetime]], values: dict[str, list[float]], score: Callable[[Candidate], Column], valid: Callable[[Candidate], bool] | None = None, solutions: int = 1, **search: int) -> list[Candidate]:
    """What does best in each period, the periods in turn: candidates to start a search over the whole from."""
    each = [optimize(df.where((F.col(time) >= F.lit(a)) & (F.col(time) <= F.lit(b))), values, score, valid, solutions, **search) for a, b in periods]
    found: list[Candidate] = []
    for rank in range(solutions):
        found += [c[rank][1] for c in each if rank < len(c) and c[rank][1] not in found]
    return found


def best_signals(df: DataFrame, signals: dict[str, tuple[dict[str, list[float]], Callable[[Candidate], Column]]], solutions: int = 1, valid: Callable[[Candidate], bool] | None = None) -> list[tuple[float, str, Candidate]]:
    """Each signal with its best parameters, the best signals first; all signals' grids are scored together."""
    every = [(name, c) for name, (values, _) in signals.items() for c in grid(values, valid)]
    tagged = [{"_at": float(i)} for i in range(len(every))]
    scores = scored(df, tagged, lambda t: signals[every[int(t["_at"])][0]][1](every[int(t["_at"])][1]))
    top: dict[str, tuple[float, str, Candidate]] = {}
    for s, t in scores:
        name, c = every[int(t["_at"])]
        if s is not None and (name not in top or s > top[name][0]):
            top[name] = (s, name, c)
    return sorted(top.values(), key=lambda x: -x[0])[:solutions]


Strategy = tuple[tuple[str, ...], ...]  # a disjunction of conjunctions of signal names


def strategy_column(strategy: Strategy, signals: dict[str, Column]) -> Column:
    out = F.lit(False)
    for conjunction in strategy:
        both = F.lit(True)
        for name in conjunction:
            both = both & F.coalesce(signals[name].cast("boolean"), F.lit(False))
        out = out | both
    return out


def neighbours(strategy: Strategy, names: list[str], most: int) -> list[Strategy]:
    """Strategies one step away: a signal more or less in a conjunction, a conjunction more."""
    found: set[Strategy] = set()
    norm = lambda cs: tuple(sorted({tuple(sorted(set(c))) for c in cs if c}))
    for i, c in enumerate(strategy):
        rest = [*strategy[:i], *strategy[i + 1 :]]
        for n in names:
            found.add(norm([*rest, (*c, n)]))
        for j in range(len(c)):
            found.add(norm([*rest, (*c[:j], *c[j + 1 :])]))
    for n in names:
        found.add(norm([*strategy, (n,)]))
    return sorted(s for s in found if s and s != strategy and sum(map(len, s)) <= most)


def strategize(df: DataFrame, signals: dict[str, Column], score: Callable[[Column], Column], conjunction_cost: float = 0.0, disjunction_cost: float = 0.0, most_operands: int = 4, rounds: int = 10) -> tuple[float, Strategy]:
    """Climbs from the best single signal to better combinations, each of whose further operands costs; one pass over df a round."""
    cost = lambda s: conjunction_cost * sum(len(c) - 1 for c in s) + disjunction_cost * (len(s) - 1)

    def rated(some: list[Strategy]) -> list[tuple[float, Strategy]]:
        rows = scored(df, [{"_at": float(i)} for i in range(len(some))], lambda t: score(strategy_column(some[int(t["_at"])], signals)))
        return [(s - cost(some[int(t["_at"])]), some[int(t["_at"])]) for s, t in rows if s is not None]

    top = max(rated([((n,),) for n in sorted(signals)]), key=lambda x: x[0])
    for _ in range(rounds):
        near = rated(neighbours(top[1], sorted(signals), most_operands))
        better = max(near, key=lambda x: x[0], default=top)
        if better[0] <= top[0]:
            break
        top = better
    return top


def as_rows(spark: SparkSession, found: list[tuple[float, Candidate]]) -> DataFrame:
    """Solutions as rows (score, parameters)."""
    return spark.createDataFrame([(float(s), {k: float(v) for k, v in c.items()}) for s, c in found], "score double, parameters map<string,double>")
