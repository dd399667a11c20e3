"""Where series come from: named sources by interval, securities and their contracts."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bars import failover, roll_up

ROLLED = ("week", "month", "quarter", "year")


class Catalog:
    """Sources by interval, in the order in which they are tried. An interval from a week on that no source has is rolled up from days."""

    def __init__(self) -> None:
        self.sources: dict[str, list[Callable[[], DataFrame]]] = {}

    def add(self, interval: str, source: Callable[[], DataFrame]) -> Catalog:
        self.sources.setdefault(interval, []).append(source)
        return self

    def fetch(self, interval: str, symbol: str | None = None, market: str | None = None, begin: str | None = None, end: str | None = None) -> DataFrame:
        if begin and end and begin > end:
            raise ValueError("begin must not be after end")
        if interval not in self.sources:
            if interval not in ROLLED or "day" not in self.sources:
                raise KeyError(f"no source of {interval}")
            out = roll_up(self.fetch("day", symbol, market), interval, adjust=True)
        else:
            found = [narrowed(s(), symbol, market) for s in self.sources[interval]]
            out = found[0] if len(found) == 1 else failover(found)
        for edge, later in ((begin, True), (end, False)):
            if edge:
                at = F.lit(edge).cast("timestamp")
                out = out.where(F.col("ending") >= at if later else F.col("ending") <= at)
        return out


def first_success(sources: list[Callable[[], DataFrame]]) -> DataFrame:
    """Intraday bars of the first source that can be read and has any; the error of the first if none can. What Spark or the file system
    reports passes on to the next source, other errors (of the source's own code) don't."""
    error, empty = None, None
    for source in sources:
        try:
            df = source()
            if df.limit(1).count():
                return df
            empty = df if empty is None else empty
        except (PySparkException, Py4JError, OSError) as e:
            error = error or e
    if empty is None:
        raise error or KeyError("no source")
    return empty


def with_contract(df: DataFrame, contracts: DataFrame, keys: tuple[str, ...] = ("symbol", "market")) -> DataFrame:
    """Each row with what is known of its contract (one row a symbol and market); a column that both have keeps the row's own value unless
    that is null. Rows of unknown contracts stay."""
    own = [c for c in contracts.columns if c not in keys]
    named = contracts.select(*keys, *[F.col(c).alias(f"_{c}") for c in own]).dropDuplicates(list(keys))
    joined = df.join(named, list(keys), "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in own else F.col(c) for c in df.columns], *[F.col(f"_{c}").alias(c) for c in own if c not in df.columns])


def narrowed(df: DataFrame, symbol: str | None, market: str | None) -> DataFrame:
    for name, value in (("symbol", symbol), ("market", market)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def lookup(securities: list[DataFrame], pattern: str, most: int = 12) -> DataFrame:
    """Securities whose symbol or name matches, merged over sources (first value that is not null), exact symbols before those that
    start alike, before others; the top twelve."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(securities)]
    every = tagged[0]
    for s in tagged[1:]:
        every = every.unionByName(s, allowMissingColumns=True)
    hit = every.where(F.col("symbol").rlike(f"(?i){pattern}") | F.col("name").rlike(f"(?i){pattern}"))
    merged = merge_first(hit, ["symbol", "market"])
    score = F.when(F.lower("symbol") == pattern.lower(), 0).when(F.lower(F.col("symbol")).startswith(pattern.lower()), 1).otherwise(2)
    return merged.orderBy(score, F.length("symbol"), "symbol", "market").limit(most)


def merge_first(df: DataFrame, keys: list[str], order: str = "_source") -> DataFrame:
    """One row a key; each column its first value, by order, that is not null."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def option_symbol(df: DataFrame, column: str = "symbol") -> DataFrame:
    """Adds root, expiry, right and strike of 21-letter option symbols; null for others."""
    pattern = r"^(.{6})(\d{6})([CP])(\d{8})$"
    part = lambda i: F.nullif(F.trim(F.regexp_extract(column, pattern, i)), F.lit(""))
    return df.withColumns({"root": part(1), "expiry": F.try_to_date(part(2), "yyMMdd") if hasattr(F, "try_to_date") else F.to_date(part(2), "yyMMdd"), "right": part(3), "strike": part(4).try_cast("double") / 1000})


def expected_dividends(last: DataFrame, count: int, weeks: int = 13) -> DataFrame:
    """For each security's last dividend (symbol, market, exdate, dividend) the next ones, one every so many weeks."""
    k = F.explode(F.sequence(F.lit(1), F.lit(count))).alias("k")
    return last.select("symbol", "market", "exdate", "dividend", k).select("symbol", "market", F.date_add("exdate", F.col("k") * (7 * weeks)).alias("exdate"), "dividend")
