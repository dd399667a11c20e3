"""Periods of the market calendar, as columns: where one starts and ends, steps from one to another, and how many lie between.

Minutes and hours are cut from midnight; days are weekdays (a day of the weekend belongs to the Monday after it when rounding up, to
the Friday before it when rounding down); weeks run from Monday. Market hours, if given, bound the day; see `Sessions` for periods in
sessions, overnight ones and those without a gap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import local, workday

#: Months and minutes of the intervals.
MONTHS = {"month": 1, "quarter": 3, "year": 12}
DAY = 86_400
MINUTES = {"m1": 1, "m2": 2, "m5": 5, "m10": 10, "m15": 15, "m20": 20, "m30": 30, "m60": 60, "m120": 120, "m240": 240}


def _midnight(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def floor(ts: Column, interval: str) -> Column:
    """The start of the period that holds ts; a moment on a boundary starts its period."""
    if interval in MINUTES:
        step = MINUTES[interval] * 60_000_000
        since = F.unix_micros(ts) - F.unix_micros(_midnight(ts))
        return F.timestamp_micros(F.unix_micros(ts) - F.pmod(since, F.lit(step)))
    if interval == "day":
        back = F.greatest(F.weekday(ts) - 4, F.lit(0))
        return _midnight(ts) - F.make_dt_interval(days=back)
    return F.date_trunc(interval, ts)


def inc(ts: Column, interval: str, n: int = 1) -> Column:
    """The start of the period n periods after the one that holds ts (before it, if n is negative)."""
    start = floor(ts, interval)
    if interval in MINUTES:
        return start + F.make_dt_interval(mins=F.lit(n * MINUTES[interval]))
    if interval == "day":
        return workday(start, F.lit(n))
    if interval == "week":
        return start + F.make_dt_interval(days=F.lit(7 * n))
    return start + F.make_interval(months=F.lit(n * MONTHS[interval]))


def dec(ts: Column, interval: str, n: int = 1) -> Column:
    return inc(ts, interval, -n)


def ceil(ts: Column, interval: str) -> Column:
    """The first boundary at or after ts."""
    start = floor(ts, interval)
    return F.when(start == ts, ts).otherwise(inc(ts, interval, 1))


def diff(a: Column, b: Column, interval: str) -> Column:
    """Periods from that of b to that of a."""
    x, y = floor(a, interval), floor(b, interval)
    if interval in MINUTES:
        return F.floor((F.unix_micros(x) - F.unix_micros(y)) / (MINUTES[interval] * 60_000_000)).cast("int")
    if interval == "day":
        weekdays = lambda t: F.floor(F.datediff(t, F.lit("1970-01-05").cast("date")) / 7) * 5 + F.weekday(t)
        return (weekdays(x) - weekdays(y)).cast("int")
    if interval == "week":
        return F.floor(F.datediff(x, y) / 7).cast("int")
    months = (F.year(x) - F.year(y)) * 12 + F.month(x) - F.month(y)
    return F.floor(months / MONTHS[interval]).cast("int")


def session(ts: Column, opens: str, closes: str, tz: str | None = None) -> tuple[Column, Column]:
    """Open and close, by the exchange's clock, of the market day that ts falls into. Overnight hours (closing no later than they
    open) belong to the day on which they close; days of the weekend to the Monday after."""
    t = local(ts, tz)
    seconds = lambda s: sum(int(x) * k for x, k in zip(s.split(":"), (3600, 60, 1), strict=True))
    o, c = seconds(opens), seconds(closes)
    overnight = c <= o
    since = (F.unix_micros(t) - F.unix_micros(_midnight(t))) / 1e6
    day = _midnight(t) + F.make_dt_interval(days=F.when(since > c, 1).otherwise(0))
    day = day + F.make_dt_interval(days=F.when(F.weekday(day) > 4, 7 - F.weekday(day)).otherwise(0))
    close = day + F.make_dt_interval(secs=F.lit(c))
    start = (day - F.make_dt_interval(days=F.lit(1)) if overnight else day) + F.make_dt_interval(secs=F.lit(o))
    return start, close


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value in the expression once, however often body takes it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@dataclass(frozen=True)
class Sessions:
    """The trading sessions of a market and the periods in them, by arithmetic on numbers: no table, no join.

    A session belongs to the weekday on which it closes; hours that close no later than they open began the evening before. Minutes and
    hours are cut from midnight and clipped to the session; where they leave no gap from day to day (24 hours, or nearly, so that the
    periods fill the day) the sessions of a week are one, from its first open to its last close. A day is a session; weeks, months,
    quarters and years are the sessions that close in them. Outside the sessions a moment is rounded down to the next open, and up to
    the close before.

    opens and closes are those of the exchange's clock, which is that of tz (if given: moments are then of the session's time zone, and
    so are results)."""

    opens: str
    closes: str
    tz: str | None = None

    def _clock(self) -> tuple[int, int, int]:
        """Open and close in seconds of the day, and the days by which the open is earlier."""
        at = lambda s: sum(int(x) * k for x, k in zip(s.split(":"), (3600, 60, 1), strict=True))
        o, c = at(self.opens), at(self.closes)
        return o, c, int(c <= o)

    def _step(self, interval: str) -> int:
        return MINUTES[interval] * 60

    def _continuous(self, interval: str) -> bool:
        o, c, before = self._clock()
        return interval in MINUTES and -(-(before * DAY + c - o) // self._step(interval)) * self._step(interval) >= DAY

    def _cells(self, interval: str) -> tuple[int, int, int, int]:
        """Of what periods of minutes lie in (a session, or the week): the seconds from its day's (its Monday's) midnight to its open and
        its close, and the first cell and the number of cells of the interval's grid."""
        o, c, before = self._clock()
        first, last = o - before * DAY, c + (4 * DAY if self._continuous(interval) else 0)
        step = self._step(interval)
        return first, last, first // step, -(-last // step) - first // step

    def _own(self, ts: Column) -> Column:
        return local(ts, self.tz)

    def _out(self, t: Column) -> Column:
        return t if self.tz is None else F.to_utc_timestamp(t, self.tz)

    @staticmethod
    def _day(t: Column) -> Column:
        """Days since a Monday."""
        return F.datediff(t, F.lit("1970-01-05").cast("date")).cast("long")

    @staticmethod
    def _weekdays(day: Column, up: bool) -> Column:
        """The number of a weekday; a day of the weekend counts as the Monday after it, or the Friday before."""
        week, d = F.floor(day / 7), F.pmod(day, F.lit(7))
        return week * 5 + (F.least(d, F.lit(5)) if up else F.least(d, F.lit(4)))

    @staticmethod
    def _date(number: Column) -> Column:
        """Days since that Monday of a weekday's number."""
        return F.floor(number / 5) * 7 + F.pmod(number, F.lit(5))

    @staticmethod
    def _at(day: Column, seconds: Column | int) -> Column:
        return F.timestamp_micros(((day + 4) * DAY + seconds).cast("long") * 1_000_000)

    def _seconds(self, t: Column) -> Column:
        """Seconds of the day, with their fraction."""
        return (F.unix_micros(t) - F.unix_micros(_midnight(t))) / 1e6

    def _session(self, t: Column, up: bool) -> Column:
        """The number of the first session that closes after t, or of the last one that opened before."""
        o, c, before = self._clock()
        if up:
            return self._weekdays(self._day(t) + (self._seconds(t) >= c).cast("long"), True)
        return self._weekdays(self._day(t) + before - (self._seconds(t) <= o).cast("long"), False)

    def _month(self, session: Column, interval: str) -> Column:
        day = F.date_add(F.lit("1970-01-05").cast("date"), self._date(session).cast("int"))
        return F.floor((F.year(day) * 12 + F.month(day) - 1) / MONTHS[interval])

    def _number(self, t: Column, interval: str, up: bool) -> Column:
        """The number of the first period that ends after t (up), or of the last that began before it."""
        return _let(t, lambda x: _let(self._session(x, up), lambda session: self._of_session(x, session, interval, up)))

    def _of_session(self, t: Column, session: Column, interval: str, up: bool) -> Column:
        if interval == "day":
            return session
        if interval == "week":
            return F.floor(session / 5)
        if interval in MONTHS:
            return self._month(session, interval)
        first, last, cell, cells = self._cells(interval)
        unit = F.floor(session / 5) if self._continuous(interval) else session
        start = unit * 7 if self._continuous(interval) else self._date(session)
        since = (self._day(t) - start) * DAY + self._seconds(t)
        within = F.floor(since / self._step(interval)) if up else F.ceil(since / self._step(interval)) - 1
        return unit * cells + F.least(F.greatest(within - cell, F.lit(0)), F.lit(cells - 1))

    def _edges(self, number: Column, interval: str) -> tuple[Column, Column]:
        """Start and end of a period, by the exchange's clock."""
        o, c, before = self._clock()
        session = lambda s: (self._at(self._date(s), o - before * DAY), self._at(self._date(s), c))
        if interval == "day":
            return session(number)
        if interval == "week":
            return session(number * 5)[0], session(number * 5 + 4)[1]
        if interval in MONTHS:
            month = number * MONTHS[interval]
            begin = lambda m: self._day(F.make_date(F.floor(m / 12).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(1)))
            return session(self._weekdays(begin(month), True))[0], session(self._weekdays(begin(month + MONTHS[interval]) - 1, False))[1]
        first, last, cell, cells = self._cells(interval)
        unit, at = F.floor(number / cells), F.pmod(number, F.lit(cells)) + cell
        day = unit * 7 if self._continuous(interval) else self._date(unit)
        step = self._step(interval)
        return self._at(day, F.greatest(at * step, F.lit(first))), self._at(day, F.least((at + 1) * step, F.lit(last)))

    def _edge(self, number: Column, interval: str, end: int) -> Column:
        return self._out(_let(number, lambda n: self._edges(n, interval)[end]))

    def floor(self, ts: Column, interval: str) -> Column:
        """The start of the period that holds ts."""
        return self._edge(self._number(self._own(ts), interval, True), interval, 0)

    def ceil(self, ts: Column, interval: str) -> Column:
        """The end of the period that holds ts; a moment on a boundary ends its period."""
        return self._edge(self._number(self._own(ts), interval, False), interval, 1)

    def inc(self, ts: Column, interval: str, n: int = 1) -> Column:
        """The end of the n-th period from the one that begins with floor(ts) on; n = 0: ts, or the close before it outside the sessions."""
        if n < 0:
            return self.dec(ts, interval, -n)
        if n == 0:
            return F.least(ts, self.ceil(ts, interval))
        return self._edge(self._number(self._own(ts), interval, True) + (n - 1), interval, 1)

    def dec(self, ts: Column, interval: str, n: int = 1) -> Column:
        """The end of the n-th period before the one that ends with ceil(ts)."""
        if n <= 0:
            return self.inc(ts, interval, -n)
        return self._edge(self._number(self._own(ts), interval, False) - n, interval, 1)

    def diff(self, to: Column, since: Column, interval: str) -> Column:
        """How many periods lie between, those begun included; negative if `to` is the earlier one."""
        a, b = self._own(to), self._own(since)
        count = lambda x, y: F.greatest(self._number(x, interval, False) - self._number(y, interval, True) + 1, F.lit(0))
        return F.when(a == b, 0).when(a > b, count(a, b)).otherwise(-count(b, a)).cast("long")
