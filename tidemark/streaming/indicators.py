"""Indicators of a live stream of bars, with state kept by the engine: bars wait until no earlier one can come, then are gone through in order.

Each series has its last values and the bars that wait. A timer at a bar's end goes off when the watermark passes it; what the state
holds is bounded by the longest look-back and by the bars within the allowed lateness. Restarts take the state up where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Indicator = tuple[int, Callable[[np.ndarray], float]]  # values that it looks at, the current one included; what it makes of them


def ema(n: int) -> Indicator:
    """As lookback.ema: over the last 10 n values, from the mean of the first n of them."""

    def of(v: np.ndarray) -> float:
        if n == 1:
            return float(v[-1])
        a, m = 2 / (n + 1), float(v[:n].mean())
        for y in v[n:].tolist():
            m = y * a + m * (1 - a)
        return m

    return 10 * n, of


def rsi(n: int) -> Indicator:
    """As lookback.rsi: Wilder's over the last n + 250 values, smoothed from the mean of the first n changes; without a loss 100."""

    def of(v: np.ndarray) -> float:
        change = np.diff(v)
        up, down = np.maximum(change, 0.0), np.maximum(-change, 0.0)
        if not len(change):
            return float("nan")
        gain, loss = float(up[:n].mean()), float(down[:n].mean())
        for u, d in zip(up[n:].tolist(), down[n:].tolist(), strict=True):
            gain, loss = (gain * (n - 1) + u) / n, (loss * (n - 1) + d) / n
        return 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)

    return n + 250, of


class Running(StatefulProcessor):
    """The indicators of one series after each of its bars."""

    def __init__(self, keys: list[str], indicators: dict[str, Indicator]):
        self.keys, self.indicators = keys, indicators
        self.longest = max(n for n, _ in indicators.values())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "v array<double>")
        self.waiting = handle.getMapState("waiting", "at long", "x double")  # a bar that comes again replaces itself

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            micros = frame["ending"].astype("datetime64[us]").astype("int64")
            for at, x in zip(micros.tolist(), frame["value"].tolist(), strict=True):
                if at // 1000 > passed:  # later than allowed otherwise
                    self.waiting.updateValue((at,), (x,))
                    self.handle.registerTimer(-(-at // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        due = sorted((at, x) for (at,), (x,) in self.waiting.iterator() if at <= expiredTimerInfo.getExpiryTimeInMs() * 1000)
        values = list(self.recent.get()[0]) if self.recent.exists() else []
        out = []
        for at, x in due:
            self.waiting.removeKey((at,))
            values = [*values, 0.0 if x is None or x != x else float(x)][-self.longest :]
            v = np.array(values)
            out.append((*key, pd.Timestamp(at, unit="us"), x, *[of(v[-n:]) for n, of in self.indicators.values()]))
        if due:
            self.recent.update((values,))
            yield pd.DataFrame(out, columns=[*self.keys, "ending", "value", *self.indicators])

    def close(self) -> None:
        pass


def running(bars: DataFrame, keys: list[str], indicators: dict[str, Indicator], late: str) -> DataFrame:
    """Of a stream of bars (keys, texts; ending; value) a row a bar with the indicators: that of the same bars as a finished table. Rows
    come out when the watermark, `late` behind the latest ending, has passed them; bars later than that are dropped. null values are 0.

    State is kept by RocksDB: spark.sql.streaming.stateStore.providerClass has to name its provider."""
    schema = ", ".join([*[f"`{k}` string" for k in keys], "ending timestamp", "value double", *[f"`{name}` double" for name in indicators]])
    marked = bars.select(*keys, "ending", "value").withWatermark("ending", late)
    return marked.groupBy(*keys).transformWithStateInPandas(Running(keys, indicators), outputStructType=schema, outputMode="append", timeMode="EventTime")
