"""RSI kept up to date over a stream of bars, by typed state and event-time timers.

A symbol's state is one typed row (bars seen, last close, smoothed gain and loss, time of the last bar) and a list of the
bars that the watermark has not passed yet.  A bar that arrives late, but within the allowance, lands in that list and is
put in its place; when the watermark passes, all bars it has passed leave the list in time order and advance the smoothing
as whole arrays, without a loop over bars.  Bars that are later than the allowance are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

N = 14
OUTPUT = "symbol string, ts timestamp_ntz, close double, rsi_14 double"
STATE = "n bigint, close double, gain double, loss double, last bigint"
PENDING = "ts bigint, at bigint, close double"
#: bars smoothed at once; (1 - 1/N) to this power stays far from underflow
SEGMENT = 512
#: typed state lives in RocksDB; settings of the session that runs the stream
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def smoothed(x: np.ndarray, seen: int, before: float) -> np.ndarray:
    """Wilder smoothing of changes number ``seen`` + 1 and on: the first N are averaged, later ones enter with weight 1/N."""
    first = max(0, min(len(x), N - seen))
    mean = (seen * before + np.cumsum(x[:first])) / (seen + 1 + np.arange(first))
    out, at = [mean], mean[-1] if first else before
    q = 1.0 - 1.0 / N
    for start in range(first, len(x), SEGMENT):
        part = x[start : start + SEGMENT]
        power = q ** np.arange(1, len(part) + 1)
        out.append(power * (at + np.cumsum(part / N / power)))
        at = out[-1][-1]
    return np.concatenate(out)


def advance(state: tuple, close: np.ndarray) -> tuple[np.ndarray, tuple]:
    """RSI of the bars that follow a state (n, close, gain, loss), null before N changes, and the state after them."""
    n, last, gain, loss = state
    moves = np.diff(close, prepend=close[0] if n == 0 else last)
    if n == 0:
        moves = moves[1:]
    seen = max(0, n - 1)
    gains, losses = smoothed(np.maximum(moves, 0.0), seen, gain), smoothed(np.maximum(-moves, 0.0), seen, loss)
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(losses == 0, 100.0, 100.0 - 100.0 / (1.0 + gains / losses))
    rsi[seen + 1 + np.arange(len(moves)) < N] = np.nan
    if n == 0:
        rsi = np.concatenate([[np.nan], rsi])
    return rsi, (n + len(close), float(close[-1]), float(gains[-1]) if len(gains) else gain, float(losses[-1]) if len(losses) else loss)


class RsiProcessor(StatefulProcessor):
    """State and timers of one symbol; rows have the bar's time ``ts`` and the event time ``at`` that the watermark must reach."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.smoothing = handle.getValueState("smoothing", STATE)
        self.pending = handle.getListState("pending", PENDING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows), ignore_index=True).dropna(subset=["close", "ts"])
        if len(bars):
            ts, at = _micros(bars["ts"]), _micros(bars["at"])
            self.pending.appendList(list(zip(ts.tolist(), at.tolist(), bars["close"].tolist())))
            self._wake(at)
        yield _result(key, [], [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = pd.DataFrame(list(self.pending.get()), columns=["ts", "at", "close"])
        ready = held[held["at"] <= passed].drop_duplicates("ts", keep="last").sort_values("ts")
        later = held[held["at"] > passed]
        self.pending.clear()
        if len(later):
            self.pending.put(list(later.itertuples(index=False, name=None)))
            self._wake(later["at"].to_numpy())
        state = self.smoothing.get() if self.smoothing.exists() else (0, 0.0, 0.0, 0.0, -(1 << 62))
        ready = ready[ready["ts"] > state[4]]
        if len(ready):
            rsi, after = advance(tuple(state[:4]), ready["close"].to_numpy(float))
            self.smoothing.update((*after, int(ready["ts"].iloc[-1])))
            yield _result(key, ready["ts"], ready["close"], rsi)
        else:
            yield _result(key, [], [], [])

    def _wake(self, at: np.ndarray) -> None:
        """A timer for the earliest bar that waits and one for the newest; a woken symbol takes all bars that the
        watermark has passed and asks to be woken for the rest."""
        for t in {int(np.min(at)), int(np.max(at))}:
            self.handle.registerTimer(-(-t // 1000))

    def close(self) -> None:
        pass


def _micros(ts: pd.Series) -> np.ndarray:
    ts = ts.dt.tz_convert("UTC").dt.tz_localize(None) if ts.dt.tz is not None else ts
    return ts.to_numpy().astype("datetime64[us]").astype(np.int64)


def _result(key, ts, close, rsi) -> pd.DataFrame:
    rsi = np.asarray(rsi, float)
    values = pd.array(np.where(np.isnan(rsi), 0.0, rsi), dtype="Float64")
    values[np.isnan(rsi)] = pd.NA
    when = pd.Series(np.asarray(ts, np.int64).astype("datetime64[us]"))
    return pd.DataFrame({"symbol": pd.Series([key[0]] * len(values), dtype=object), "ts": when, "close": pd.Series(np.asarray(close, float)), "rsi_14": values})


def streaming_rsi(bars: DataFrame, late: str | None = "1 hour") -> DataFrame:
    """RSI of a stream of bars (symbol, ts, close) in any order within ``late``; a bar comes out when the watermark (the
    newest bar minus ``late``) has reached it.  With ``late`` None the stream has a watermark on ``at`` already, the bars'
    end times.  The session needs the settings of ``STORE``."""
    if late is not None:
        bars = bars.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return bars.select("symbol", "ts", "close", "at").groupBy("symbol").transformWithStateInPandas(RsiProcessor(), OUTPUT, "append", "eventTime")
