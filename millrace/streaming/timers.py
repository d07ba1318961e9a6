"""Sessions kept in state of their own and closed by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

Session = tuple[int, int, int]  # first and last event in microseconds, events


def merged(sessions: list[Session], gap: int) -> list[Session]:
    """Sessions less than ``gap`` apart become one; the order in which events came does not matter."""
    out: list[Session] = []
    for first, last, n in sorted(sessions):
        if out and first - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(last, out[-1][1]), n + out[-1][2])
        else:
            out.append((first, last, n))
    return out


#: Keys whose sessions are kept together, about, and the least number of such slots.
SLOT_KEYS, LEAST_SLOTS = 512, 16


def folded(sessions: pd.DataFrame, gap: int) -> pd.DataFrame:
    """``key, first, last, n``: what ``merged`` makes of the sessions of each key; a missing key is one too."""
    code = pd.factorize(sessions["key"], use_na_sentinel=False)[0]
    order = np.lexsort((sessions["last"], sessions["first"], code))
    sessions, code = sessions.take(order), code[order]
    first, last = sessions["first"].to_numpy(), sessions["last"].groupby(code).cummax().to_numpy()
    starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (first[1:] - last[:-1] >= gap)))[: len(code)]
    ends = np.append(starts[1:], len(code))[: len(starts)] - 1
    sums = np.add.reduceat(sessions["n"].to_numpy(), starts) if len(starts) else []
    return pd.DataFrame({"key": sessions["key"].to_numpy()[starts], "first": first[starts], "last": last[ends], "n": sums})


class TimedSessions(StatefulProcessor):
    """Open sessions of a slot of keys, as arrays; a timer at the end of the first gap to end closes what the watermark has passed.

    Events are folded frame by frame, so the state and memory grow with open sessions, not with events.
    """

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "key array<string>, first array<long>, last array<long>, n array<long>")

    def _kept(self) -> pd.DataFrame:
        key, first, last, n = self.open.get() if self.open.exists() else ((), (), (), ())
        longs = {name: np.asarray(c, np.int64) for name, c in (("first", first), ("last", last), ("n", n))}
        return pd.DataFrame({"key": np.asarray(key, object), **longs})

    def _keep(self, sessions: pd.DataFrame) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if len(sessions):
            self.open.update(tuple(sessions[c].tolist() for c in ("key", "first", "last", "n")))
            self.handle.registerTimer(int(self._ends(sessions).min()))
        else:
            self.open.clear()

    def _ends(self, sessions: pd.DataFrame) -> pd.Series:
        return -(-(sessions["last"] + self.gap) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sessions = self._kept()
        for frame in rows:
            new = pd.DataFrame({"key": frame["key"].astype(object), "first": frame["micros"], "last": frame["micros"], "n": np.int64(1)})
            sessions = folded(pd.concat([sessions, new], ignore_index=True), self.gap)
        self._keep(sessions)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions = self._kept()
        done = self._ends(sessions) <= timerValues.getCurrentWatermarkInMs()
        self._keep(sessions[~done])
        if done.any():
            yield sessions[done]

    def close(self) -> None:
        pass


def timed_sessions(stream: DataFrame, key: str, gap_seconds: int, keys: int = 0) -> DataFrame:
    """``key, first, last, n`` of sessions as the watermark closes them, for a watermarked stream with ``key`` and ``micros``.

    A call for state costs the same for one key as for hundreds, so keys share the
    state of a slot; their number follows from ``keys``, about how many are awaited,
    and must be the same when a stream is restarted. Keys are kept as strings.
    """
    kind = dict(stream.dtypes)[key]
    slot = F.pmod(F.xxhash64(key), F.lit(max(LEAST_SLOTS, keys // SLOT_KEYS))).alias("slot")
    slots = stream.select(slot, F.col(key).cast("string").alias("key"), "micros", *(c for c in stream.columns if c not in (key, "micros", "slot", "key")))
    closed = slots.groupBy("slot").transformWithStateInPandas(TimedSessions(gap_seconds), "key string, first long, last long, n long", "Append", "EventTime")
    return closed.withColumn("key", F.col("key").cast(kind))
