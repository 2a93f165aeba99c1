"""Live outages: a feed that falls silent opens one by a timer, its next report closes it.

The state of a feed is its last report and the outage that is open. A processing-time timer
runs out when the feed should have spoken; as no message is needed for that, an outage is
known while it lasts. All state and timers are in the state store, so a query that is
started again from its checkpoint goes on where it stopped. What was missed while nothing ran is
found by the times of the reports themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SILENCE_S, FORGET_DAYS = 90.0, 30
REASON = "valid report timeout"
LEDGER = "key string, opened_us long, closed_us long, reason string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FeedWatch(StatefulProcessor):
    """Emits (key, opened_us, null) when a feed falls silent and (key, opened_us, closed_us) when it speaks again.

    An outage opens at the last report's time and the allowed silence after it. Reports that arrive late, before
    the last one known, neither open nor close anything. A feed not heard for forget_days is forgotten.
    """

    def __init__(self, silence_s: float = SILENCE_S, forget_days: float = FORGET_DAYS):
        self.silence_us, self.forget_ms = int(silence_s * 1e6), int(forget_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long", self.forget_ms)
        self.open = handle.getValueState("open", "opened_us long", self.forget_ms)

    def _rows(self, key, rows: list[tuple[int, int | None]]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(rows), "opened_us": pd.array([r[0] for r in rows], "Int64"), "closed_us": pd.array([r[1] for r in rows], "Int64"), "reason": [REASON] * len(rows)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = np.unique(np.concatenate([r["us"].dropna().to_numpy(np.int64) for r in rows]))
        last = int(self.last.get()[0]) if self.last.exists() else None
        times = times if last is None else times[times > last]
        if not len(times):
            return
        found = []
        if self.open.exists():
            opened = int(self.open.get()[0])
            found.append((opened, max(opened, int(times[0]))))
            self.open.clear()
            times_from = times
        else:
            times_from = times if last is None else np.append(last, times)
        silent = np.flatnonzero(np.diff(times_from) > self.silence_us)
        found += [(int(times_from[k]) + self.silence_us, int(times_from[k + 1])) for k in silent]
        self.last.update((int(times[-1]),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_us // 1000)
        if found:
            yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists() or not self.last.exists():
            return
        opened = int(self.last.get()[0]) + self.silence_us
        self.open.update((opened,))
        yield self._rows(key, [(opened, None)])

    def close(self) -> None:
        pass


def watch(reports: DataFrame, silence_s: float = SILENCE_S, forget_days: float = FORGET_DAYS) -> DataFrame:
    """A stream of (key, opened_us, closed_us, reason) of a stream of reports (key, us).

    Needs the RocksDB state store: with_timers(spark) sets it for the session.
    """
    rows = reports.where("key IS NOT NULL AND us IS NOT NULL").select("key", "us")
    return rows.groupBy("key").transformWithStateInPandas(FeedWatch(silence_s, forget_days), LEDGER, "append", "ProcessingTime")


def with_timers(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return spark


def ledger(rows: DataFrame) -> DataFrame:
    """The outage ledger of all that watch() has said: one row for each outage, closed where a closing row came."""
    return rows.groupBy("key", "opened_us").agg(F.min("closed_us").alias("closed_us"), F.first("reason").alias("reason"))
