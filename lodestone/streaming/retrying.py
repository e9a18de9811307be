"""Retries and dead letters in a stream: attempts and waits of each event in keyed state, with processing-time timers.

Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass), as every transformWithState does.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import RETRIES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "eventId string, payload string, attempt int, outcome string, at timestamp"
UNITS = {"second": 1.0, "minute": 60.0, "hour": 3600.0}


def seconds(wait: str) -> float:
    number, unit = wait.split()
    return float(number) * UNITS[unit.rstrip("s")]


WAITS = tuple(seconds(w) for w in RETRIES)


class Retry(StatefulProcessor):
    """Of the outcomes of one event: after its n-th failure it comes out again when the n-th wait is over, after one failure more than there are
    waits as a dead letter. A success ends it; so does its dead letter, and a failure after that begins anew."""

    def __init__(self, waits: tuple[float, ...] = WAITS):
        self.waits = waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("event", "attempt int, payload string")

    def _row(self, key, payload, attempt: int, outcome: str, now: int) -> pd.DataFrame:
        return pd.DataFrame({"eventId": [key[0]], "payload": [payload], "attempt": [attempt], "outcome": [outcome], "at": [pd.Timestamp(now, unit="ms")]})

    def _forget(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for batch in rows:
            for ok, payload in zip(batch["ok"].tolist(), batch["payload"].tolist()):
                if ok:
                    self._forget()
                    continue
                attempt = (self.state.get()[0] if self.state.exists() else 0) + 1
                if attempt > len(self.waits):
                    self._forget()
                    yield self._row(key, payload, attempt, "dead", now)
                    continue
                self.state.update((attempt, payload))
                wait = int(self.waits[attempt - 1] * 1000)
                if wait:
                    self.handle.registerTimer(now + wait)
                else:
                    yield self._row(key, payload, attempt, "retry", now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            attempt, payload = self.state.get()
            yield self._row(key, payload, attempt, "retry", timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def retries(outcomes: DataFrame, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """outcomes (eventId, payload, ok), a stream of what became of each event that was worked on: eventId, payload, attempt, outcome (retry or dead), at.
    The events to retry go back to the workers, whose outcomes come in again; dead letters go to their own sink."""
    rows = outcomes.filter("eventId is not null").select("eventId", "payload", F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.groupBy("eventId").transformWithStateInPandas(Retry(waits), OUT, "append", "processingTime")
