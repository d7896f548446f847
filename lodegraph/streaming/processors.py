"""Stateful streams with timers: pulses with a quiet time and a hold after them, runs that close."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PULSES = "owner long, what string, at long, event_id long, events long"
RUNS = "run string, what string, status string, event_id long, events long"


def with_state_store(spark: SparkSession) -> None:
    """Processors with timers need the store that keeps its state on disk; a session's own choice stays."""
    if "RocksDB" not in (spark.conf.get(STORE, None) or ""):
        spark.conf.set(STORE, ROCKS)


class Pulses(StatefulProcessor):
    """One pulse after each burst of an owner's events, ``quiet`` ms after the last of them; events within ``hold``
    ms of a pulse are dropped.  State is a pending pulse or the end of a hold; it goes when that is over."""

    def __init__(self, quiet: int, hold: int):
        self.quiet, self.hold = quiet, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pulse", "fire long, first long, events long, until long")

    def _fired(self, fire: int, first: int, events: int, rows: list[tuple]) -> tuple[int, int, int, int]:
        rows.append(("pulse", fire, first, events))
        return -1, -1, 0, fire + self.hold

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fire, first, events, until = self.state.get() if self.state.exists() else (-1, -1, 0, -1)
        before, out = fire, []
        own = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        for at, event in zip(own["at"].tolist(), own["event_id"].tolist(), strict=True):
            if fire >= 0 and at >= fire:
                fire, first, events, until = self._fired(fire, first, events, out)
            if at < until:
                out.append(("dropped", at, event, 1))
                continue
            first, events, fire = (event if fire < 0 else first), events + 1, at + self.quiet
        if before >= 0:
            self.handle.deleteTimer(before)
        self.state.update((fire, first, events, until))
        self.handle.registerTimer(fire if fire >= 0 else until)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if self.state.exists():
            fire, first, events, until = self.state.get()
            due = expiredTimerInfo.getExpiryTimeInMs()
            if 0 <= fire <= due:
                fire, first, events, until = self._fired(fire, first, events, out)
                self.state.update((fire, first, events, until))
                self.handle.registerTimer(until)
            elif fire < 0 and until <= due:
                self.state.clear()
        yield self._frame(key, out)

    @staticmethod
    def _frame(key: Any, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["what", "at", "event_id", "events"])
        out.insert(0, "owner", key[0])
        return out

    def close(self) -> None:
        pass


def pulses(events: DataFrame, owner: str, ts: str, quiet: int, hold: int | None = None, late: str = "1 day") -> DataFrame:
    """(owner, what, at, event_id, events) of a stream: a row ``pulse`` with its first event and their number once a burst
    has been quiet for ``quiet`` ms, a row ``dropped`` for each event within ``hold`` ms after a pulse (400 or
    quiet + 150, the larger, by default).  Times are those of the events; events of one trigger are taken in
    their order, and one that comes in a later trigger than a pulse it precedes counts as it comes."""
    with_state_store(events.sparkSession)
    hold = max(400, quiet + 150) if hold is None else hold
    own = events.where(F.col(owner).isNotNull() & F.col(ts).isNotNull()).select(F.col(owner).cast("long").alias("owner"), "event_id", F.col(ts).alias("ts"), F.unix_millis(ts).alias("at"))
    return own.withWatermark("ts", late).groupBy("owner").transformWithStateInPandas(Pulses(quiet, hold), PULSES, "Append", "EventTime")


class Runs(StatefulProcessor):
    """The events of a run, each once, until one closes it; what comes later is rejected.  The ids seen go when
    the run closes, all state ``keep`` ms after its last event."""

    def __init__(self, closing: dict[str, str], keep: int):
        self.closing, self.keep = closing, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "event_id long", "n long")
        self.state = handle.getValueState("run", "status string, events long, expires long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status, events, expires = self.state.get() if self.state.exists() else ("live", 0, -1)
        out, fresh = [], set()
        own = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        for event, kind in zip(own["event_id"].tolist(), own["kind"].tolist(), strict=True):
            if status != "live":
                out.append(("rejected", status, event, 0))
            elif kind in self.closing:
                status = self.closing[kind]
                out.append(("closed", status, event, events))
            elif event not in fresh and not self.seen.containsKey((event,)):
                fresh.add(event)
                events += 1
        if status != "live":
            self.seen.clear()
        else:
            for event in fresh:
                self.seen.updateValue((event,), (1,))
        if expires >= 0:
            self.handle.deleteTimer(expires)
        expires = max(expires, int(own["at"].max()) + self.keep)
        self.handle.registerTimer(expires)
        self.state.update((status, events, expires))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.state.clear()
        yield self._frame(key, [])

    @staticmethod
    def _frame(key: Any, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["what", "status", "event_id", "events"])
        out.insert(0, "run", key[0])
        return out

    def close(self) -> None:
        pass


def runs(events: DataFrame, closing: dict[str, str], keep: int = 30 * 86_400_000, late: str = "1 day") -> DataFrame:
    """(run, what, status, event_id, events) of a stream ``events(run, event_id, ts, kind)``: a row ``closed`` with the number
    of events, repeats left out, when an event of a kind in ``closing`` ends a live run with its status, and a row
    ``rejected`` for every event after that."""
    with_state_store(events.sparkSession)
    own = events.select("run", "event_id", "ts", F.unix_millis("ts").alias("at"), "kind").where("run is not null and ts is not null")
    return own.withWatermark("ts", late).groupBy("run").transformWithStateInPandas(Runs(closing, keep), RUNS, "Append", "EventTime")
