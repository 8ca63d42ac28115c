"""Stages of runs as a stream with state and timers: numbered events, elapsed times, heartbeats, and an end.

Each run has a state of its own: its last sequence number, when it was last heard of, and when its open stages began.  Its
events go out numbered, in the order of time within a batch.  A run that is silent for ``idle`` gets a heartbeat, and again,
``most`` times; then it is done, and its state goes (a later event begins it anew, its numbers go on from one).  Silence is
measured in event time: between two events when the later one is there, after the last one by a timer that the watermark
sets off.  So results do not depend on how events fall into batches, as long as a run's come in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUT = "seq long, kind string, stage string, at long, elapsed_ms long"


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Queries that start here keep their state in RocksDB, which timers need; the session's setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Lifecycle(StatefulProcessor):
    """``kind`` of an event is started, finished, failed, or what it likes; ``at`` is in milliseconds."""

    def __init__(self, run: str, idle_ms: int, most: int):
        self.run, self.idle, self.most = run, idle_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "seq long, last long, beats int")
        self.open = handle.getMapState("open", "stage string", "began long")

    def close(self) -> None:
        pass

    def _beats(self, seq: int, last: int, beats: int, now: int) -> tuple[list[tuple], int, int, bool]:
        """Heartbeats due before ``now``, and whether the run is done by then."""
        due = max(0, now - last) // self.idle
        out = []
        while beats < min(due, self.most):
            beats, seq = beats + 1, seq + 1
            out.append((seq, "heartbeat", None, last + beats * self.idle, None))
        done = due > self.most
        if done:
            out.append((seq + 1, "done", None, last + (self.most + 1) * self.idle, None))
        return out, seq, beats, done

    def _forget(self) -> None:
        self.known.clear()
        self.open.clear()

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def _frame(self, key: Any, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            frame = pd.DataFrame(rows, columns=["seq", "kind", "stage", "at", "elapsed_ms"]).astype({"elapsed_ms": "Int64"})
            frame.insert(0, self.run, key[0])
            yield frame

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        seq, last, beats = self.known.get() if self.known.exists() else (0, None, 0)
        # Open stages are read once and written once a batch: each look at the state is a call to the engine.
        before = {k[0]: int(v[0]) for k, v in self.open.iterator()} if last is not None else {}
        opened = dict(before)
        out: list[tuple] = []
        for kind, stage, at in zip(events["kind"], events["stage"], events["at"].astype(int).tolist(), strict=True):
            if last is not None and at > last:
                found, seq, beats, done = self._beats(seq, last, beats, at)
                out += found
                if done:
                    opened.clear()
                    seq = 0
            elapsed = None
            if kind == "started":
                opened[stage] = at
            elif kind in ("finished", "failed") and stage in opened:
                elapsed = at - opened.pop(stage)
            seq += 1
            out.append((seq, kind, stage, at, elapsed))
            if last is None or at >= last:
                last, beats = at, 0
        for stage in before.keys() - opened.keys():
            self.open.removeKey((stage,))
        for stage, began in opened.items():
            if before.get(stage) != began:
                self.open.updateValue((stage,), (began,))
        self.known.update((seq, last, beats))
        self._timer(last + (beats + 1) * self.idle)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.known.exists():
            return
        seq, last, beats = self.known.get()
        out, seq, beats, done = self._beats(seq, last, beats, max(int(timerValues.getCurrentWatermarkInMs()), int(expiredTimerInfo.getExpiryTimeInMs())))
        if done:
            self._forget()
        else:
            self.known.update((seq, last, beats))
            self.handle.registerTimer(last + (beats + 1) * self.idle)
        yield from self._frame(key, out)


def lifecycle(events: DataFrame, run: str, idle_ms: int, most: int = 3, late: str = "10 minutes") -> DataFrame:
    """(run, seq, kind, stage, at, elapsed_ms) of a stream (run, id, kind, stage, ts).  Start it in ``state_in_rocksdb``."""
    rows = events.withWatermark("ts", late).selectExpr(f"`{run}`", "id", "kind", "stage", "ts", "unix_millis(ts) AS at")
    kind = events.schema[run].dataType.simpleString()
    return rows.groupBy(run).transformWithStateInPandas(Lifecycle(run, idle_ms, most), f"{run} {kind}, {OUT}", "Append", "EventTime")


class Progress(StreamingQueryListener):
    """What queries of a session have done: batches and rows read, by query id, and how each has ended."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = self.batches[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows
        self.batches[key] = self.batches.get(key, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception
