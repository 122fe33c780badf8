"""Keyed state on streams: idle timers and failure memory.

State lives in RocksDB under the checkpoint, so it survives lost executors. Idle timers are keyed finely (a job, a video); failure
memory by a fixed number of groups of keys, so that calls of the store do not grow with the keys.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Timers and state with a time to live need the RocksDB state store; a provider that is set stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, ROCKSDB)


class _Idle(StatefulProcessor):
    """Counts a key's events and holds one timer, set anew by each batch that has events of the key."""

    def __init__(self, key: str, order: str, idle_ms: int):
        self.key, self.order, self.idle_ms = key, order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "events long, last long, timer long")

    def _row(self, keys: tuple, events: int, last: int) -> pd.DataFrame:
        return pd.DataFrame({self.key: [keys[0]], "events": [events], "last": [last]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events, last, timer = self.seen.get() if self.seen.exists() else (0, None, None)
        for part in rows:
            events += len(part)
            newest = part[self.order].max()
            last = newest if last is None else max(last, newest)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(timer)
        self.seen.update((int(events), int(last), int(timer)))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events, last, _ = self.seen.get()
        self.seen.clear()
        yield self._row(key, events, last)

    def close(self) -> None: ...


def idle_timeouts(events: DataFrame, key: str, order: str, idle_seconds: float) -> DataFrame:
    """A row (key, events, last) once a key has had no event for ``idle_seconds`` of processing time.

    Every event sets the key's timer anew, however late its own time is; ``events`` and ``last`` (the greatest ``order``, a
    whole number) cover the time since the key was last idle. A key's state goes with its row.
    """
    use_state_store(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, events long, last long"
    return events.select(key, F.col(order).cast("long").alias(order)).groupBy(key).transformWithStateInPandas(_Idle(key, order, int(idle_seconds * 1000)), schema, "append", "processingTime")


def run_live(writer, rows: int, until_idle: bool = False, seconds: float = 1200) -> None:
    """Runs a stream in processing time until it has read ``rows`` rows and, if asked, no key has state left, and stops it.

    A stream with timers has a batch at every trigger, with or without rows, so it never ends by itself. If it ends no batch with
    rows in ``seconds``, that is an error; the whole may take any time.
    """
    query = writer.trigger(processingTime="250 milliseconds").start()
    ends, read, last = time.time() + seconds, 0, -1
    while time.time() < ends and query.exception() is None:
        for p in query.recentProgress:
            if p["batchId"] > last:
                last, read = p["batchId"], read + p["numInputRows"]
                ends = time.time() + seconds if p["numInputRows"] else ends
                left = p["stateOperators"][0]["numRowsTotal"] if p["stateOperators"] else 0
        if read >= rows and last >= 0 and not (until_idle and left):
            query.stop()
            return
        time.sleep(0.1)
    query.stop()
    raise query.exception() or TimeoutError(f"read {read} of {rows} rows in {seconds} seconds")


class _Memory(StatefulProcessor):
    """What is under way for each key of a group, and its last failure. A call of the store takes milliseconds, so the keys of a
    group share one state, in which a key keeps the time it was last touched."""

    def __init__(self, columns: list[str], ttl_us: int, keep_ms: int):
        self.columns, self.ttl_us, self.keep_ms = columns, ttl_us, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "keys string", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        whole = pd.concat([part.set_axis([*self.columns, "__key", "__group"], axis=1) for part in rows]).sort_values(["at_us", "seq"])  # Spark hands on no aliases
        before, now = self.memory.get(), timerValues.getCurrentProcessingTimeInMs()
        known = {k: state for k, *state in (json.loads(before[0]) if before else ()) if state[3] > now - self.keep_ms}
        keep = []
        for k, kind, signature, at in zip(*(whole[c].tolist() for c in ("__key", "kind", "signature", "at_us")), strict=True):
            pending, failed, until, _ = known.get(k, (False, None, 0, now))
            start = kind == "request" and not pending and not (failed == signature and at < until)
            keep.append(start)
            if start:
                pending = True
            elif kind == "failed" and pending:
                pending, failed, until = False, signature, at + self.ttl_us
            elif kind == "ready" and pending:
                pending, failed, until = False, None, 0
            known[k] = pending, failed, until, now
        left = [(k, *state) for k, state in known.items() if state[0] or state[1] is not None]
        if left:
            self.memory.update((json.dumps(left),))
        elif before:
            self.memory.clear()
        yield whole.loc[keep, self.columns]

    def close(self) -> None: ...


def started_requests(events: DataFrame, key: str, ttl_seconds: int, keep_seconds: int | None = None, groups: int = 1024) -> DataFrame:
    """Of events (key, seq, at_us, kind "request", "failed" or "ready", signature) the requests that start work.

    A request starts nothing while one of its key is under way, or within ``ttl_seconds`` of a failure with its signature. A
    failure or result ends what is under way; without that it says nothing. State that is not touched for ``keep_seconds``
    of processing time (at least the time to live; a day more, if not given) is dropped. ``groups`` states hold all keys by
    hash; a group's rows of a batch are folded in memory.
    """
    use_state_store(events.sparkSession)
    keep = max(ttl_seconds, ttl_seconds + 86_400 if keep_seconds is None else keep_seconds)
    group = F.pmod(F.xxhash64(key), F.lit(groups)).alias("__group")
    rows = events.select("*", F.col(key).cast("string").alias("__key"), group)
    return rows.groupBy("__group").transformWithStateInPandas(_Memory(events.columns, ttl_seconds * 1_000_000, keep * 1000), events.schema, "append", "processingTime")
