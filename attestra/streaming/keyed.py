"""State by key with timers: token families that are revoked on reuse, and the budget of an audit's questions.

Events wait until the watermark is past them, then count in the order of their
times and numbers, whatever batches they came in; what is later than that is
dropped.  A key has one timer: for its first waiting event, when all that the
watermark has passed count in one go, or, if none waits, for when ``forget`` has
passed since its last one: then its state goes.  A key's state comes and goes
with its rows, so that it costs one call a batch, however many events it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

#: State that needn't fit in memory.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING = "last long, ts array<long>, event_id array<long>, what array<string>"


class InOrder:
    """Events of a key one after the other; what follows from each is up to :meth:`step`.

    An event is (ts in microseconds, event_id, what).  ``memory`` is what a key
    remembers, a tuple of :attr:`shape`; :meth:`step` may change it.
    """

    shape = "n long"
    start: tuple = (0,)
    output: list[str] = []

    def __init__(self, by: str, forget_ms: int):
        self.by, self.forget = by, forget_ms

    def step(self, memory: tuple, event: tuple) -> tuple[tuple, tuple | None]:
        """What the key remembers after an event, and the row that follows from it, if one does."""
        raise NotImplementedError

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at, ids, whats, *memory = state.get if state.exists else (None, [], [], [], *self.start)
        events, mark = list(zip(at, ids, whats, strict=True)), state.getCurrentWatermarkMs()
        forgotten = lambda: last is not None and mark >= last // 1000 + self.forget
        if not events and forgotten():
            last, memory = None, self.start
        for batch in batches:
            at = batch["ts"].astype("datetime64[us]").astype("int64")
            events += [e for e in zip(at.tolist(), batch["event_id"].tolist(), batch["what"].tolist(), strict=True) if e[0] // 1000 >= mark]
        events.sort()
        ready = [e for e in events if e[0] // 1000 < mark]
        events, found = events[len(ready) :], []
        for event in ready:
            memory, row = self.step(tuple(memory), event)
            last = event[0]
            if row is not None:
                found.append(row)
        if events or last is not None and not forgotten():
            state.update((last, *([e[i] for e in events] for i in range(3)), *memory))
            state.setTimeoutTimestamp(max(events[0][0] // 1000 if events else last // 1000 + self.forget, mark) + 1)
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame([(key[0], *row) for row in found], columns=[self.by, *self.output])


class TokenFamilies(InOrder):
    """A token that comes a second time revokes its family from then on; every use says whether it is a replay, and whether the family is revoked."""

    shape, start, output = "used array<string>, revoked boolean", ([], False), ["event_id", "replay", "revoked"]

    def step(self, memory: tuple, event: tuple) -> tuple[tuple, tuple | None]:
        used, revoked = list(memory[0]), memory[1]
        replay = event[2] in used
        if not replay:
            used.append(event[2])
        return (used, revoked or replay), (event[1], replay, revoked or replay)


class AuditBudget(InOrder):
    """Which of an audit's questions are asked: none after ``failures`` failures of asked ones in a row, and none after ``deadline_ms`` since its first."""

    shape, start, output = "began long, failures long, stopped string", (-1, 0, ""), ["event_id", "asked", "reason"]

    def __init__(self, by: str, forget_ms: int, failures: int = 3, deadline_ms: int = 240_000):
        super().__init__(by, forget_ms)
        self.failures, self.deadline = failures, deadline_ms

    def step(self, memory: tuple, event: tuple) -> tuple[tuple, tuple | None]:
        began, failures, stopped = memory
        began = event[0] if began < 0 else began
        stopped = stopped or ("deadline" if event[0] - began > self.deadline * 1000 else "")
        if stopped:
            return (began, failures, stopped), (event[1], False, stopped)
        failures = failures + 1 if event[2] == "failed" else 0
        return (began, failures, "breaker open" if failures >= self.failures else ""), (event[1], True, None)


def _started(events: DataFrame, processor: InOrder, output: str, late: str) -> DataFrame:
    """events: the key (long), ts, event_id, what."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = events.select(processor.by, "ts", "event_id", "what").withWatermark("ts", late)
    return timed.groupBy(processor.by).applyInPandasWithState(processor.__call__, f"{processor.by} long, {output}", f"{_WAITING}, {processor.shape}", "append", "EventTimeTimeout")


def token_families(events: DataFrame, by: str = "family", late: str = "10 minutes", forget_ms: int = 30 * 86_400_000) -> DataFrame:
    """by, event_id, replay, revoked of every use (``what`` is the token); families are forgotten once no token of theirs can be valid."""
    return _started(events, TokenFamilies(by, forget_ms), "event_id long, replay boolean, revoked boolean", late)


def audit_budget(events: DataFrame, by: str = "audit_id", late: str = "1 minute", failures: int = 3, deadline_ms: int = 240_000) -> DataFrame:
    """by, event_id, asked, reason of every question (``what`` is "failed" or "answered", had it been asked)."""
    return _started(events, AuditBudget(by, 2 * deadline_ms, failures, deadline_ms), "event_id long, asked boolean, reason string", late)
