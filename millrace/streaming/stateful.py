"""Stateful processors for what no built-in streaming operator does: tables with retractions, transformed values with a time to live,
records that come late."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ranges import seconds


class Latest(StatefulProcessor):
    """A changelog's table: each key's row of the greatest order; emits the old and the new row, so sums can retract."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "value string, ord bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        had = self.state.get() if self.state.exists() else None
        best = None
        for r in rows:
            if best is None or r.ord > best.ord:
                best = r
        if best is not None and (had is None or best.ord > had[1]):
            self.state.update((best.value, best.ord))
            yield Row(key=key[0], old=had[0] if had else None, new=best.value)

    def close(self) -> None:
        pass


class Transform(StatefulProcessor):
    """``step(state, row) -> (state, output)`` for each row of a key, state a JSON text that may expire."""

    def __init__(self, step: Callable[[str | None, Row], tuple[str | None, str]], order: str, ttl_ms: int | None = None):
        self.step, self.order, self.ttl = step, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value string", self.ttl) if self.ttl else handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        state = self.state.get()[0] if self.state.exists() else None
        for r in sorted(rows, key=lambda r: r[self.order]):
            state, out = self.step(state, r)
            yield Row(key=key[0], ord=r[self.order], output=out)
        if state is None:
            self.state.clear()
        else:
            self.state.update((state,))

    def close(self) -> None:
        pass


class Timed(StatefulProcessor):
    """``step`` for each row of a key, and ``tick`` whenever time passes a multiple of an interval; either returns (state, outputs)."""

    def __init__(self, step: Callable[[str | None, Row], tuple[str | None, list[str]]], tick: Callable[[str | None, int], tuple[str | None, list[str]]], every_ms: int, event_time: bool):
        self.step, self.tick, self.every, self.event_time = step, tick, every_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "value string")

    def _now(self, timerValues) -> int:  # noqa: N803
        return timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()

    def _store(self, state: str | None) -> None:
        if state is None:
            self.state.clear()
        else:
            self.state.update((state,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        state = self.state.get()[0] if self.state.exists() else None
        first = None
        for r in sorted(rows, key=lambda r: r.ms):
            first = r.ms if first is None else first
            state, out = self.step(state, r)
            yield from (Row(key=key[0], ms=r.ms, output=x) for x in out)
        self._store(state)
        if first is not None and not list(self.handle.listTimers()):
            base = max(first, self._now(timerValues)) if self.event_time else self._now(timerValues)
            self.handle.registerTimer((base // self.every + 1) * self.every)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        state, out = self.tick(self.state.get()[0] if self.state.exists() else None, at)
        self._store(state)
        yield from (Row(key=key[0], ms=at, output=x) for x in out)
        if state is not None:
            self.handle.registerTimer(at + self.every)

    def close(self) -> None:
        pass


def with_timers(stream: DataFrame, key: str, ts: str, step: Callable, tick: Callable, every: str, event_time: bool = True) -> DataFrame:
    """(key, ms, output) of a processor with punctuations: ``tick(state, ms)`` runs for each key at every multiple of an interval that the
    watermark (or the clock, if not ``event_time``) passes, until it returns no state. ``ts`` needs a watermark for event time."""
    rows = stream.withColumns({"key": F.col(key).cast("string"), "ms": F.unix_millis(F.col(ts).cast("timestamp"))})
    processor = Timed(step, tick, 1000 * seconds(every), event_time)
    return rows.groupBy("key").transformWithState(statefulProcessor=processor, outputStructType="key string, ms bigint, output string", outputMode="Update", timeMode="EventTime" if event_time else "ProcessingTime")


def latest_changes(stream: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, old, new) for each change of a key's latest value."""
    rows = stream.selectExpr(f"cast({key} as string) as key", f"cast({value} as string) as value", f"cast({order} as bigint) as ord")
    return rows.groupBy("key").transformWithState(statefulProcessor=Latest(), outputStructType="key string, old string, new string", outputMode="Update", timeMode="None")


def transform_values(stream: DataFrame, key: str, order: str, step: Callable, ttl_ms: int | None = None) -> DataFrame:
    """(key, ord, output) of a step with state, in ``order`` within each micro-batch."""
    rows = stream.withColumn("key", F.col(key).cast("string"))
    return rows.groupBy("key").transformWithState(statefulProcessor=Transform(step, order, ttl_ms), outputStructType="key string, ord bigint, output string", outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")
