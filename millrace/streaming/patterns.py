"""Event patterns over streams: each key keeps the events that may still belong to a match."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.cep import Pattern, _bounded, _regex, counted, taken
from ..operators.ranges import seconds


class Matcher(StatefulProcessor):
    """Matches of a pattern, in event order within each key.

    A micro-batch's events take their place by time among those that wait; what comes after a match was put out no longer changes it. A
    match is put out once no later event can lengthen it. What ``within`` has left behind is dropped, so state stays bounded for
    patterns that have it.
    """

    def __init__(self, pattern: Pattern, limit_ms: int | None):
        self.expression, self.width, self.limit = _regex(pattern), len(pattern.steps) + 2, limit_ms
        self.counts = counted(pattern)
        self.grows = any(most is None or most > pattern.steps[k].least for k, most in self.counts)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("events", "events string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        held = json.loads(self.state.get()[0]) if self.state.exists() else []
        held = sorted(held + [[r.ms, r.id, r.symbol] for r in rows])
        text, at, keep = "".join(e[2] for e in held), 0, 0
        while at < len(text):
            if self.limit is None:
                m, shift = self.expression.search(text, at), 0
                if m is None:
                    break
            else:
                first = at // self.width
                m, shift = _bounded(self.expression, text, at, bisect_right(held, held[first][0] + self.limit, key=lambda e: e[0]) * self.width)
                if m is None:
                    at += self.width
                    continue
            a, b = (m.start() + shift) // self.width, (m.end() + shift) // self.width
            if b == len(held) and self.grows:
                break  # a later event may lengthen it
            if b > a:
                yield Row(key=key[0], start_id=held[a][1], end_id=held[b - 1][1], n_events=taken(m, self.counts))
                at = m.end() + shift
            else:
                at = (a + 1) * self.width
            keep = at // self.width
        rest = held[keep:]
        if self.limit is not None and rest:
            rest = [e for e in rest if e[0] >= rest[-1][0] - self.limit]
        self.state.update((json.dumps(rest),))

    def close(self) -> None:
        pass


def match_stream(stream: DataFrame, pattern: Pattern, key: str, ts: str, event: str) -> DataFrame:
    """(key, start_id, end_id, n_events) of a stream's matches; each event belongs to one match at most."""
    symbol = F.concat(F.lit("<"), *(F.coalesce(s.test, F.lit(False)).cast("int").cast("string") for s in pattern.steps), F.lit(">"))
    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ms"), F.col(event).cast("bigint").alias("id"), symbol.alias("symbol"))
    limit = 1_000_000 * seconds(pattern.limit) if pattern.limit else None
    return rows.groupBy("key").transformWithState(statefulProcessor=Matcher(pattern, limit), outputStructType="key string, start_id bigint, end_id bigint, n_events bigint", outputMode="Update", timeMode="None")
