"""Event patterns per key: steps with conditions and contiguity, compiled to window expressions, or to a regular expression over symbols.

A match attempt starts at every event that satisfies the first step. ``next`` means the very next event of the key, ``followed_by`` the
first later event that fits, ``followed_by_any`` every later one; ``not_next`` and ``not_followed_by`` forbid. ``within`` counts from the
first event, its end included. A step that is repeated takes neighbouring events, but after ``followed_by`` others may stand between
them unless the step is ``consecutive``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .joins import interval_join
from .ranges import seconds


@dataclass(frozen=True)
class Step:
    name: str
    test: Column
    how: str = "begin"
    least: int = 1
    most: int | None = 1
    greedy: bool = True
    strict: bool = False


@dataclass(frozen=True)
class Pattern:
    steps: tuple[Step, ...] = field(default_factory=tuple)
    limit: str | None = None

    @staticmethod
    def begin(name: str, test: Column) -> Pattern:
        return Pattern((Step(name, test),))

    def _then(self, name: str, test: Column, how: str) -> Pattern:
        return replace(self, steps=(*self.steps, Step(name, test, how)))

    def next(self, name: str, test: Column) -> Pattern:
        return self._then(name, test, "next")

    def followed_by(self, name: str, test: Column) -> Pattern:
        return self._then(name, test, "followed_by")

    def followed_by_any(self, name: str, test: Column) -> Pattern:
        return self._then(name, test, "followed_by_any")

    def not_next(self, name: str, test: Column) -> Pattern:
        return self._then(name, test, "not_next")

    def not_followed_by(self, name: str, test: Column) -> Pattern:
        return self._then(name, test, "not_followed_by")

    def where(self, test: Column) -> Pattern:
        return self._last(test=self.steps[-1].test & test)

    def or_(self, test: Column) -> Pattern:
        return self._last(test=self.steps[-1].test | test)

    def times(self, least: int, most: int | None = None) -> Pattern:
        return self._last(least=least, most=least if most is None else most)

    def one_or_more(self) -> Pattern:
        return self._last(least=1, most=None)

    def zero_or_more(self) -> Pattern:
        return self._last(least=0, most=None)

    def optional(self) -> Pattern:
        return self._last(least=0)

    def consecutive(self) -> Pattern:
        """The events that the last step takes stand side by side."""
        return self._last(strict=True)

    def subtype(self, kind: Column | str, name: str) -> Pattern:
        """The last step takes events whose ``kind`` is ``name`` only."""
        return self.where((F.col(kind) if isinstance(kind, str) else kind) == name)

    def reluctant(self) -> Pattern:
        return self._last(greedy=False)

    def within(self, interval: str) -> Pattern:
        return replace(self, limit=interval)

    def _last(self, **changes) -> Pattern:
        return replace(self, steps=(*self.steps[:-1], replace(self.steps[-1], **changes)))


def match(df: DataFrame, pattern: Pattern, keys: list[str], ts: str, order: list[str], event: str) -> DataFrame:
    """Matches of a pattern whose steps take one event each: keys, and for each positive step its event id and time.

    Columns <step>_id and <step>_ts; steps with ``not_`` leave no columns. One sort within the keys serves all steps; only
    ``followed_by_any`` joins, as it has several results for an event.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    first = pattern.steps[0]
    info = F.struct(F.col(event).alias("id"), F.col(ts).alias("t"))
    rows = df
    for k, step in enumerate(pattern.steps):
        rows = rows.withColumn(f"__is{k}", F.coalesce(step.test, F.lit(False)))
    # the event of step k, seen from an event taken as step k - 1, worked out backwards so that every row knows the rest of its match
    ok, done, forbidden = F.lit(True), [], []
    for k in range(len(pattern.steps) - 1, 0, -1):
        step = pattern.steps[k]
        here = F.col(f"__is{k}")
        if step.how in ("next", "followed_by"):
            later = [F.col(c).alias(c) for c in (*done, *forbidden)]
            packed = F.when(here, F.struct(info.alias("e"), ok.alias("ok"), *later))
            reach = F.lead(F.struct(here.alias("h"), F.struct(info.alias("e"), ok.alias("ok"), *later).alias("s"))).over(w) if step.how == "next" else F.first(packed, True).over(ahead)
            name = f"__at{k}"
            if step.how == "next":
                rows = rows.withColumn(f"__n{k}", reach).withColumn(name, F.when(F.col(f"__n{k}")["h"], F.col(f"__n{k}")["s"]))
            else:
                rows = rows.withColumn(name, reach)
            ok = F.coalesce(F.col(name)["ok"], F.lit(False))
            for c in (*done, *forbidden):
                rows = rows.withColumn(c, F.col(name)[c])
            rows = rows.withColumn(f"__e{k}", F.col(name)["e"])
            done.append(f"__e{k}")
        elif step.how == "not_next":
            ok = ok & ~F.coalesce(F.lead(here).over(w), F.lit(False))
        elif step.how == "not_followed_by":
            # when the first forbidden event comes after the step before: the first event of the match tells whether that is too soon
            rows = rows.withColumn(f"__f{k}", F.first(F.when(here, F.col(ts)), True).over(ahead))
            forbidden.append(f"__f{k}")
        else:
            raise ValueError(f"{step.how} within a chain: use match_any")
        rows = rows.withColumn(f"__ok{k}", ok)
        ok = F.col(f"__ok{k}")
    out = rows.where(F.col("__is0") & ok)
    names = sorted(done, key=lambda c: int(c[3:]))
    end = F.col(ts) + F.expr(f"interval {pattern.limit}") if pattern.limit else None
    if pattern.limit and names:
        out = out.where(F.col(names[-1])["t"] <= end)
    for c in forbidden:
        out = out.where(F.col(c).isNull() if end is None else F.coalesce(F.col(c) > end, F.lit(True)))
    cols = [F.col(event).alias(f"{first.name}_id"), F.col(ts).alias(f"{first.name}_ts")]
    for c in names:
        name = pattern.steps[int(c[3:])].name
        cols += [F.col(c)["id"].alias(f"{name}_id"), F.col(c)["t"].alias(f"{name}_ts")]
    return out.select(*keys, *cols)


def match_any(df: DataFrame, first: Column, second: Column, keys: list[str], ts: str, event: str, within: str) -> DataFrame:
    """Every pair of a first event and a later second event of its key within an interval: first_id, second_id."""
    a = df.where(first).select(*keys, F.col(event).alias("first_id"), F.col(ts).alias("__a"))
    b = df.where(second).select(*keys, F.col(event).alias("second_id"), F.col(ts).alias("__b"))
    later = (F.col("__b") > F.col("__a")) | ((F.col("__b") == F.col("__a")) & (F.col("second_id") > F.col("first_id")))
    return interval_join(a, b, keys, "__a", "__b", "0 seconds", within).where(later).drop("__a", "__b")


def _regex(pattern: Pattern) -> re.Pattern:
    """Events in angle brackets can be taken; what is forbidden is also seen in events in braces, which lie beyond the time limit.

    ``followed_by`` passes over events that don't fit only, so an event is taken in one way and a search needs no second thoughts.
    """
    parts = []
    for k, s in enumerate(pattern.steps):
        symbol = f"<[01]{{{k}}}1[01]{{{len(pattern.steps) - k - 1}}}>"
        if s.how in ("not_next", "not_followed_by"):
            anything = "(?:[<{][01]+[>}])*?" if s.how == "not_followed_by" else ""
            parts.append(f"(?!{anything}{symbol.replace('<', '[<{]').replace('>', '[>}]')})")
            continue
        skip = {"followed_by": f"(?:<[01]{{{k}}}0[01]*>)*", "followed_by_any": "(?:<[01]+>)*?"}.get(s.how, "")
        most, lazy = "" if s.most is None else s.most, "" if s.greedy else "?"
        count = f"{{{s.least},{most}}}{lazy}"
        if (s.least, s.most) == (1, 1):
            parts.append(f"{skip}(?P<s{k}>{symbol})")
        elif s.strict and skip:
            run = f"{skip}(?:{symbol}){{{max(1, s.least)},{most}}}{lazy}"
            parts.append(f"(?P<s{k}>(?:{run}){'' if s.least else '?' + lazy})")
        else:
            parts.append(f"(?P<s{k}>(?:{skip}{symbol}){count})")
    return re.compile("".join(parts))


def _bounded(expression: re.Pattern, text: str, at: int, end: int) -> tuple[re.Match | None, int]:
    """The match that starts at ``at`` and takes nothing from ``end`` on, and how far its places lie from those in ``text``."""
    if "(?!" not in expression.pattern:
        return expression.match(text, at, end), 0
    return expression.match(text[at:end] + text[end:].translate({60: "{", 62: "}"})), at


def counted(pattern: Pattern) -> tuple[tuple[int, int | None], ...]:
    """The steps that take events, each with how many it takes at most."""
    return tuple((k, s.most) for k, s in enumerate(pattern.steps) if not s.how.startswith("not_"))


def taken(m: re.Match, counts: tuple[tuple[int, int | None], ...]) -> int:
    """How many events a match took: those between them that no step took don't count."""
    found = [(len(re.findall(rf"<[01]{{{k}}}1", m[f"s{k}"] or "")), most) for k, most in counts]
    return sum(n if most is None else min(n, most) for n, most in found)


def match_quantified(df: DataFrame, pattern: Pattern, keys: list[str], ts: str, order: list[str], event: str, after: str | tuple[str, str] = "past_last") -> DataFrame:
    """Matches of patterns with quantifiers: keys, start_id, end_id, n_events.

    Each event becomes a symbol that tells which steps it satisfies, a key's events a text, the pattern a regular expression over it.
    ``after`` a match the search goes on past its last event (past_last), at the next event (to_next, or no_skip: one match for each first
    event), or at the first or last event that a step took (("to_first", step), ("to_last", step)). Keys are dealt over tasks and
    sorted by Spark; a task streams through them and holds one key's symbols, ids and times.
    """
    width = len(pattern.steps) + 2
    expression = _regex(pattern)
    limit = 1_000_000 * seconds(pattern.limit) if pattern.limit else None
    names, counts = {s.name: k for k, s in enumerate(pattern.steps)}, counted(pattern)

    def resume(m: re.Match, a: int, shift: int) -> int:
        if after == "past_last":
            return m.end() + shift
        if isinstance(after, tuple):
            k = names[after[1]]
            begin, end = m.span(f"s{k}")
            begin += fit.start() if (fit := re.search(rf"<[01]{{{k}}}1", m[f"s{k}"] or "")) else 0
            place = (begin if after[0] == "to_first" else end - width) + shift
            return max(place, (a + 1) * width)
        return (a + 1) * width

    symbol = F.concat(F.lit("<"), *(F.coalesce(s.test, F.lit(False)).cast("int").cast("string") for s in pattern.steps), F.lit(">"))
    rows = df.select(*keys, F.col(event).cast("bigint").alias("__id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"), symbol.alias("__s"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)])
    laid = rows.repartition(*keys).sortWithinPartitions(*keys, *(f"__o{k}" for k in range(len(order)))).select(*keys, "__id", "__t", "__s")

    def find(text: str, ids: np.ndarray, times: np.ndarray):
        """(first place, id of the first event, of the last, events taken) of one key's matches."""
        at = 0
        far = np.searchsorted(times, times + limit, "right") if limit is not None else None
        while at < len(text):
            m, shift = (expression.search(text, at), 0) if limit is None else _bounded(expression, text, at, int(far[at // width]) * width)
            if m is None and limit is None:
                break
            a, b = ((m.start() + shift) // width, (m.end() + shift) // width) if m else (at // width,) * 2
            if b > a:
                yield a, ids[a], ids[b - 1], taken(m, counts)
                at = resume(m, a, shift)
            else:
                at = (a + 1) * width

    def run(batches):
        open_: list[pa.Table] = []  # the batches of the key that may go on
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            edges = _edges(table, keys)
            if open_ and _differ(open_[-1].slice(len(open_[-1]) - 1).select(keys), table.slice(0, 1).select(keys)):
                yield from searched(pa.concat_tables(open_), [0])
                open_ = []
            if len(edges) > 1:
                whole = pa.concat_tables([*open_, table.slice(0, edges[-1])])
                grown = len(whole) - edges[-1]
                yield from searched(whole, [0, *(x + grown for x in edges[1:-1])])
                open_ = []
            open_.append(table.slice(edges[-1]))
        if open_:
            yield from searched(pa.concat_tables(open_), [0])

    def searched(table: pa.Table, starts: list[int]):
        table = table.combine_chunks()
        ids, times = (table.column(c).to_numpy() for c in ("__id", "__t"))
        symbols, out = table.column("__s").to_pylist(), []
        for x, y in zip(starts, [*starts[1:], len(table)], strict=True):
            out += [(x, *m[1:]) for m in find("".join(symbols[x:y]), ids[x:y], times[x:y])]
        if out:
            which, *found = zip(*out, strict=True)
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.select(keys).take(pa.array(which)).columns]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in found)], names=[*keys, "start_id", "end_id", "n_events"])

    schema = df.select(*keys).schema
    for name in ("start_id", "end_id", "n_events"):
        schema = schema.add(name, LongType())
    return laid.mapInArrow(run, schema)


def _differ(one: pa.Table, other: pa.Table) -> bool:
    return one.to_pylist() != other.to_pylist()


def _edges(table: pa.Table, keys: list[str]) -> list[int]:
    """Where the rows of each key begin; rows of a key stand together."""
    new = np.zeros(max(0, len(table) - 1), bool)
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode()
        codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist()]
