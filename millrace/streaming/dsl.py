"""Keyed streams and tables over DataFrames, batch or streaming: every call adds expressions to one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins, tables, windows


class Stream:
    """Records with a key, an event time and any other columns."""

    def __init__(self, df: DataFrame, key: str = "key", ts: str = "ts"):
        self.df, self.key, self.ts = df, key, ts

    def _with(self, df: DataFrame, key: str | None = None) -> Stream:
        return Stream(df, key or self.key, self.ts)

    def filter(self, test: Column) -> Stream:
        return self._with(self.df.where(test))

    def filter_not(self, test: Column) -> Stream:
        return self._with(self.df.where(~test))

    def map_values(self, **columns: Column) -> Stream:
        return self._with(self.df.withColumns(columns))

    def map(self, *columns: Column | str) -> Stream:
        return self._with(self.df.select(*columns))

    def flat_map_values(self, items: Column, name: str) -> Stream:
        return self._with(self.df.withColumn(name, F.explode(items)))

    def select_key(self, key: Column) -> Stream:
        return self._with(self.df.withColumn(self.key, key))

    def peek(self, name: str, *metrics: Column) -> Stream:
        """Named metrics of what passes, without touching it."""
        return self._with(self.df.observe(name, *metrics))

    def merge(self, other: Stream) -> Stream:
        return self._with(self.df.unionByName(other.df, allowMissingColumns=True))

    def branch(self, *tests: Column) -> list[Stream]:
        return [self._with(self.df.where(t)) for t in tests]

    def through(self, step: Callable[[DataFrame], DataFrame]) -> Stream:
        return self._with(step(self.df))

    def repartition(self, partitions: int | None = None) -> Stream:
        return self._with(self.df.repartition(partitions, self.key) if partitions else self.df.repartition(self.key))

    def with_watermark(self, delay: str) -> Stream:
        return self._with(windows.watermarked(self.df, self.ts, delay))

    def group_by_key(self) -> Grouped:
        return Grouped(self, [self.key])

    def group_by(self, **keys: Column) -> Grouped:
        return Grouped(self._with(self.df.withColumns(keys)), list(keys))

    def join(self, other: Stream, before: str, after: str | None = None, how: str = "inner") -> Stream:
        """Windowed join with a stream of the same key: the other's time from ``before`` earlier to ``after`` later."""
        return self._with(joins.interval_join(self.df, other.df, [self.key], self.ts, other.ts, before, after or before, how))

    def join_table(self, table: Table, how: str = "inner", small: bool = False) -> Stream:
        return self._with(joins.lookup(self.df, table.df, [self.key], how, small))

    def to_table(self, order: list[str] | None = None, deleted: Column | None = None) -> Table:
        return Table(tables.latest(self.df, [self.key], order or [self.ts], deleted), self.key)


class Grouped:
    def __init__(self, stream: Stream, keys: list[str]):
        self.stream, self.keys = stream, keys

    def aggregate(self, *aggregates: Column) -> DataFrame:
        return self.stream.df.groupBy(*self.keys).agg(*aggregates)

    def count(self, name: str = "count") -> DataFrame:
        return self.aggregate(F.count(F.lit(1)).alias(name))

    def tumbling(self, size: str, *aggregates: Column) -> DataFrame:
        return windows.tumble(self.stream.df, self.stream.ts, size, self.keys, *aggregates)

    def hopping(self, size: str, advance: str, *aggregates: Column) -> DataFrame:
        return windows.hop(self.stream.df, self.stream.ts, size, advance, self.keys, *aggregates)

    def session(self, gap: str, *aggregates: Column) -> DataFrame:
        """Sessions that end with their last event."""
        return windows.sessions(self.stream.df, self.stream.ts, gap, self.keys, *aggregates, with_gap=False)


class Table:
    """The latest row of each key."""

    def __init__(self, df: DataFrame, key: str = "key"):
        self.df, self.key = df, key

    def filter(self, test: Column) -> Table:
        return Table(self.df.where(test), self.key)

    def map_values(self, **columns: Column) -> Table:
        return Table(self.df.withColumns(columns), self.key)

    def join(self, other: Table, how: str = "inner") -> Table:
        return Table(self.df.join(other.df, self.key, how), self.key)

    def join_reference(self, other: Table, reference: str, how: str = "inner") -> Table:
        return Table(joins.foreign_key_join(self.df, other.df, reference, other.key, how), self.key)

    def group_by(self, *keys: str) -> Callable[..., DataFrame]:
        return lambda *aggregates: self.df.groupBy(*keys).agg(*aggregates)

    def to_stream(self) -> DataFrame:
        return self.df
