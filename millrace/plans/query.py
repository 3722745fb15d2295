"""Queries over topics and stores: a small fluent front, and interactive reads of a store's table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


class Query:
    """where / select / order_by / skip / take over a table; nothing runs until rows are asked for."""

    def __init__(self, df: DataFrame, skipped: int = 0, taken: int | None = None):
        self.df, self._skip, self._take = df, skipped, taken

    def _with(self, df: DataFrame) -> Query:
        return Query(df, self._skip, self._take)

    def where(self, test: Column) -> Query:
        return self._with(self.df.where(test))

    def select(self, *columns: Column | str) -> Query:
        return self._with(self.df.select(*columns))

    def order_by(self, *columns: Column | str) -> Query:
        return self._with(self.df.orderBy(*columns))

    def group_by(self, *keys: Column | str) -> Callable[..., Query]:
        return lambda *aggregates: self._with(self.df.groupBy(*keys).agg(*aggregates))

    def skip(self, n: int) -> Query:
        return Query(self.df, self._skip + n, self._take)

    def take(self, n: int) -> Query:
        return Query(self.df, self._skip, n if self._take is None else min(n, self._take))

    def to_df(self) -> DataFrame:
        out = self.df.offset(self._skip) if self._skip else self.df
        return out if self._take is None else out.limit(self._take)

    def first(self) -> Row:
        if (row := self.first_or_none()) is None:
            raise LookupError("no rows")
        return row

    def first_or_none(self) -> Row | None:
        return self.to_df().first()

    def single(self) -> Row:
        rows = self.to_df().take(2)
        if len(rows) != 1:
            raise LookupError(f"{'no' if not rows else 'several'} rows")
        return rows[0]

    def any(self, test: Column | None = None) -> bool:
        return not (self.df if test is None else self.df.where(test)).isEmpty()

    def count(self) -> int:
        return self.to_df().count()


class Store:
    """Reads of a keyed table: get, range, page, prefix, all, count."""

    def __init__(self, table: DataFrame, key: str = "key"):
        self.table, self.key = table, key

    def get(self, key) -> Row | None:
        return self.table.where(F.col(self.key) == F.lit(key)).first()

    def range(self, low=None, high=None, reverse: bool = False) -> DataFrame:
        out = self.table
        if low is not None:
            out = out.where(F.col(self.key) >= F.lit(low))
        if high is not None:
            out = out.where(F.col(self.key) <= F.lit(high))
        return out.orderBy(F.col(self.key).desc() if reverse else F.col(self.key).asc())

    def prefix(self, start: str) -> DataFrame:
        return self.table.where(F.col(self.key).startswith(start)).orderBy(self.key)

    def page(self, offset: int, limit: int) -> DataFrame:
        return self.table.orderBy(self.key).offset(offset).limit(limit)

    def all(self) -> DataFrame:
        return self.range()

    def count(self) -> int:
        return self.table.count()

    def put_all(self, rows: DataFrame) -> Store:
        """The store after puts; a row whose other columns are all null deletes its key."""
        rest = [c for c in self.table.columns if c != self.key]
        kept = rows.where(F.coalesce(*(F.when(F.col(c).isNotNull(), 1) for c in rest)).isNotNull())
        return Store(self.table.join(rows.select(self.key), self.key, "left_anti").unionByName(kept), self.key)

    def put_if_absent(self, rows: DataFrame) -> Store:
        return Store(self.table.unionByName(rows.join(self.table.select(self.key), self.key, "left_anti")), self.key)

    def delete(self, *keys) -> Store:
        return Store(self.table.where(~F.col(self.key).isin(*keys)), self.key)


class WindowStore:
    """A table of values by key and window start: put, fetch, fetch_all, remove."""

    def __init__(self, table: DataFrame, key: str = "key", start: str = "window_start"):
        self.table, self.key, self.start = table, key, start

    def put(self, rows: DataFrame) -> WindowStore:
        """The store after puts: a row takes the place of the one of its key and window."""
        kept = self.table.join(rows.select(self.key, self.start), [self.key, self.start], "left_anti")
        return WindowStore(kept.unionByName(rows), self.key, self.start)

    def fetch(self, key, since=None, until=None) -> DataFrame:
        """A key's windows that start in [since, until], in order."""
        return self.fetch_all(since, until).where(F.col(self.key) == F.lit(key)).orderBy(self.start)

    def fetch_all(self, since=None, until=None) -> DataFrame:
        out = self.table if since is None else self.table.where(F.col(self.start) >= F.lit(since))
        return out if until is None else out.where(F.col(self.start) <= F.lit(until))

    def expired(self, retention: str) -> WindowStore:
        """The store without windows that start longer than ``retention`` before the latest one."""
        top = self.table.agg(F.max(self.start).alias("__top"))
        kept = self.table.join(F.broadcast(top), F.col(self.start) >= F.col("__top") - F.expr(f"interval {retention}")).drop("__top")
        return WindowStore(kept, self.key, self.start)


class SessionStore:
    """A table of sessions by key, start and end: put, find_sessions, fetch, remove."""

    def __init__(self, table: DataFrame, key: str = "key", start: str = "window_start", end: str = "window_end"):
        self.table, self.key, self.start, self.end = table, key, start, end

    def _with(self, table: DataFrame) -> SessionStore:
        return SessionStore(table, self.key, self.start, self.end)

    def put(self, rows: DataFrame) -> SessionStore:
        return self._with(self.remove(rows).table.unionByName(rows))

    def remove(self, sessions: DataFrame) -> SessionStore:
        """The store without the sessions of these keys, starts and ends."""
        names = [self.key, self.start, self.end]
        return self._with(self.table.join(sessions.select(*names), names, "left_anti"))

    def find_sessions(self, key, earliest_end, latest_start) -> DataFrame:
        """A key's sessions that end at ``earliest_end`` or later and start at ``latest_start`` or before: those that a row between may join."""
        return self.fetch(key).where((F.col(self.end) >= F.lit(earliest_end)) & (F.col(self.start) <= F.lit(latest_start)))

    def fetch(self, key) -> DataFrame:
        return self.table.where(F.col(self.key) == F.lit(key)).orderBy(self.start)
