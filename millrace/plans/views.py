"""Materialized views and continuous queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import discard, scratch


@dataclass
class View:
    name: str
    query: str
    snapshot: DataFrame | None = None
    path: str | None = None
    refreshes: int = 0
    properties: dict[str, str] = field(default_factory=dict)


class Views:
    """Views by name, any case. A refresh computes a view, stores its rows, and swaps the snapshot in one step; readers see the old or the new one.

    A snapshot is a table in the session's scratch folder. The one before it stays for those who still read it and goes at the next refresh.
    """

    def __init__(self, spark: SparkSession, run: Callable[[str], DataFrame]):
        self._spark, self._run, self._views = spark, run, {}
        self._former: dict[str, str] = {}

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._views

    def __iter__(self):
        return iter(self._views.values())

    def create(self, name: str, query: str, if_not_exists: bool = False) -> View:
        if name in self and not if_not_exists:
            raise ValueError(f"view {name} exists")
        return self._views.setdefault(name.lower(), View(name, query))

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name not in self and not if_exists:
            raise KeyError(name)
        if view := self._views.pop(name.lower(), None):
            for path in (view.path, self._former.pop(name.lower(), None)):
                if path:
                    discard(self._spark, path)

    def refresh(self, name: str) -> View:
        view = self._views[name.lower()]
        rows, path = self._run(view.query), scratch(self._spark, f"view-{name.lower()}")
        rows.write.parquet(path)
        if gone := self._former.pop(name.lower(), None):
            discard(self._spark, gone)
        if view.path:
            self._former[name.lower()] = view.path
        view.snapshot, view.path = self._spark.read.schema(rows.schema).parquet(path), path
        view.refreshes += 1
        return view

    def read(self, name: str) -> DataFrame:
        view = self._views[name.lower()]
        return view.snapshot if view.snapshot is not None else self.refresh(name).snapshot


class ContinuousQueries:
    """Named streaming queries; starting one more than ``most`` at a time fails."""

    def __init__(self, most: int = 16):
        self.most, self._queries = most, {}

    def start(self, name: str, stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", **trigger) -> StreamingQuery:
        if len([q for q in self._queries.values() if q.isActive]) >= self.most:
            raise RuntimeError(f"{self.most} queries run already")
        query = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"processingTime": "5 seconds"})).start()
        self._queries[name] = query
        return query

    def list(self) -> dict[str, bool]:
        return {n: q.isActive for n, q in self._queries.items()}

    def stop(self, name: str) -> None:
        self._queries.pop(name).stop()
