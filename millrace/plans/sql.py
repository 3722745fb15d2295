"""The streaming-SQL surface: Spark SQL with named streams, window clauses, EMIT CHANGES, streams, tables and views.

Statements are Spark's; only the clauses that Spark lacks are rewritten, each by one pattern:
- ``FROM t WINDOW TUMBLE(ts, 5 MINUTES)`` (HOP, SESSION) puts the window among the grouping keys as window_start and window_end;
- ``CREATE STREAM|TABLE x [WITH (..)] AS``, ``CREATE MATERIALIZED VIEW [IF NOT EXISTS] x AS``, ``DROP [MATERIALIZED] VIEW``, ``INSERT INTO``;
- a trailing ``EMIT CHANGES`` is taken off and told to the caller.

Texts in quotes are put aside before anything is rewritten. The sources of a statement become temporary views under names of their own
while Spark resolves it. CREATE and INSERT store rows of tables in the scratch folder; a stream's query stays a query.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch
from .views import Views

_TEXT = re.compile(r"'(?:[^'\\]|\\.|'')*'", re.S)
_MASK = re.compile("'\x01(\\d+)\x01'")
_SIZE = r"(?:INTERVAL\s+)?(?:'\x01\d+\x01'(?:\s*[A-Za-z]+)?|\d+\s*[A-Za-z]+)"
_WINDOW = re.compile(rf"\bWINDOW\s+(TUMBLE|TUMBLING|HOP|HOPPING|SESSION)\s*\(\s*([\w.`]+)\s*,\s*({_SIZE})(?:\s*,\s*({_SIZE}))?\s*\)", re.I)
_EMIT = re.compile(r"\s+EMIT\s+CHANGES\s*;?\s*$", re.I)
_CREATE = re.compile(r"^\s*CREATE\s+(STREAM|TABLE|MATERIALIZED\s+VIEW)\s+(IF\s+NOT\s+EXISTS\s+)?`?([\w-]+)`?\s*(?:WITH\s*\(([^)]*)\)\s*)?AS\s+(SELECT\b.*)$", re.I | re.S)
_DROP = re.compile(r"^\s*DROP\s+(MATERIALIZED\s+)?VIEW\s+(IF\s+EXISTS\s+)?`?([\w-]+)`?\s*;?\s*$", re.I)
_INSERT = re.compile(r"^\s*INSERT\s+INTO\s+`?([\w-]+)`?\s+(SELECT\b.*)$", re.I | re.S)
#: The units of window sizes.
UNITS = {"ms": "milliseconds", "millisecond": "milliseconds", "milliseconds": "milliseconds", "s": "seconds", "second": "seconds", "seconds": "seconds", "m": "minutes", "minute": "minutes", "minutes": "minutes", "h": "hours", "hour": "hours", "hours": "hours", "d": "days", "day": "days", "days": "days"}


def duration(text: str) -> str:
    """``INTERVAL '5' MINUTE``, ``5 MINUTES`` or ``'5 m'`` as a duration of Spark."""
    number, unit = re.search(r"(\d+)\W*([A-Za-z]+)\W*$", text).groups()
    return f"{number} {UNITS[unit.lower()]}"


def masked(sql: str) -> tuple[str, Callable[[str], str]]:
    """The statement with its quoted texts put aside, and what puts them back."""
    texts: list[str] = []

    def aside(m: re.Match) -> str:
        texts.append(m[0])
        return f"'\x01{len(texts) - 1}\x01'"

    return _TEXT.sub(aside, sql), lambda part: _MASK.sub(lambda m: texts[int(m[1])], part)


class StreamingSql:
    """Named streams and views of one session."""

    def __init__(self, spark: SparkSession, read_topic: Callable[[str], DataFrame] | None = None):
        self.spark, self.read_topic = spark, read_topic
        self.sources: dict[str, Callable[[], DataFrame]] = {}
        self.views = Views(spark, self.run)
        self.properties: dict[str, dict[str, str]] = {}

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        """A stream by name: a DataFrame, or a function that makes one when a statement names it."""
        self.sources[name.lower()] = df if callable(df) else (lambda: df)

    def stored(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows as they are now, as a table in the scratch folder; a stream as it is."""
        if rows.isStreaming:
            return rows
        path = scratch(self.spark, f"sql-{name}")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def tables_of(self, sql: str) -> list[str]:
        """The names that a statement reads."""
        found = re.findall(r"\b(?:FROM|JOIN)\s+(`[^`]+`|\"[^\"]+\"|[A-Za-z_][\w-]*)", masked(sql)[0], re.I)
        return list(dict.fromkeys(x.strip('`"') for x in found))

    def execute(self, sql: str) -> DataFrame | None:
        """Runs a statement; queries give a DataFrame, CREATE, DROP and INSERT give None."""
        sql, whole = masked(sql.strip().rstrip(";"))
        sql = _EMIT.sub("", sql)
        if m := _CREATE.match(sql):
            kind, guarded, name, properties, query = m.groups()
            pairs = (whole(x).partition("=") for x in (properties or "").split(",") if x.strip())
            self.properties[name.lower()] = {k.strip().strip("'\""): v.strip().strip("'\"") for k, _, v in pairs}
            if kind.upper().startswith("MATERIALIZED"):
                self.views.create(name, whole(query), if_not_exists=bool(guarded))
            elif not (guarded and name.lower() in self.sources):
                self.register(name, self.stored(name.lower(), self.run(whole(query))))
            return None
        if m := _DROP.match(sql):
            self.views.drop(m[3], if_exists=bool(m[2]))
            return None
        if m := _INSERT.match(sql):
            name, query = m[1].lower(), whole(m[2])
            more = self.stored(name, self.run(query))
            had = self.sources.get(name)
            self.register(name, (lambda: had().unionByName(more, allowMissingColumns=True)) if had else more)
            return None
        return self.run(whole(sql))

    def emits_changes(self, sql: str) -> bool:
        return bool(_EMIT.search(sql.strip()))

    def run(self, query: str) -> DataFrame:
        names = {}
        for name in self.tables_of(query):
            low = name.lower()
            if low in self.views:
                names[name] = self.views.read(low)
            elif low in self.sources:
                names[name] = self.sources[low]()
            elif self.read_topic is not None and not self.spark.catalog.tableExists(f"`{name}`"):
                names[name] = self.read_topic(name)
        text, whole = masked(query)
        text = self.window_clause(text, whole)
        views = {}
        for name, df in names.items():
            views[name] = f"millrace_{uuid.uuid4().hex}"
            df.createOrReplaceTempView(views[name])
            text = re.sub(rf"(\b(?:FROM|JOIN)\s+)[`\"]?{re.escape(name)}[`\"]?(?![\w-])(?=(\s+(?:AS\s+)?(\w+))?)", lambda m, name=name: self._named(m, views[name], name), text, flags=re.I)
        try:
            return self.spark.sql(whole(text))  # resolved at once, so the views may go
        finally:
            for view in views.values():
                self.spark.catalog.dropTempView(view)

    @staticmethod
    def _named(m: re.Match, view: str, name: str) -> str:
        word = (m[3] or "").upper()
        bare = word in ("", "WHERE", "GROUP", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "ON", "ORDER", "LIMIT", "HAVING", "UNION", "WINDOW", "EXCEPT", "INTERSECT")
        return f"{m[1]}{view}" + (f" AS `{name}`" if bare else "")

    def window_clause(self, query: str, whole: Callable[[str], str] = lambda x: x) -> str:
        """Turns a WINDOW clause into grouping by a window; window_start and window_end become columns that can be selected."""
        if not (m := _WINDOW.search(query)):
            return query
        kind, column, size, advance = m[1].upper(), m[2], duration(whole(m[3])), whole(m[4] or m[3])
        if kind.startswith("HOP"):
            call = f"window({column}, '{size}', '{duration(advance)}')"
        else:
            call = f"session_window({column}, '{size}')" if kind == "SESSION" else f"window({column}, '{size}')"
        field = "session_window" if kind == "SESSION" else "window"
        begin = max((x.start() for x in re.finditer(r"\bSELECT\b", query[: m.start()], re.I)), default=0)
        head = re.sub(r"\bwindow_(start|end)\b(?!\s*\()", lambda w: f"{field}.{w[1]} AS window_{w[1]}", query[begin : m.start()], flags=re.I)
        return query[:begin] + head + self._grouped(query[m.end() :], call)

    @staticmethod
    def _grouped(tail: str, call: str) -> str:
        """What follows a window clause, with the window among the grouping keys of its own SELECT."""
        depth = 0
        for x in re.finditer(r"[()]|\bGROUP\s+BY\b|\b(?:HAVING|ORDER\s+BY|LIMIT|UNION|EXCEPT|INTERSECT)\b|$", tail, re.I):
            depth += {"(": 1, ")": -1}.get(x[0], 0)
            if depth == 0 and x[0][:5].upper() == "GROUP":
                return f"{tail[: x.end()]} {call}, {tail[x.end() :]}"
            if depth < 0 or (depth == 0 and x[0] not in ("(", ")")):
                return f"{tail[: x.start()].rstrip()} GROUP BY {call} {tail[x.start() :]}"
        return tail
