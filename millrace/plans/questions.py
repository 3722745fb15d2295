"""Plain questions as SQL, by templates. Only SELECT comes out."""

from __future__ import annotations

import re

#: Pattern -> SQL; groups are identifiers or numbers, so nothing else of a question reaches the statement.
TEMPLATES = (
    (r"how many (\w+) per (\w+)|count (\w+) (?:by|per) (\w+)", lambda g: f"SELECT {g[1] or g[3]}, COUNT(*) AS count FROM {g[0] or g[2]} GROUP BY {g[1] or g[3]}"),
    (r"top (\d+) (\w+) by (\w+)", lambda g: f"SELECT * FROM {g[1]} ORDER BY {g[2]} DESC LIMIT {g[0]}"),
    (r"(?:latest|last) (\d+) (\w+)(?: by (\w+))?", lambda g: f"SELECT * FROM {g[1]} ORDER BY {g[2] or '_timestamp'} DESC LIMIT {g[0]}"),
    (r"(average|avg|total|sum|max|min|maximum|minimum)(?: of)? (\w+) (?:in|of|from) (\w+)(?: (?:by|per) (\w+))?", lambda g: _aggregate(*g)),
    (r"(?:distinct|unique) (\w+) (?:in|of|from) (\w+)", lambda g: f"SELECT DISTINCT {g[0]} FROM {g[1]}"),
    (r"(\w+) between (\d{4}-\d{2}-\d{2}) and (\d{4}-\d{2}-\d{2})(?: by (\w+))?", lambda g: f"SELECT * FROM {g[0]} WHERE {g[3] or '_timestamp'} BETWEEN TIMESTAMP '{g[1]}' AND TIMESTAMP '{g[2]}'"),
    (r"how many (\w+)|count (\w+)", lambda g: f"SELECT COUNT(*) AS count FROM {g[0] or g[1]}"),
    (r"show (?:all |me )?(\w+)(?: limit (\d+))?", lambda g: f"SELECT * FROM {g[0]} LIMIT {g[1] or 100}"),
)
_CALLS = {"average": "AVG", "avg": "AVG", "total": "SUM", "sum": "SUM", "max": "MAX", "maximum": "MAX", "min": "MIN", "minimum": "MIN"}


def _aggregate(what: str, column: str, table: str, by: str | None) -> str:
    call = f"{_CALLS[what.lower()]}({column}) AS value"
    return f"SELECT {by}, {call} FROM {table} GROUP BY {by}" if by else f"SELECT {call} FROM {table}"


def to_sql(question: str) -> str:
    """The SELECT that a question asks for; ValueError if no template fits."""
    for pattern, make in TEMPLATES:
        if m := re.search(rf"\b(?:{pattern})\b", question.strip(), re.I):
            return make(m.groups())
    raise ValueError(f"no template for {question!r}")


def guard(sql: str) -> str:
    """The statement if it is one SELECT."""
    if not re.match(r"^\s*(SELECT|WITH)\b", sql, re.I) or ";" in sql.strip().rstrip(";"):
        raise ValueError("only one SELECT is allowed")
    return sql
