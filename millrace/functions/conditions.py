"""Conditions on JSON documents, and typed predicates on columns, as boolean Columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The operators of the condition language, longest first.
OPERATORS = ("contains", "startsWith", "endsWith", "==", "!=", "<>", ">=", "<=", "=", ">", "<")
_SHAPE = re.compile(r"^\s*(\$\S*)\s+(" + "|".join(map(re.escape, OPERATORS)) + r")\s+(.*?)\s*$", re.S)


def condition(text: str, document: Column | str = "value") -> Column:
    """``$.path op value`` on a JSON text column; a missing path is false, text operators ignore case, == does not."""
    if not (m := _SHAPE.match(text)):
        raise ValueError(f"not a condition: {text!r}")
    path, op, raw = m.groups()
    literal = raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "'\"" else raw
    found = F.get_json_object(F.col(document) if isinstance(document, str) else document, path)
    return F.coalesce(compare(found, op, literal), F.lit(False))


def compare(found: Column, op: str, literal: str) -> Column:
    if op in ("contains", "startsWith", "endsWith"):
        low, wanted = F.lower(found), F.lit(literal.lower())
        return {"contains": low.contains, "startsWith": low.startswith, "endsWith": low.endswith}[op](wanted)
    if op in ("=", "=="):
        return found == literal
    if op in ("!=", "<>"):
        return found != literal
    number = found.try_cast("double")
    value = F.lit(literal).try_cast("double")
    return {">": number > value, "<": number < value, ">=": number >= value, "<=": number <= value}[op]


class Field:
    """A field of a typed payload for predicates: ``Field("Amount") > 10``, combined with ``&``, ``|`` and ``~``."""

    def __init__(self, path: str, of: Column | None = None):
        self.column = F.col(path) if of is None else of.getField(path)

    def _test(self, op: Callable[[Column], Column]) -> Column:
        return F.coalesce(op(self.column), F.lit(False))

    def __gt__(self, x):
        return self._test(lambda c: c > x)

    def __ge__(self, x):
        return self._test(lambda c: c >= x)

    def __lt__(self, x):
        return self._test(lambda c: c < x)

    def __le__(self, x):
        return self._test(lambda c: c <= x)

    def __eq__(self, x):
        return self.column.isNull() if x is None else self._test(lambda c: c == x)

    def __ne__(self, x):
        return self.column.isNotNull() if x is None else ~(self == x)

    __hash__ = None

    def has_value(self) -> Column:
        return self.column.isNotNull()

    def contains(self, x: str) -> Column:
        return self._test(lambda c: F.lower(c).contains(x.lower()))

    def starts_with(self, x: str) -> Column:
        return self._test(lambda c: F.lower(c).startswith(x.lower()))

    def ends_with(self, x: str) -> Column:
        return self._test(lambda c: F.lower(c).endswith(x.lower()))

    def field(self, name: str) -> Field:
        return Field(name, self.column)
