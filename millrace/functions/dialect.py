"""Scalar functions with the streaming-SQL dialect's semantics, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def length0(x: Column) -> Column:
    """Length; null counts as 0."""
    return F.coalesce(F.char_length(x), F.lit(0))


def substring_from(x: Column, start: int, length: int | None = None) -> Column:
    """From 1-based ``start``, clamped to the text; out of range and null give ''."""
    start = max(start, 1)
    text = F.coalesce(x, F.lit(""))
    return F.substr(text, F.lit(start), F.lit(length)) if length is not None else F.substr(text, F.lit(start))


def concat_text(*xs: Column) -> Column:
    """Concatenation in which null counts as ''."""
    return F.concat(*(F.coalesce(x.cast("string"), F.lit("")) for x in xs))


def replace_text(x: Column, old: str, new: str) -> Column:
    return F.replace(F.coalesce(x, F.lit("")), F.lit(old), F.lit(new))


def round_even(x: Column, places: int = 0) -> Column:
    """Ties go to the even neighbour."""
    return F.bround(x, places)


def ceil_double(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor_double(x: Column) -> Column:
    return F.floor(x).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """Division in doubles; anything by zero is NaN."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.lit(NAN)).otherwise(a / F.when(b == 0, F.lit(None)).otherwise(b))


def remainder(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.lit(NAN)).otherwise(a % F.when(b == 0, F.lit(None)).otherwise(b))


def like_any_case(x: Column, pattern: str) -> Column:
    return F.ilike(x, F.lit(pattern))


def try_cast(x: Column, kind: str, compat: bool = False) -> Column:
    """Cast by a dialect type name; a failure is null, or 0 in compat mode. Unknown types pass the value through."""
    kinds = {"int": "int", "integer": "int", "bigint": "bigint", "long": "bigint", "double": "double", "float": "float", "varchar": "string", "string": "string", "boolean": "boolean", "bool": "boolean"}
    if kind.lower() not in kinds:
        return x
    out = x.try_cast(kinds[kind.lower()])
    return F.coalesce(out, F.lit(0).cast(kinds[kind.lower()])) if compat and kinds[kind.lower()] not in ("string", "boolean") else out


def truthy_text(x: Column) -> Column:
    """Text as a boolean: true unless empty, 'false' or '0'; null stays null."""
    return ~F.lower(x).isin("", "false", "0")


def collect_keep_nulls(x: Column) -> Column:
    """collect_list that keeps nulls."""
    return F.transform(F.collect_list(F.struct(x.alias("v"))), lambda s: s["v"])


def null_equal(a: Column, b: Column) -> Column:
    """Equality in which null equals null."""
    return a.eqNullSafe(b)


def any_case_equal(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def timestamp_of(x: Column) -> Column:
    """A timestamp from ISO text or from epoch milliseconds, numeric or as text."""
    text = x.cast("string")
    return F.coalesce(F.timestamp_millis(text.try_cast("bigint")), text.try_cast("timestamp"))


def epoch_to_timestamp(x: Column) -> Column:
    """Epoch seconds, or milliseconds where the number exceeds 1e12."""
    return F.timestamp_millis(F.when(F.abs(x) > 1e12, x).otherwise(x * 1000).cast("bigint"))


def json_path(column: Column, path: str) -> Column:
    return F.get_json_object(column, path)


def array_contains(x: Column, value) -> Column:
    return F.array_contains(x, value)


def wire_schema_id(message: Column) -> Column:
    """The schema id in a five-byte wire header (a zero byte, then four bytes, most significant first)."""
    return F.conv(F.hex(F.substring(message, 2, 4)), 16, 10).cast("bigint")


def wire_payload(message: Column) -> Column:
    return F.substr(message, F.lit(6))
