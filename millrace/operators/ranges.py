"""Running numbers and maxima over a whole table without a task that sees all of it, and cells of time and number for joins by range."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Seconds of the units of intervals.
UNITS = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400, "week": 604_800}


def seconds(interval: str) -> int:
    """``1 hour 30 minutes`` in seconds."""
    parts = re.findall(r"(\d+)\s+([a-z]+?)s?\b", interval.lower())
    if not parts or any(unit not in UNITS for _, unit in parts):
        raise ValueError(f"not an interval of seconds to weeks: {interval!r}")
    return sum(int(n) * UNITS[unit] for n, unit in parts)


def time_cell(ts: Column, size: int) -> Column:
    """The number of the interval of ``size`` seconds that a time lies in."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(size)).cast("bigint")


def _cells(df: DataFrame, order: list[str], rows: int) -> Column | None:
    """A range number that follows the order, some ``rows`` rows each; null if one range will do."""
    kind = df.schema[order[0]].dataType.typeName()
    if kind == "string" or (count := df.count()) <= rows:  # texts have no quantiles: they stay one range
        return None
    place = (F.unix_micros(F.col(order[0]).cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else F.col(order[0])).cast("double")
    shares = [k / -(-count // rows) for k in range(1, -(-count // rows))]
    cuts = sorted(set(df.select(place.alias("p")).stat.approxQuantile("p", shares, 0.2 / len(shares))))
    return _range_of(place, cuts)


def numbered(df: DataFrame, order: list[str], name: str, groups: list[str] = (), rows: int = 500_000) -> DataFrame:
    """``df`` with a number from 0 in the order of some columns, within each of ``groups`` if there are any.

    The values of the first order column are cut into ranges of some ``rows`` rows by approximate quantiles; rows are numbered within a
    range, and each range adds the count of the ranges before it. Rows that agree in the first column share a range.
    """
    within = Window.partitionBy(*groups)
    if (cell := _cells(df, order, rows)) is None:
        return df.withColumn(name, (F.row_number().over(within.orderBy(*order)) - 1).cast("bigint"))
    dealt = df.withColumn("__range", cell)
    counts = dealt.groupBy(*groups, "__range").agg(F.count(F.lit(1)).alias("__many"))
    before = within.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select(*groups, "__range", F.coalesce(F.sum("__many").over(before), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy(*groups, "__range").orderBy(*order)) - 1
    out = dealt.withColumn("__at", at).join(offsets, [*groups, "__range"])
    return out.select(*df.columns, (F.col("__at") + F.col("__before")).cast("bigint").alias(name))


def greatest_before(df: DataFrame, value: str, order: list[str], name: str, rows: int = 500_000) -> DataFrame:
    """``df`` with the greatest ``value`` of all rows before each in the order; ranges as in ``numbered``, each with the maximum of those before it."""
    if (cell := _cells(df, order, rows)) is None:
        return df.withColumn(name, F.max(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    dealt = df.withColumn("__range", cell)
    tops = dealt.groupBy("__range").agg(F.max(value).alias("__top"))
    tops = tops.select("__range", F.max("__top").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    own = F.max(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("__own", own).join(tops, "__range").select(*df.columns, F.greatest("__own", "__before").alias(name))


def _range_of(value: Column, cuts: list[float]) -> Column:
    """How many sorted cuts lie at or below a value, by binary search; null counts as the least."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(value.isNull(), F.lit(0)).otherwise(search(0, len(cuts)))
