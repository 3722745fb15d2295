"""Joins beyond the relational ones: by time, by latest row, one to one, by reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import seconds, time_cell
from .tables import latest


#: Rows up to which a table may be broadcast.
BROADCAST_ROWS = 200_000


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, before: str, after: str, how: str = "inner") -> DataFrame:
    """Rows of equal keys with right_ts in [left_ts - before, left_ts + after]; works on streams that have watermarks.

    Tables also meet by cells of time, so a hot key forms pairs of neighbouring times only: a left row lies in one cell, a right row in
    the two or three cells whose rows it may join. Right columns of the keys' names are dropped, but for right and full joins; other
    columns need names of their own.
    """
    right = right.select(*(F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns))
    how = {"leftouter": "left", "fullouter": "full", "outer": "full", "rightouter": "right", "leftanti": "left_anti", "leftsemi": "left_semi"}.get(how.lower().replace("_", ""), how)
    test = (F.col(right_ts) >= F.col(left_ts) - F.expr(f"interval {before}")) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {after}"))
    for k in keys:
        test = test & (F.col(k) == F.col(f"__r_{k}"))
    drop = [f"__r_{k}" for k in keys] if how in ("inner", "left") else []
    if left.isStreaming or right.isStreaming:
        return left.join(right, test, how).drop(*drop)
    size = max(1, seconds(before) + seconds(after))

    def meet(one: DataFrame, ts: str, other: DataFrame, other_ts: str, least: str, most: str, how: str) -> DataFrame:
        """Rows of ``one`` in their cell, of ``other`` in the cells of those they may join."""
        one = one.withColumn("__cell", time_cell(F.col(ts), size))
        ends = (time_cell(F.col(other_ts) - F.expr(f"interval {least}"), size), time_cell(F.col(other_ts) + F.expr(f"interval {most}"), size))
        other = other.withColumn("__cells", F.explode(F.sequence(*ends)))
        return one.join(other, test & (F.col("__cell") == F.col("__cells")), how).drop("__cell", "__cells")

    if how in ("right", "full"):
        out = meet(left, left_ts, right, right_ts, after, before, "inner" if how == "right" else "left")
        return out.unionByName(meet(right, right_ts, left, left_ts, before, after, "left_anti"), allowMissingColumns=True).select(*left.columns, *right.columns)
    return meet(left, left_ts, right, right_ts, after, before, how).drop(*drop)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, take: list[str], strict: bool = False) -> DataFrame:
    """Each left row with ``take`` of the last right row of its keys at or before its time (before it if ``strict``).

    Both sides pass one sort within the keys; no pair of rows is formed.
    """
    cols = left.columns
    side = 1 if not strict else -1
    a = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(0).alias("__side"), F.struct(*cols).alias("__l"), F.lit(None).alias("__r"))
    b = right.select(*keys, F.col(right_ts).alias("__t"), F.lit(-side).alias("__side"), F.lit(None).alias("__l"), F.struct(*take).alias("__r"))
    both = a.unionByName(b)
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__r", F.last("__r", True).over(w)).where("__l is not null").select("__l.*", *(F.col("__r")[c].alias(c) for c in take))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], how: str = "inner") -> DataFrame:
    """Pairs the n-th left row of a key with the n-th right row: each row is matched once."""
    number = lambda df, order: df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*keys, "__n"], how).drop("__n")


def lookup(stream: DataFrame, table: DataFrame, on: list[str] | Column, how: str = "inner", small: bool = False) -> DataFrame:
    """Stream rows with the current row of a table; a table declared ``small`` is counted, and broadcast up to 200,000 rows."""
    fits = small and not table.isStreaming and table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return stream.join(F.broadcast(table) if fits else table, on, how)


def table_join(left: DataFrame, right: DataFrame, key: str, order: str, how: str = "inner") -> DataFrame:
    """Two changelogs (key, value, order) joined on their latest values, tombstones (null) gone: key, left_value, right_value."""
    a = latest(left, [key], [order], F.col("value").isNull()).select(key, F.col("value").alias("left_value"))
    b = latest(right, [key], [order], F.col("value").isNull()).select(key, F.col("value").alias("right_value"))
    return a.join(b, key, how)


def foreign_key_join(primary: DataFrame, foreign: DataFrame, reference: str, key: str, how: str = "inner") -> DataFrame:
    """Rows of a table with the row that their reference names; a null reference finds nothing."""
    return primary.join(foreign, F.col(reference) == F.col(key), how)


def last_state(df: DataFrame, keys: list[str], order: list[str], value: Column, ttl: tuple[str, str] | None = None) -> Column:
    """The value that the key's previous row left behind; with (timestamp column, interval) it expires."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if ttl is None:
        return F.last(value, True).over(w)
    held = F.last(F.when(value.isNotNull(), F.struct(value.alias("v"), F.col(ttl[0]).alias("t"))), True).over(w)
    return F.when(held["t"] + F.expr(f"interval {ttl[1]}") > F.col(ttl[0]), held["v"])


def expand_range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, size: float) -> DataFrame:
    """Points with the ranges that hold them (both ends included), as an equi-join on cells instead of a nested loop.

    A range of up to ``size`` lies in at most two cells of that size, one of up to twice as much in two cells twice as wide, and so on: a
    range is two rows at most, a point one row for each width that occurs.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col(high) - F.col(low)).cast("double") / F.lit(float(size))))).cast("int")
    cell = lambda c, at: F.floor(F.col(c) / (F.lit(float(size)) * F.pow(F.lit(2.0), at))).cast("bigint")
    levelled = ranges.where(F.col(low) <= F.col(high)).withColumn("__level", F.coalesce(level, F.lit(0)))
    levels = [r[0] for r in levelled.select("__level").distinct().collect()]  # some sixty at most
    r = levelled.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(low, F.col("__level")), cell(high, F.col("__level"))))))
    p = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    return p.withColumn("__cell", cell(point, F.col("__level"))).join(r, ["__level", "__cell"]).where(F.col(point).between(F.col(low), F.col(high))).drop("__cell", "__level")
