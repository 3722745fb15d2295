"""Aggregations beyond the relational ones: folds in order, batches by count, running updates, retractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import latest


def fold(df: DataFrame, keys: list[str], order: list[str], value: str, start: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """An ordered fold over each key's values, for steps that no built-in aggregate expresses."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda s: s["__v"])
    return df.groupBy(*keys).agg(F.aggregate(ordered, start, step).alias(name))


def running(df: DataFrame, keys: list[str], order: list[str], aggregate: Column, name: str) -> DataFrame:
    """Every update of a running aggregate, as an eager stream would emit it."""
    return df.withColumn(name, aggregate.over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Rows with their batch (from 0) and place: a batch is ``size`` consecutive rows of a key."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("__k", k).withColumn("batch_id", F.floor(F.col("__k") / size).cast("bigint")).withColumn("batch_index", (F.col("__k") % size).cast("bigint")).drop("__k")


def accumulate(df: DataFrame, keys: list[str], order: list[str], size: int, value: str) -> DataFrame:
    """Batches as one row each: keys, batch_id, batch_size, items in order."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("batch_index", F.col(value).alias("v")))), lambda s: s["v"])
    return batches(df, keys, order, size).groupBy(*keys, "batch_id").agg(F.count(F.lit(1)).alias("batch_size"), items.alias("items"))


def table_aggregate(changelog: DataFrame, key: str, order: str, group: str, *aggregates: Column) -> DataFrame:
    """Aggregates over a table grouped by a column of its latest rows: a changed row leaves its old group, a deleted row every group."""
    return latest(changelog, [key], [order], F.col(group).isNull()).groupBy(group).agg(*aggregates)
