"""Writing: upserts, dead letters, repeated deliveries, routing by topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], strategy: str = "insert_or_update", version: str | None = None) -> DataFrame:
    """The target after applying ``rows``: insert_or_update, insert_or_skip, insert_or_fail, replace, insert_or_update_if_newer.

    Of several new rows of a key the last by ``version`` counts, or any if there is no version.
    """
    order = [F.desc_nulls_last(version)] if version else [F.lit(1)]
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")
    if strategy == "replace":
        return rows
    if strategy == "insert_or_update":
        return target.join(rows, keys, "left_anti").unionByName(rows)
    if strategy == "insert_or_skip":
        return target.unionByName(rows.join(target, keys, "left_anti"))
    if strategy == "insert_or_fail":
        met = rows.join(target.select(*keys).distinct().withColumn("__met", F.lit(True)), keys, "left")
        return target.unionByName(met.where(F.when(F.col("__met"), F.raise_error(F.lit("key exists already"))).otherwise(F.lit(True)).cast("boolean")).drop("__met"))
    if strategy == "insert_or_update_if_newer":
        both = target.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), "__new"))
        return both.withColumn("__k", first).where("__k = 1").drop("__k", "__new")
    raise ValueError(strategy)


def dead_letters(df: DataFrame, parsed: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(good rows with ``parsed``, bad rows with the reason): bad where ``parsed`` is null."""
    marked = df.withColumn("parsed", parsed)
    return marked.where("parsed is not null"), marked.where("parsed is null").drop("parsed").withColumn("error", F.lit(reason))


def once(df: DataFrame, ids: list[str], order: list[Column | str]) -> DataFrame:
    """The first delivery of each id."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*ids).orderBy(*order))).where("__k = 1").drop("__k")


def route(df: DataFrame, topic: Column) -> DataFrame:
    """Rows with the topic each goes to; rows without one are dropped. Kafka's sink reads the column, file sinks partition by it."""
    return df.withColumn("topic", topic).where("topic is not null")
