"""Changelogs as tables: latest row of each key, compaction, change data, key-value history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], deleted: Column | None = None) -> DataFrame:
    """The last row of each key by ``order``; keys whose last row is deleted are gone.

    One aggregation with map-side combine instead of a window, so a hot key's rows never meet in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest, *([deleted.alias("__gone")] if deleted is not None else [])), F.struct(*order))
    out = df.groupBy(*keys).agg(row.alias("__r")).select(*keys, "__r.*")
    return out.where(~F.coalesce("__gone", F.lit(False))).drop("__gone") if deleted is not None else out


def compact(changelog: DataFrame, key: str = "key", value: str = "value", order: str = "offset") -> DataFrame:
    """Log compaction: the last value of each key; a null value deletes the key."""
    return latest(changelog, [key], [order], F.col(value).isNull())


def apply_changes(events: DataFrame, keys: list[str], op: str = "op", order: str = "lsn", image: str = "after") -> DataFrame:
    """The table that change events (insert, update, delete, snapshot) lead to."""
    last = latest(events.select(*keys, op, order, image), keys, [order], F.lower(op) == "delete")
    return last.select(*keys, f"{image}.*")


def history(changelog: DataFrame, key: str, order: str) -> DataFrame:
    """Every version of each key, numbered from 1."""
    return changelog.withColumn("revision", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def live(df: DataFrame, timestamp: str, ttl: str, now: Column) -> DataFrame:
    """Rows whose time to live hasn't run out."""
    return df.where(F.col(timestamp) + F.expr(f"interval {ttl}") > now)
