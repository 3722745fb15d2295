"""Time windows over batches and streams, and what goes with them: alignment, lateness, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import greatest_before

#: Days from 0001-01-01, to which the SQL dialect aligns windows, to 1970-01-01.
DAYS_TO_EPOCH = 719_162


def aligned_start(size_seconds: int) -> str:
    """The start offset that makes windows of a size count from 0001-01-01 instead of the Unix epoch."""
    return f"{-(DAYS_TO_EPOCH * 86_400) % size_seconds} seconds"


def tumble(df: DataFrame, ts: str, size: str, keys: list[str], *aggregates: Column, start: str | None = None) -> DataFrame:
    return _flat(df.groupBy(F.window(ts, size, startTime=start).alias("w"), *keys).agg(*aggregates), keys)


def hop(df: DataFrame, ts: str, size: str, advance: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return _flat(df.groupBy(F.window(ts, size, advance).alias("w"), *keys).agg(*aggregates), keys)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *aggregates: Column, with_gap: bool = True) -> DataFrame:
    """Sessions of each key: an event exactly one gap after the last still belongs. Their end is the last event plus the gap, or
    the last event if not ``with_gap``."""
    out = _flat(df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggregates), keys)
    return out if with_gap else out.withColumn("window_end", F.col("window_end") - F.expr(f"interval {gap}"))


def _flat(df: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in ("w", *keys)]
    return df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *rest)


def sliding(df: DataFrame, ts: str, seconds: int, keys: list[str], aggregate: Column, name: str, both: bool = True) -> DataFrame:
    """Each row with an aggregate over its key's rows within ``seconds`` before it, and after it too if ``both``."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(micros).rangeBetween(-seconds * 1_000_000, seconds * 1_000_000 if both else 0)
    return df.withColumn(name, aggregate.over(w))


def watermarked(df: DataFrame, ts: str, delay: str = "0 seconds") -> DataFrame:
    """A stream with a bounded-out-of-orderness watermark; zone-less times count as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def running_watermark(ts: str, order: list[str], delay_ms: int, keys: list[str] = ()) -> Column:
    """The watermark in ms after each row of a replay: the greatest time so far, less the delay and one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.max(F.unix_millis(F.col(ts).cast("timestamp"))).over(w) - F.lit(delay_ms) - 1


def combined_watermark(df: DataFrame, ts: str, source: str, sources: list, keys: list[str], order: list[str], delay_ms: int, idle_ms: int, name: str, arrived: str | None = None) -> DataFrame:
    """A replay's watermark over several sources, in ms: the least of their greatest times so far, less the delay and one; it never goes back.

    A source whose last row arrived over ``idle_ms`` before a row is idle there and holds nothing back; ``arrived`` is when a row
    came, its own time if not given. Sources that have sent nothing yet are idle. On live streams Spark combines watermarks itself:
    ``watermark_policy``.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    now, alive = ms(arrived or ts), []
    for s in sources:
        mine = F.col(source) == F.lit(s)
        top, last = F.max(F.when(mine, ms(ts))).over(w), F.max(F.when(mine, now)).over(w)
        alive.append(F.when(last >= now - F.lit(idle_ms), top))
    least = F.least(*alive) if len(alive) > 1 else alive[0]
    return df.withColumn("__least", least).withColumn(name, F.max("__least").over(w) - F.lit(delay_ms) - 1).drop("__least")


def watermark_policy(spark: SparkSession, policy: str = "min") -> None:
    """How streams with several watermarks combine them: ``min`` waits for the slowest, ``max`` follows the fastest."""
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", policy)


def late_split(df: DataFrame, ts: str, order: list[str], delay: str, keys: list[str] = ()) -> DataFrame:
    """Rows of a replay with ``is_late``: earlier than the greatest time before them less the delay."""
    if not keys:
        late = F.col(ts) < F.col("__before") - F.expr(f"interval {delay}")
        return greatest_before(df, ts, order, "__before").withColumn("is_late", F.coalesce(late, F.lit(False))).drop("__before")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("is_late", F.coalesce(F.col(ts) < F.max(ts).over(w) - F.expr(f"interval {delay}"), F.lit(False)))


def closed_windows(windows: DataFrame, rows: DataFrame, ts: str, grace: str) -> DataFrame:
    """Suppression until windows close: those whose end and grace the greatest time has passed. One number is compared, no rows."""
    top = rows.agg(F.max(ts).alias("__top"))
    return windows.join(F.broadcast(top), F.col("window_end") + F.expr(f"interval {grace}") <= F.col("__top")).drop("__top")


def last_in_interval(df: DataFrame, ts: str, size: str, keys: list[str], order: list[str]) -> DataFrame:
    """Suppression for a time limit: of each key the last update in every interval."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return out.select(*keys, F.col("w.start").alias("interval_start"), "r.*")


def within_rate(df: DataFrame, ts: str, per: str, limit: int, keys: list[str], order: list[str]) -> DataFrame:
    """At most ``limit`` rows of a key in every interval, the first ones: a rate limit on event time."""
    bucket = F.window(ts, per)["start"]
    k = F.row_number().over(Window.partitionBy(*keys, "__w").orderBy(*order))
    return df.withColumn("__w", bucket).withColumn("__k", k).where(F.col("__k") <= limit).drop("__k", "__w")
