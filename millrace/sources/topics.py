"""Topics as tables: records with offset, partition, timestamp, key, value and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import numbered

RAW = "offset bigint, partition int, timestamp timestamp, key string, value string, headers map<string,string>"


def topic_of(df: DataFrame, key: str, order: list[str], timestamp: str, value: Column | None = None, partitions: int = 4) -> DataFrame:
    """Rows of a table as the records of a topic, dealt over partitions by key, offsets counted within each partition.

    Offsets are a running number per partition, counted range by range, so one partition needn't pass through one task; a live topic
    brings its own.
    """
    value = F.to_json(F.struct(*df.columns)) if value is None else value
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(partitions)).cast("int")
    with_part = df.select("*", part.alias("__p"))
    return numbered(with_part, order, "__offset", ["__p"]).select(F.col("__offset").alias("offset"), F.col("__p").alias("partition"), F.col(timestamp).alias("timestamp"), F.col(key).cast("string").alias("key"), value.alias("value"), F.lit(None).cast("map<string,string>").alias("headers"))


def topic_scan(raw: DataFrame, schema: str, headers: list[str] = (), limit: int | None = None) -> DataFrame:
    """Records as rows: _offset, _partition, _timestamp, _key, top-level JSON fields by ``schema``, _value where the value is no JSON object,
    _header_<name> for the named headers."""
    parsed = F.from_json("value", schema)
    is_object = F.coalesce(F.ltrim("value").startswith("{") & F.get_json_object("value", "$").isNotNull(), F.lit(False))
    rows = raw if limit is None else raw.orderBy("partition", "offset").limit(limit)
    return rows.select(
        F.col("offset").alias("_offset"),
        F.col("partition").alias("_partition"),
        F.col("timestamp").alias("_timestamp"),
        F.col("key").alias("_key"),
        F.when(is_object, parsed).alias("__row"),
        F.when(~is_object, F.col("value")).alias("_value"),
        *(F.col("headers")[h].alias(f"_header_{h}") for h in headers),
    ).select("_offset", "_partition", "_timestamp", "_key", "__row.*", "_value", *(f"_header_{h}" for h in headers))


def kafka_scan(spark: SparkSession, servers: str, topics: str, starting: str = "earliest", ending: str = "latest") -> DataFrame:
    """A bounded read of live topics in the shape of RAW."""
    read = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", starting).option("endingOffsets", ending).option("includeHeaders", "true")
    return read.load().selectExpr("offset", "partition", "timestamp", "cast(key as string) key", "cast(value as string) value", "map_from_entries(transform(headers, h -> struct(h.key, cast(h.value as string)))) headers")


def offset_range(raw: DataFrame, partition: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Records of a partition from ``start`` up to, not including, ``end``."""
    for test in (partition is not None and F.col("partition") == partition, start is not None and F.col("offset") >= start, end is not None and F.col("offset") < end):
        raw = raw.where(test) if test is not False else raw
    return raw


def browse(raw: DataFrame, partition: int, offset: int, limit: int) -> DataFrame:
    """A page of a partition."""
    return offset_range(raw, partition, offset).orderBy("offset").limit(limit)


def offset_for_time(raw: DataFrame, timestamp: Column) -> DataFrame:
    """For each partition the first offset at or after a time."""
    return raw.where(F.col("timestamp") >= timestamp).groupBy("partition").agg(F.min("offset").alias("offset"))


def merge_topics(*topics: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Several topics as one; with ``sources`` a column ``source`` names each record's topic."""
    marked = [t.withColumn("source", F.lit(s)) for t, s in zip(topics, sources, strict=True)] if sources else list(topics)
    out = marked[0]
    for t in marked[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def topic_rows(df: DataFrame, key: str | None = None, camel: bool = True) -> DataFrame:
    """Rows as (key, value) records: JSON of all columns but those that begin with _, names in camel case."""

    def name(c: str) -> str:
        head, *tail = c.split("_")
        return head[:1].lower() + head[1:] + "".join(t[:1].upper() + t[1:] for t in tail) if camel else c

    value = F.to_json(F.struct(*(F.col(c).alias(name(c)) for c in df.columns if not c.startswith("_"))), {"ignoreNullFields": "false"})
    return df.select((F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), value.alias("value"))
