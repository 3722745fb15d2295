"""Running streams to the end of what is there, for replays and tests; streams by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import SETTINGS, scratch


def replay(spark: SparkSession, directory: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    read = spark.readStream.schema(schema)
    if files_per_trigger:
        read = read.option("maxFilesPerTrigger", files_per_trigger)
    return read.option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has put out once its input is read: a table of the last result (complete) or of all output (append, update)."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    out, checkpoint = scratch(spark, "stream-out"), scratch(spark, "stream-state")

    wrote: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        """A batch that is tried again overwrites what it wrote."""
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/__batch={number}")
        wrote.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if not wrote:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


class Feed:
    """Drives one stream by hand, as a test does: put rows, move the clock on, read what comes out."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema = spark, schema
        self._in, self._checkpoint = scratch(spark, "feed-in"), scratch(spark, "feed-state")
        spark.createDataFrame([], schema).write.parquet(self._in)
        self.stream = spark.readStream.schema(schema).parquet(self._in)

    def put(self, *rows: tuple) -> None:
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self._in)

    def advance(self, column: str, time) -> None:
        """Moves the event clock on by a row that holds nothing but a time."""
        names = self.spark.createDataFrame([], self.schema).columns
        self.put(tuple(time if c == column else None for c in names))

    def read(self, output: DataFrame, mode: str = "append") -> list[Row]:
        """What ``output``, made of ``stream``, puts out for the rows since the last read."""
        out: list[Row] = []
        query = output.writeStream.outputMode(mode).option("checkpointLocation", self._checkpoint).foreachBatch(lambda batch, _: out.extend(batch.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        return out


class Topologies:
    """Streams by name, each built, started, described and stopped on its own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._build: dict[str, Callable[[SparkSession], DataFrame]] = {}
        self._running: dict[str, StreamingQuery] = {}

    def add(self, name: str, build: Callable[[SparkSession], DataFrame]) -> None:
        if name in self._build:
            raise ValueError(f"{name} exists")
        self._build[name] = build

    def describe(self, name: str) -> str:
        """The plan, as Spark formats it."""
        plan = self._build[name](self.spark)._jdf.queryExecution()
        return plan.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def start(self, name: str, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", **trigger) -> StreamingQuery:
        """Starts a stream, which finds its state again by its checkpoint."""
        out = self._build[name](self.spark).writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
        self._running[name] = (out.trigger(**trigger) if trigger else out).start()
        return self._running[name]

    def stop(self, name: str) -> None:
        self._running.pop(name).stop()

    def active(self) -> dict[str, bool]:
        return {n: n in self._running and self._running[n].isActive for n in self._build}
