"""Files and generated rows as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None, delimiter: str = ",") -> DataFrame:
    """CSV with a header; rows of another width are dropped, columns are text unless a schema is given."""
    read = spark.read.option("header", True).option("sep", delimiter).option("mode", "DROPMALFORMED")
    return (read.schema(schema) if schema else read).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low=None, high=None, partitions: int = 8, **options: str) -> DataFrame:
    """A table of a database; with ``column`` and its range it is read in that many partitions at once."""
    read = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column is not None:
        read = read.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions))
    return read.load()


def json_rows(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON texts of a column as typed rows; texts that don't parse are dropped."""
    return df.select(F.from_json(column, schema).alias("r")).where("r is not null").select("r.*")


def incremental(df: DataFrame, column: str, last) -> DataFrame:
    """Rows after the last seen value of an increasing or timestamp column."""
    return df.where(F.col(column) > F.lit(last))


def generate(spark: SparkSession, rows: int, seed: int = 1) -> DataFrame:
    """Generated rows: id, a key of ten and a repeatable number."""
    return spark.range(rows).select("id", F.concat(F.lit("key"), (F.col("id") % 10).cast("string")).alias("key"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)).alias("number"))
