"""The corpus pipeline: toxicity filter, near-duplicate removal, repeat removal, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import length_buckets, repeats, shingle_join, toxicity
from millrace.llm.common import hinted, staged
from millrace.llm.queries import toxicity_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5."""
    docs = docs.select(*COLUMNS)
    return toxicity.add_score(docs, toxicity_model(spark, sf_dir, docs), out="toxic_score").where("toxic_score < 0.5").select(*COLUMNS)


def _one_of_each_text(docs: DataFrame) -> DataFrame:
    """``docs`` with a key ``id``: of rows with equal texts one of the least doc_id, null ids last; rows without a text are equal if their ids are.

    Ids that are null or stand at several texts are replaced in ``id`` by a hash of the text.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(-1))
    keyed = docs.withColumn("size", size).withColumn("h", F.when(F.col("size") > 0, F.xxhash64("text")).otherwise(F.xxhash64("doc_id", "size")))
    counted = keyed.groupBy("h", "size", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    equal = counted.groupBy("h", "size").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("lead"), F.sum("n").alias("n"))
    copied = staged(equal.where("n > 1").select("h", "size", F.col("lead.doc_id").alias("lead"), (F.col("lead.n") > 1).alias("again"), F.lit(True).alias("copied")), "pipeline-equal")
    marked = keyed.join(hinted(copied), ["h", "size"], "left").where("copied is null or doc_id <=> lead")
    again = F.coalesce("again", F.lit(False))
    rest = F.min(F.struct("lang", "source", "n_chars")).alias("rest")
    picked = marked.where(again).groupBy("doc_id", "h", "size").agg(F.first("text").alias("text"), rest).select("doc_id", "text", "rest.*", "h")
    single = staged(marked.where(~again).select(*COLUMNS, "h").unionByName(picked), "pipeline-texts")
    shared = staged(single.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("shared")), "pipeline-shared")
    own = F.when(F.col("doc_id").isNotNull() & F.col("shared").isNull(), F.col("doc_id")).otherwise(F.col("h"))
    return single.join(hinted(shared), "doc_id", "left").select(*COLUMNS, own.alias("id"), (F.col("doc_id").isNull() | F.col("shared").isNotNull()).alias("odd"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or linked texts the one row with the least id; rows without an id give way to others.

    Rows that repeat an id are told apart by their texts.
    """
    single = _one_of_each_text(docs.select(*COLUMNS))
    groups = shingle_join.near_duplicate_groups(single.select(F.col("id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "id")
    gone = staged(groups.where("component_id <> id").select("id", "component_id").distinct(), "pipeline-copies")
    odd = staged(single.where("odd").select("id", "doc_id", F.lit(True).alias("odd")), "pipeline-odd")
    if not odd.isEmpty():  # the least key of a group needn't be its least id
        members = gone.unionByName(gone.select(F.col("component_id").alias("id"), "component_id").distinct())
        known = members.join(hinted(odd), "id", "left").withColumn("real", F.when(F.col("odd").isNotNull(), F.col("doc_id")).otherwise(F.col("id")))
        kept = known.groupBy("component_id").agg(F.min(F.struct(F.col("real").isNull().alias("none"), "real", "id")).alias("least")).select(F.col("least.id").alias("id"))
        gone = staged(members.join(kept, "id", "left_anti"), "pipeline-copies")
    return single.join(gone, "id", "left_anti").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; a character that a cut splits goes whole."""
    cut = repeats.remove_repeats(docs.select(*COLUMNS), whole_characters=True)
    return cut.withColumn("text", F.make_valid_utf8("kept")).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of a token budget within length buckets of least padding."""
    return length_buckets.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", drop_repeats), ("packing", pack)]

#: Toxicity and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
