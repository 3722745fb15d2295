"""Ranking, analytic and framed window functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates
from ..session import table
from . import query


@query("win_rank_family", "SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER p AS INT) AS rk, CAST(dense_rank() OVER p AS INT) AS dr, round(percent_rank() OVER p, 9) AS pr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def win_rank_family(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(p).alias("rk"), F.dense_rank().over(p).alias("dr"), F.round(F.percent_rank().over(p), 9).alias("pr"))


@query("win_ntile", "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS q FROM orders")
def win_ntile(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.ntile(4).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("q"))


@query("win_lag_lead", "SELECT event_id, lag(value, 1, -1.0) OVER w AS prev, lead(value, 2) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag_lead(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.lag("value", 1, -1.0).over(w).alias("prev"), F.lead("value", 2).over(w).alias("next"))


@query("win_frame_rows", "SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def win_frame_rows(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 1)
    return table(spark, sf, "events").select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.round(F.avg("value").over(w), 6).alias("mean"))


@query("win_frame_range", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM part")
def win_frame_range(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.count(F.lit(1)).over(Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, Window.currentRow)).alias("n"))


@query("win_aggregate_over", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")
def win_aggregate_over(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.max("o_totalprice").over(Window.partitionBy("o_custkey")).alias("top"))


@query("agg_running_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
def agg_running_count(spark, sf):
    return aggregates.running(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.count(F.lit(1)), "n").select("event_id", "n")


@query("agg_running_reduce", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS top FROM events")
def agg_running_reduce(spark, sf):
    return aggregates.running(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.max("value"), "top").select("event_id", "top")


@query("agg_batch_accumulator", "SELECT user_id, (rn // 10) AS batch_id, count(*) AS batch_size, string_agg(event_id::VARCHAR, ',' ORDER BY rn) AS items FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events) GROUP BY 1, 2")
def agg_batch_accumulator(spark, sf):
    out = aggregates.accumulate(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 10, "event_id")
    return out.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query("agg_count_trigger", "SELECT user_id, (rn // 5) AS batch_id, count(*) AS n, max(value) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events) GROUP BY 1, 2")
def agg_count_trigger(spark, sf):
    return aggregates.batches(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 5).groupBy("user_id", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
