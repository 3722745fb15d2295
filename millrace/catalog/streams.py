"""Structured streaming, the SQL surface, materialized views, stores and templates of questions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import windows
from ..operators import cep
from ..plans import questions
from ..plans.query import Query, SessionStore, Store, WindowStore
from ..plans.sql import StreamingSql
from ..streaming import patterns, stateful
from ..streaming.dsl import Stream, Table
from ..session import scratch, table
from ..streaming.run import drain, replay
from . import query
from .events import _LATEST


def _sql(spark, sf, *names):
    engine = StreamingSql(spark)
    for n in names:
        engine.register(n, table(spark, sf, n))
    return engine


@query("sql_select", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus HAVING count(*) > 10 ORDER BY n LIMIT 5")
def sql_select(spark, sf):
    return _sql(spark, sf, "orders").execute("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus HAVING COUNT(*) > 10 ORDER BY n LIMIT 5;")


@query("sql_join_alias", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000")
def sql_join_alias(spark, sf):
    return _sql(spark, sf, "orders", "customer").execute("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000")


@query("sql_window_tumble", "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def sql_window_tumble(spark, sf):
    return _sql(spark, sf, "events").execute("SELECT window_start, window_end, event_type, COUNT(*) AS n FROM events WINDOW TUMBLE(ts, INTERVAL '1' HOUR) GROUP BY event_type EMIT CHANGES")


@query("sql_window_hop", "SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS s FROM events, generate_series(0, 1) t(i)) GROUP BY s")
def sql_window_hop(spark, sf):
    return _sql(spark, sf, "events").execute("SELECT window_start, window_end, COUNT(*) AS n FROM events WINDOW HOP(ts, 2 HOURS, 1 HOUR)")


@query("sql_window_session", "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM a) SELECT min(ts) AS window_start, user_id, count(*) AS n FROM b GROUP BY user_id, sid")
def sql_window_session(spark, sf):
    return _sql(spark, sf, "events").execute("SELECT window_start, user_id, COUNT(*) AS n FROM events WINDOW SESSION(ts, '30 m') GROUP BY user_id")


@query("sql_window_join", "SELECT date_trunc('day', ts) AS window_start, c_mktsegment, count(*) AS n FROM events e JOIN customer c ON e.user_id = c.c_custkey GROUP BY ALL")
def sql_window_join(spark, sf):
    return _sql(spark, sf, "events", "customer").execute("SELECT window_start, c_mktsegment, COUNT(*) AS n FROM events e JOIN customer c ON e.user_id = c.c_custkey WINDOW TUMBLE(ts, 1 DAY) GROUP BY c_mktsegment")


@query("sql_ctas_insert", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus = 'P'")
def sql_ctas_insert(spark, sf):
    engine = _sql(spark, sf, "orders")
    engine.execute("CREATE STREAM open_orders WITH (format='json') AS SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
    engine.execute("INSERT INTO open_orders SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
    return engine.execute("SELECT o_orderkey FROM open_orders")


@query("sql_dashed_topic", "SELECT n_name FROM nation WHERE n_regionkey = 1")
def sql_dashed_topic(spark, sf):
    engine = StreamingSql(spark, read_topic=lambda name: table(spark, sf, {"eu-nations": "nation"}[name]))
    return engine.execute("SELECT n_name FROM `eu-nations` WHERE n_regionkey = 1")


@query("mv_refresh", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def mv_refresh(spark, sf):
    engine = _sql(spark, sf, "orders")
    engine.execute("CREATE MATERIALIZED VIEW IF NOT EXISTS by_priority AS SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority")
    engine.views.refresh("BY_PRIORITY")
    return engine.execute("SELECT * FROM by_priority")


@query("mv_append_refresh", "SELECT 'before' AS seen, count(*) AS n FROM orders UNION ALL SELECT 'stale', count(*) FROM orders UNION ALL SELECT 'after', 2 * count(*) FROM orders")
def mv_append_refresh(spark, sf):
    """A view of a growing table: rows that come after a refresh show at the next one."""
    at = scratch(spark, "orders")
    keys = table(spark, sf, "orders").select("o_orderkey")
    keys.write.parquet(at)
    engine = StreamingSql(spark)
    engine.register("grown", lambda: spark.read.schema(keys.schema).parquet(at))
    engine.execute("CREATE MATERIALIZED VIEW counted AS SELECT COUNT(*) AS n FROM grown")
    engine.views.refresh("counted")
    seen = engine.execute("SELECT 'before' AS seen, n FROM counted")
    keys.write.mode("append").parquet(at)
    stale = engine.execute("SELECT 'stale' AS seen, n FROM counted")
    engine.views.refresh("counted")
    return seen.unionByName(stale).unionByName(engine.execute("SELECT 'after' AS seen, n FROM counted"))


@query("sql_insert_stores", "SELECT n_name FROM nation WHERE n_name LIKE 'A%' UNION ALL SELECT ' from nation ' FROM region")
def sql_insert_stores(spark, sf):
    engine = _sql(spark, sf, "nation", "region")
    engine.execute("CREATE TABLE names AS SELECT n_name FROM nation WHERE n_name LIKE 'A%'")
    engine.execute("INSERT INTO names SELECT ' from nation ' AS n_name FROM region")
    engine.register("nation", table(spark, sf, "nation").limit(0))
    return engine.execute("SELECT n_name FROM names")


@query("question_count", "SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY o_orderstatus")
def question_count(spark, sf):
    return _sql(spark, sf, "orders").execute(questions.guard(questions.to_sql("how many orders per o_orderstatus?")))


@query("question_top", "SELECT * FROM customer ORDER BY c_acctbal DESC LIMIT 10")
def question_top(spark, sf):
    return _sql(spark, sf, "customer").execute(questions.guard(questions.to_sql("Top 10 customer by c_acctbal")))


@query("query_where_skip_take", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20 OFFSET 10")
def query_where_skip_take(spark, sf):
    return Query(table(spark, sf, "orders")).where(F.col("o_orderstatus") == "F").select("o_orderkey").order_by("o_orderkey").skip(10).take(20).to_df()


@query("store_range", "SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 10 AND 40")
def store_range(spark, sf):
    return Store(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").range(10, 40)


@query("store_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def store_page(spark, sf):
    return Store(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").page(50, 25)


_DAYS = "SELECT user_id AS key, date_trunc('day', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL"


def _days(spark, sf):
    days = windows.tumble(table(spark, sf, "events"), "ts", "1 day", ["user_id"], F.count(F.lit(1)).alias("n"))
    return days.select(F.col("user_id").alias("key"), "window_start", "n")


@query("store_window_fetch", f"SELECT key, window_start, n FROM ({_DAYS}) WHERE window_start BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def store_window_fetch(spark, sf):
    store = WindowStore(_days(spark, sf).withColumn("n", F.lit(-1).cast("bigint"))).put(_days(spark, sf))
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp_ntz")
    return store.fetch_all(day(10), day(20))


@query("store_find_sessions", "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM a), s AS (SELECT user_id AS key, min(ts) AS window_start, max(ts) AS window_end, count(*) AS n FROM b GROUP BY user_id, sid) SELECT * FROM s WHERE key = 7 AND window_end >= TIMESTAMP '2024-01-05' AND window_start <= TIMESTAMP '2024-01-25'")
def store_find_sessions(spark, sf):
    found = windows.sessions(table(spark, sf, "events"), "ts", "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n"), with_gap=False)
    store = SessionStore(found.select(F.col("user_id").alias("key"), "window_start", "window_end", "n"))
    return store.find_sessions(7, F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz"))


@query("dsl_stream", "SELECT user_id, date_trunc('day', ts) AS window_start, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL")
def dsl_stream(spark, sf):
    s = Stream(table(spark, sf, "events"), "user_id").filter_not(F.col("event_type") == "error")
    return s.group_by_key().tumbling("1 day", F.count(F.lit(1)).alias("n")).drop("window_end")


@query("dsl_table_reference", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dsl_table_reference(spark, sf):
    return Table(table(spark, sf, "customer"), "c_custkey").join_reference(Table(table(spark, sf, "nation"), "n_nationkey"), "c_nationkey").df.select("c_custkey", "n_name")


@query("stream_tumble_complete", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumble_complete(spark, sf):
    s = windows.watermarked(replay(spark, sf, "events"), "ts", "1 hour")
    out = drain(windows.tumble(s, "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n")), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("stream_tumble_append", "SELECT date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_tumble_append(spark, sf):
    s = windows.watermarked(replay(spark, sf, "events"), "ts", "1 hour")
    out = drain(windows.tumble(s, "ts", "1 hour", [], F.count(F.lit(1)).alias("n")), "append")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("stream_session_complete", "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM a) SELECT user_id, min(ts) AS window_start, count(*) AS n FROM b GROUP BY user_id, sid")
def stream_session_complete(spark, sf):
    s = windows.watermarked(replay(spark, sf, "events"), "ts", "1 hour")
    out = drain(windows.sessions(s, "ts", "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n")), "complete")
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("stream_dedup_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_watermark(spark, sf):
    s = windows.watermarked(replay(spark, sf, "events"), "ts", "60 days")
    return drain(s.dropDuplicatesWithinWatermark(["user_id", "event_type"])).select("user_id", "event_type")


@query("stream_join_interval", "SELECT v.event_id AS v_id, p.event_id AS p_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts - INTERVAL 1 HOUR AND v.ts + INTERVAL 1 HOUR")
def stream_join_interval(spark, sf):
    from ..operators.joins import interval_join

    e = windows.watermarked(replay(spark, sf, "events"), "ts", "1 hour")
    v = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("v_ts"), F.col("event_id").alias("v_id"))
    p = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("p_id"))
    return drain(interval_join(v, p, ["user_id"], "v_ts", "p_ts", "1 hour", "1 hour").select("v_id", "p_id"))


@query("stream_table_lookup", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def stream_table_lookup(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return drain(replay(spark, sf, "events").join(c, "user_id").select("event_id", "c_name"))


@query("stream_latest_changes", f"SELECT CAST(key AS VARCHAR) AS key, CAST(v AS VARCHAR) AS new FROM ({_LATEST.format('view').replace('CASE WHEN value >= 5 THEN value END', 'event_id')})")
def stream_latest_changes(spark, sf):
    s = replay(spark, sf, "events").where("event_type = 'view'")
    return drain(stateful.latest_changes(s, "user_id", "event_id", "event_id"), "update").select("key", "new")


def _count_step(state, row):
    n = json.loads(state)["n"] + 1 if state else 1
    return json.dumps({"n": n}), str(n)


@query("stream_stateful_count", "SELECT user_id AS key, event_id AS ord, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR) AS output FROM events")
def stream_stateful_count(spark, sf):
    out = drain(stateful.transform_values(replay(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", _count_step), "update")
    return out.select(F.col("key").cast("bigint").alias("key"), "ord", "output")


def _tally(state, row):
    return str(int(state or 0) + 1), []


def _report(state, ms):
    return None, [state]


@query("stream_timers", "SELECT CAST(user_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS output, epoch_us(date_trunc('day', min(ts)) + INTERVAL 1 DAY) // 1000 AS ms FROM events GROUP BY user_id HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY < (SELECT max(ts) FROM events)")
def stream_timers(spark, sf):
    """One batch tallies each user; once the watermark passes the end of the user's first day, a timer reports the tally."""
    e = windows.watermarked(replay(spark, sf, "events").select("user_id", "ts"), "ts", "0 seconds")
    return drain(stateful.with_timers(e, "user_id", "ts", _tally, _report, "1 day"), "update")


@query("stream_cep", "WITH a AS (SELECT *, row_number() OVER w - row_number() OVER v AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id, event_type = 'click' ORDER BY ts, event_id)), b AS (SELECT user_id, event_id, g, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS k FROM a WHERE event_type = 'click') SELECT CAST(user_id AS VARCHAR) AS key, min(event_id) FILTER (k % 2 = 1) AS start_id, min(event_id) FILTER (k % 2 = 0) AS end_id, CAST(2 AS BIGINT) AS n_events FROM (SELECT *, (k + 1) // 2 AS pair FROM b) GROUP BY user_id, g, pair HAVING count(*) = 2")
def stream_cep(spark, sf):
    p = cep.Pattern.begin("a", F.col("event_type") == "click").times(2)
    return drain(patterns.match_stream(replay(spark, sf, "events"), p, "user_id", "ts", "event_id"), "update")


@query("stream_view_incremental", "SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY event_type")
def stream_view_incremental(spark, sf):
    s = replay(spark, sf, "events")
    return drain(s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")), "complete")


@query("stream_union", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def stream_union(spark, sf):
    s = replay(spark, sf, "events").select("event_id", "event_type")
    return drain(s.where("event_type = 'click'").unionByName(s.where("event_type = 'view'")).select("event_id"))


@query("udf_scalar", "SELECT n_nationkey, CAST(length(n_name) * 2 AS BIGINT) AS twice FROM nation")
def udf_scalar(spark, sf):
    from ..functions import udfs

    twice = udfs.scalar(lambda s: s.str.len() * 2, "bigint")
    return table(spark, sf, "nation").select("n_nationkey", twice("n_name").alias("twice"))


@query("udf_table", "SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def udf_table(spark, sf):
    from ..functions import udfs

    def words(batches):
        for b in batches:
            yield b.assign(word=b["n_name"].str.split(" ")).explode("word")[["n_nationkey", "word"]]

    return udfs.rows(table(spark, sf, "nation"), words, "n_nationkey int, word string")


@query("udf_aggregate", "SELECT n_regionkey, CAST(max(n_nationkey) - min(n_nationkey) AS BIGINT) AS span FROM nation GROUP BY n_regionkey")
def udf_aggregate(spark, sf):
    from ..functions import udfs

    return table(spark, sf, "nation").groupBy("n_regionkey").agg(udfs.aggregate(lambda v: int(v.max() - v.min()), "bigint")("n_nationkey").alias("span"))


@query("source_json_lines", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def source_json_lines(spark, sf):
    from ..sources.files import json_rows

    lines = table(spark, sf, "events").select(F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))).alias("value"))
    return json_rows(lines, "event_id bigint, k bigint")


@query("source_csv", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey FROM nation")
def source_csv(spark, sf):
    from ..sources.files import read_csv

    at = scratch(spark, "nation-csv")
    table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(at)
    return read_csv(spark, at, "n_nationkey bigint, n_name string, n_regionkey int")


@query("source_range", "SELECT CAST(i AS BIGINT) AS id FROM range(10, 100, 7) t(i)")
def source_range(spark, sf):
    return spark.range(10, 100, 7)


@query("source_incremental", "SELECT o_orderkey FROM orders WHERE o_orderkey > 1000")
def source_incremental(spark, sf):
    from ..sources.files import incremental

    return incremental(table(spark, sf, "orders"), "o_orderkey", 1000).select("o_orderkey")


@query("source_temp_view", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def source_temp_view(spark, sf):
    table(spark, sf, "nation").createOrReplaceTempView("millrace_nation")
    return spark.sql("SELECT n_name FROM millrace_nation WHERE n_regionkey = 2")


@query("topic_browse", "SELECT event_id FROM events ORDER BY event_id LIMIT 25 OFFSET 40")
def topic_browse(spark, sf):
    from ..sources.topics import browse, topic_of, topic_scan

    raw = topic_of(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", ["event_id"], "ts", partitions=1)
    return topic_scan(browse(raw, 0, 40, 25), "event_id bigint").select("event_id")


@query("sink_files_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_files_round_trip(spark, sf):
    n, at = table(spark, sf, "nation"), scratch(spark, "nation")
    n.write.partitionBy("n_regionkey").json(at)
    return spark.read.schema(n.schema).json(at)


@query("fn_map", "SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def fn_map(spark, sf):
    m = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    return table(spark, sf, "nation").select("n_nationkey", F.element_at(m, "name").alias("name"), F.map_values(m)[1].alias("region"))


@query("observe_peek", "SELECT count(*) AS n FROM orders")
def observe_peek(spark, sf):
    return Stream(table(spark, sf, "orders"), "o_custkey").peek("passing", F.count(F.lit(1)).alias("rows")).df.agg(F.count(F.lit(1)).alias("n"))


@query("repartition_by_key", "SELECT count(*) AS n FROM orders")
def repartition_by_key(spark, sf):
    return Stream(table(spark, sf, "orders"), "o_custkey").repartition(4).df.agg(F.count(F.lit(1)).alias("n"))
