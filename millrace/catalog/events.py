"""Time windows, joins in time, changelog tables and event patterns over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, cep, joins, tables, windows
from ..session import table
from ..sources import sinks, topics
from . import query

ORDER = ["ts", "event_id"]
SESSIONS = """WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM a) """


@query("tumble_event_stats", "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS top FROM events GROUP BY ALL")
def tumble_event_stats(spark, sf):
    return windows.tumble(table(spark, sf, "events"), "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top"))


@query("hop_event_counts", "SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS s FROM events, generate_series(0, 3) t(i)) GROUP BY s")
def hop_event_counts(spark, sf):
    return windows.hop(table(spark, sf, "events"), "ts", "1 hour", "15 minutes", [], F.count(F.lit(1)).alias("n"))


@query("session_user_activity", SESSIONS + "SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM b GROUP BY user_id, sid")
def session_user_activity(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "ts", "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n"))


@query("session_dsl_bounds", SESSIONS + "SELECT min(ts) AS window_start, max(ts) AS window_end, user_id, count(*) AS n FROM b GROUP BY user_id, sid")
def session_dsl_bounds(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "ts", "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n"), with_gap=False)


@query("tumble_aligned_week", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '0001-01-01') AS window_start, count(*) AS n FROM events GROUP BY 1")
def tumble_aligned_week(spark, sf):
    week = windows.tumble(table(spark, sf, "events"), "ts", "7 days", [], F.count(F.lit(1)).alias("n"), start=windows.aligned_start(7 * 86_400))
    return week.drop("window_end")


@query("sliding_user_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR FOLLOWING) AS n FROM events")
def sliding_user_count(spark, sf):
    return windows.sliding(table(spark, sf, "events"), "ts", 3600, ["user_id"], F.count(F.lit(1)), "n").select("event_id", "n")


@query("watermark_running", "SELECT event_id, epoch_us(max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) // 1000 - 5000 - 1 AS wm FROM events")
def watermark_running(spark, sf):
    return table(spark, sf, "events").select("event_id", windows.running_watermark("ts", ["event_id"], 5000, ["user_id"]).alias("wm"))


@query("late_split", "SELECT event_id, coalesce(ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR, false) AS is_late FROM events")
def late_split(spark, sf):
    return windows.late_split(table(spark, sf, "events"), "ts", ["event_id"], "1 hour", ["user_id"]).select("event_id", "is_late")


@query("suppress_until_close", "SELECT date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)")
def suppress_until_close(spark, sf):
    e = table(spark, sf, "events")
    return windows.closed_windows(windows.tumble(e, "ts", "1 hour", [], F.count(F.lit(1)).alias("n")), e, "ts", "2 days").select("window_start", "n")


@query("suppress_time_limit", "SELECT user_id, date_trunc('day', ts) AS interval_start, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def suppress_time_limit(spark, sf):
    return windows.last_in_interval(table(spark, sf, "events").select("user_id", "ts", "event_id"), "ts", "1 day", ["user_id"], ORDER).drop("ts")


@query("rate_limit", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 3")
def rate_limit(spark, sf):
    return windows.within_rate(table(spark, sf, "events"), "ts", "1 day", 3, ["user_id"], ORDER).select("event_id")


@query("dedup_first", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) = 1")
def dedup_first(spark, sf):
    from ..operators.nodes import deduplicate

    return deduplicate(table(spark, sf, "events"), ["user_id", "event_type"], "ts", "1 day", ORDER).select("event_id")


@query("dedup_last", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) = 1")
def dedup_last(spark, sf):
    from ..operators.nodes import deduplicate

    return deduplicate(table(spark, sf, "events"), ["user_id", "event_type"], "ts", "1 day", ORDER, keep="last").select("event_id")


def _of(spark, sf, kind, prefix):
    e = table(spark, sf, "events").where(F.col("event_type") == kind)
    return e.select("user_id", F.col("event_id").alias(f"{prefix}_id"), F.col("ts").alias(f"{prefix}_ts"))


@query("join_stream_stream", "SELECT v.user_id, v.event_id AS v_id, p.event_id AS p_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts - INTERVAL 1 HOUR AND v.ts + INTERVAL 1 HOUR")
def join_stream_stream(spark, sf):
    return joins.interval_join(_of(spark, sf, "view", "v"), _of(spark, sf, "purchase", "p"), ["user_id"], "v_ts", "p_ts", "1 hour", "1 hour").select("user_id", "v_id", "p_id")


@query("join_stream_stream_left", "SELECT v.event_id AS v_id, p.event_id AS p_id FROM (SELECT * FROM events WHERE event_type = 'view') v LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 2 HOUR")
def join_stream_stream_left(spark, sf):
    return joins.interval_join(_of(spark, sf, "view", "v"), _of(spark, sf, "purchase", "p"), ["user_id"], "v_ts", "p_ts", "0 hours", "2 hours", "leftOuter").select("v_id", "p_id")


@query("join_stream_stream_outer", "SELECT v.event_id AS v_id, p.event_id AS p_id FROM (SELECT * FROM events WHERE event_type = 'view') v FULL JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts - INTERVAL 1 HOUR AND v.ts + INTERVAL 3 HOUR")
def join_stream_stream_outer(spark, sf):
    return joins.interval_join(_of(spark, sf, "view", "v"), _of(spark, sf, "purchase", "p"), ["user_id"], "v_ts", "p_ts", "1 hour", "3 hours", "fullOuter").select("v_id", "p_id")


@query("join_asof", "SELECT p.event_id AS p_id, v.event_id AS v_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def join_asof(spark, sf):
    return joins.asof_join(_of(spark, sf, "purchase", "p"), _of(spark, sf, "view", "v"), ["user_id"], "p_ts", "v_ts", ["v_id"]).select("p_id", "v_id")


@query("join_one_to_one", "SELECT v.event_id AS v_id, p.event_id AS p_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view') v JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND v.n = p.n")
def join_one_to_one(spark, sf):
    return joins.one_to_one(_of(spark, sf, "view", "v"), _of(spark, sf, "purchase", "p"), ["user_id"], ["v_ts", "v_id"], ["p_ts", "p_id"]).select("v_id", "p_id")


@query("join_stream_table", "SELECT event_id, c_name FROM events LEFT JOIN customer ON user_id = c_custkey")
def join_stream_table(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return joins.lookup(table(spark, sf, "events"), c, ["user_id"], "left").select("event_id", "c_name")


def _changes(spark, sf, kind):
    e = table(spark, sf, "events").where(F.col("event_type") == kind)
    return e.select(F.col("user_id").alias("key"), F.when(F.col("value") >= 5, F.col("value")).alias("value"), F.col("event_id").alias("offset"))


_LATEST = "SELECT user_id AS key, CASE WHEN value >= 5 THEN value END AS v FROM events WHERE event_type = '{}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


@query("join_table_table", f"SELECT key, a.v AS left_value, b.v AS right_value FROM (SELECT * FROM ({_LATEST.format('view')}) WHERE v IS NOT NULL) a FULL JOIN (SELECT * FROM ({_LATEST.format('click')}) WHERE v IS NOT NULL) b USING (key)")
def join_table_table(spark, sf):
    return joins.table_join(_changes(spark, sf, "view"), _changes(spark, sf, "click"), "key", "offset", "full")


@query("join_foreign_key", "SELECT o_orderkey, c_name FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) LEFT JOIN customer ON o_custkey = c_custkey")
def join_foreign_key(spark, sf):
    last = tables.latest(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return joins.foreign_key_join(last, table(spark, sf, "customer"), "o_custkey", "c_custkey", "left").select("o_orderkey", "c_name")


@query("state_lookup", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM events")
def state_lookup(spark, sf):
    state = joins.last_state(table(spark, sf, "events"), ["user_id"], ORDER, F.when(F.col("event_type") == "signup", F.col("value")))
    return table(spark, sf, "events").select("event_id", state.alias("state"))


@query("state_lookup_ttl", "WITH s AS (SELECT event_id, ts, last_value(CASE WHEN event_type = 'signup' THEN {'v': value, 't': ts} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM events) SELECT event_id, CASE WHEN h.t + INTERVAL 6 HOUR > ts THEN h.v END AS state FROM s")
def state_lookup_ttl(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", joins.last_state(e, ["user_id"], ORDER, F.when(F.col("event_type") == "signup", F.col("value")), ("ts", "6 hours")).alias("state"))


@query("table_latest", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def table_latest(spark, sf):
    return tables.latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ORDER).select("user_id", "event_id", "value")


@query("compaction", f"SELECT key, v AS value FROM ({_LATEST.format('view')}) WHERE v IS NOT NULL")
def compaction(spark, sf):
    return tables.compact(_changes(spark, sf, "view")).select("key", "value")


@query("cdc_apply", "SELECT user_id AS id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def cdc_apply(spark, sf):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), op.alias("op"), F.col("event_id").alias("lsn"), F.struct("value").alias("after"))
    return tables.apply_changes(e, ["id"])


@query("kv_history", "SELECT user_id AS key, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS revision FROM events")
def kv_history(spark, sf):
    return tables.history(table(spark, sf, "events").select(F.col("user_id").alias("key"), "event_id"), "key", "event_id")


@query("ttl_live", "SELECT event_id FROM events WHERE ts + INTERVAL 5 DAY > TIMESTAMP '2024-01-20'")
def ttl_live(spark, sf):
    return tables.live(table(spark, sf, "events"), "ts", "5 days", F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


@query("table_retract_aggregate", "SELECT event_type, count(*) AS n FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) GROUP BY event_type")
def table_retract_aggregate(spark, sf):
    return aggregates.table_aggregate(table(spark, sf, "events"), "user_id", "event_id", "event_type", F.count(F.lit(1)).alias("n"))


@query("cep_next", "SELECT * FROM (SELECT user_id, event_id AS a_id, lead(event_id) OVER w AS b_id, event_type AS t, lead(event_type) OVER w AS t2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, a_id, b_id WHERE t = 'view' AND t2 = 'click'".replace("SELECT * FROM (", "FROM (", 1))
def cep_next(spark, sf):
    kind = F.col("event_type")
    p = cep.Pattern.begin("a", kind == "view").next("b", kind == "click")
    return cep.match(table(spark, sf, "events"), p, ["user_id"], "ts", ORDER, "event_id").select("user_id", "a_id", "b_id")


_FIRST = "first_value(CASE WHEN event_type = '{}' THEN {} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


@query("cep_followed_by", f"FROM (SELECT user_id, event_type, event_id AS a_id, {_FIRST.format('purchase', 'event_id')} AS b_id FROM events) SELECT user_id, a_id, b_id WHERE event_type = 'view' AND b_id IS NOT NULL")
def cep_followed_by(spark, sf):
    kind = F.col("event_type")
    p = cep.Pattern.begin("a", kind == "view").followed_by("b", kind == "purchase")
    return cep.match(table(spark, sf, "events"), p, ["user_id"], "ts", ORDER, "event_id").select("user_id", "a_id", "b_id")


@query("cep_within", f"FROM (SELECT user_id, ts, event_type, event_id AS a_id, {_FIRST.format('purchase', 'event_id')} AS b_id, {_FIRST.format('purchase', 'ts')} AS b_ts FROM events) SELECT user_id, a_id, b_id WHERE event_type = 'view' AND b_ts <= ts + INTERVAL 2 HOUR")
def cep_within(spark, sf):
    kind = F.col("event_type")
    p = cep.Pattern.begin("a", kind == "view").followed_by("b", kind == "purchase").within("2 hours")
    return cep.match(table(spark, sf, "events"), p, ["user_id"], "ts", ORDER, "event_id").select("user_id", "a_id", "b_id")


@query("cep_three_steps", f"WITH m AS (SELECT user_id, event_type, event_id, {_FIRST.format('purchase', 'event_id')} AS c_id, lead(event_type) OVER w AS t2, lead(event_id) OVER w AS b_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT x.user_id, x.event_id AS a_id, x.b_id, y.c_id FROM m x JOIN m y ON y.event_id = x.b_id WHERE x.event_type = 'view' AND x.t2 = 'click' AND y.c_id IS NOT NULL")
def cep_three_steps(spark, sf):
    kind = F.col("event_type")
    p = cep.Pattern.begin("a", kind == "view").next("b", kind == "click").followed_by("c", kind == "purchase")
    return cep.match(table(spark, sf, "events"), p, ["user_id"], "ts", ORDER, "event_id").select("user_id", "a_id", "b_id", "c_id")


@query("cep_not_next", "FROM (SELECT user_id, event_type, event_id AS a_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t2 FROM events) SELECT user_id, a_id WHERE event_type = 'view' AND coalesce(t2 <> 'click', true)")
def cep_not_next(spark, sf):
    kind = F.col("event_type")
    return cep.match(table(spark, sf, "events"), cep.Pattern.begin("a", kind == "view").not_next("b", kind == "click"), ["user_id"], "ts", ORDER, "event_id").select("user_id", "a_id")


@query("cep_not_followed_by", "SELECT user_id, event_id AS a_id FROM events a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id)) AND b.ts <= a.ts + INTERVAL 1 DAY)")
def cep_not_followed_by(spark, sf):
    kind = F.col("event_type")
    p = cep.Pattern.begin("a", kind == "view").not_followed_by("b", kind == "purchase").within("1 day")
    return cep.match(table(spark, sf, "events"), p, ["user_id"], "ts", ORDER, "event_id").select("user_id", "a_id")


@query("cep_followed_by_any", "SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id)) AND b.ts <= a.ts + INTERVAL 1 DAY")
def cep_followed_by_any(spark, sf):
    kind = F.col("event_type")
    return cep.match_any(table(spark, sf, "events"), kind == "view", kind == "purchase", ["user_id"], "ts", "event_id", "1 day")


@query("cep_times", "WITH a AS (SELECT *, row_number() OVER w - row_number() OVER v AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id, event_type = 'click' ORDER BY ts, event_id)), b AS (SELECT user_id, event_id, g, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS k FROM a WHERE event_type = 'click') SELECT user_id, min(event_id) FILTER (k % 2 = 1) AS start_id, min(event_id) FILTER (k % 2 = 0) AS end_id, CAST(2 AS BIGINT) AS n_events FROM (SELECT *, (k + 1) // 2 AS pair FROM b) GROUP BY user_id, g, pair HAVING count(*) = 2")
def cep_times(spark, sf):
    p = cep.Pattern.begin("a", F.col("event_type") == "click").times(2)
    return cep.match_quantified(table(spark, sf, "events"), p, ["user_id"], "ts", ORDER, "event_id")


@query("cep_one_or_more", "WITH a AS (SELECT *, row_number() OVER w - row_number() OVER v AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id, event_type = 'click' ORDER BY ts, event_id)) SELECT user_id, arg_min(event_id, (ts, event_id)) AS start_id, arg_max(event_id, (ts, event_id)) AS end_id, count(*) AS n_events FROM a WHERE event_type = 'click' GROUP BY user_id, g")
def cep_one_or_more(spark, sf):
    p = cep.Pattern.begin("a", F.col("event_type") == "click").one_or_more()
    return cep.match_quantified(table(spark, sf, "events"), p, ["user_id"], "ts", ORDER, "event_id")


_RUNS = "WITH RECURSIVE a AS (SELECT *, row_number() OVER w - row_number() OVER v AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id, event_type = 'click' ORDER BY ts, event_id)), c AS (SELECT user_id, g, ts, event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id, g) AS m FROM a WHERE event_type = 'click')"


@query("cep_one_or_more_within", _RUNS + ", n AS (SELECT x.user_id, x.g, x.k, x.m, x.event_id, coalesce(min(y.k), any_value(x.m) + 1) AS nxt FROM c x LEFT JOIN c y ON x.user_id = y.user_id AND x.g = y.g AND y.ts > x.ts + INTERVAL 12 HOUR AND y.k > x.k GROUP BY x.user_id, x.g, x.k, x.m, x.event_id), r AS (SELECT * FROM n WHERE k = 1 UNION ALL SELECT n.* FROM r JOIN n ON n.user_id = r.user_id AND n.g = r.g AND n.k = r.nxt) SELECT r.user_id, r.event_id AS start_id, e.event_id AS end_id, CAST(r.nxt - r.k AS BIGINT) AS n_events FROM r JOIN n e ON e.user_id = r.user_id AND e.g = r.g AND e.k = r.nxt - 1")
def cep_one_or_more_within(spark, sf):
    p = cep.Pattern.begin("a", F.col("event_type") == "click").one_or_more().within("12 hours")
    return cep.match_quantified(table(spark, sf, "events"), p, ["user_id"], "ts", ORDER, "event_id")


@query("cep_after_match_next", _RUNS + " SELECT user_id, event_id AS start_id, last_value(event_id) OVER (PARTITION BY user_id, g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS end_id, CAST(m - k + 1 AS BIGINT) AS n_events FROM c")
def cep_after_match_next(spark, sf):
    p = cep.Pattern.begin("a", F.col("event_type") == "click").one_or_more()
    return cep.match_quantified(table(spark, sf, "events"), p, ["user_id"], "ts", ORDER, "event_id", "to_next")


@query("cep_relaxed_repeats", "WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'), c AS (SELECT v.user_id, v.event_id AS start_id, e.event_id, row_number() OVER (PARTITION BY v.user_id, v.event_id ORDER BY e.ts, e.event_id) AS k FROM v JOIN events e ON e.user_id = v.user_id AND e.event_type = 'click' AND (e.ts > v.ts OR (e.ts = v.ts AND e.event_id > v.event_id))) SELECT user_id, start_id, event_id AS end_id, CAST(3 AS BIGINT) AS n_events FROM c WHERE k = 2")
def cep_relaxed_repeats(spark, sf):
    p = cep.Pattern.begin("a", F.col("event_type") == "signup").followed_by("b", F.col("event_type") == "click").times(2)
    return cep.match_quantified(table(spark, sf, "events"), p, ["user_id"], "ts", ORDER, "event_id", "no_skip")


_SOURCES = ("click", "view", "purchase", "signup", "error")
_TOP = "max(CASE WHEN event_type = '{0}' THEN ms END) OVER w AS t_{0}"
_ALIVE = "CASE WHEN t_{0} >= ms - 172800000 THEN t_{0} END"


@query("watermark_idle_sources", "SELECT event_id, max(least(" + ", ".join(_ALIVE.format(s) for s in _SOURCES) + ")) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1001 AS watermark FROM (SELECT *, " + ", ".join(_TOP.format(s) for s in _SOURCES) + " FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))")
def watermark_idle_sources(spark, sf):
    """Each user's events from five sources: a source that was silent for two days holds nothing back."""
    return windows.combined_watermark(table(spark, sf, "events"), "ts", "event_type", list(_SOURCES), ["user_id"], ORDER, 1000, 2 * 86_400_000, "watermark").select("event_id", "watermark")


@query("topic_scan", "SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS _offset, CAST(user_id AS VARCHAR) AS _key, event_id, event_type FROM events")
def topic_scan(spark, sf):
    raw = topics.topic_of(table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", ["event_id"], "ts", partitions=1)
    return topics.topic_scan(raw, "event_id bigint, event_type string").select("_offset", "_key", "event_id", "event_type")


@query("topic_offset_range", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS o FROM events) WHERE o >= 100 AND o < 200")
def topic_offset_range(spark, sf):
    raw = topics.topic_of(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", ["event_id"], "ts", partitions=1)
    return topics.topic_scan(topics.offset_range(raw, 0, 100, 200), "event_id bigint").select("event_id")


@query("topic_offset_for_time", "SELECT CAST(min(o) AS BIGINT) AS \"offset\" FROM (SELECT ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS o FROM events) WHERE ts >= TIMESTAMP '2024-01-15'")
def topic_offset_for_time(spark, sf):
    raw = topics.topic_of(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", ORDER, "ts", partitions=1)
    return topics.offset_for_time(raw, F.lit("2024-01-15").cast("timestamp_ntz")).select("offset")


@query("sink_topic_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS key, '{\"oOrderkey\":' || o_orderkey || ',\"oOrderstatus\":\"' || o_orderstatus || '\"}' AS value FROM orders")
def sink_topic_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("_hidden"))
    return topics.topic_rows(o, "o_orderkey")


@query("sink_routing", "SELECT event_id, 'events-' || event_type AS topic FROM events WHERE event_type <> 'error'")
def sink_routing(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return sinks.route(e, F.when(F.col("event_type") != "error", F.concat(F.lit("events-"), "event_type"))).select("event_id", "topic")


def _upsert(spark, sf, strategy):
    """All customers; new rows are those of customers with orders, their balance changed, and all suppliers under negative keys."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    changed = F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1000).otherwise(F.col("c_acctbal") - 1000).alias("c_acctbal")
    buyers = c.join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", changed)
    fresh = table(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return sinks.upsert(c, buyers.unionByName(fresh), ["c_custkey"], strategy, "c_acctbal")


_UP = "CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1000 ELSE c_acctbal - 1000 END"
_BUYER = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"
_FRESH = " UNION ALL SELECT -1 - s_suppkey, s_acctbal FROM supplier"


@query("upsert_update", f"SELECT c_custkey, CASE WHEN {_BUYER} THEN {_UP} ELSE c_acctbal END AS c_acctbal FROM customer{_FRESH}")
def upsert_update(spark, sf):
    return _upsert(spark, sf, "insert_or_update")


@query("upsert_skip", f"SELECT c_custkey, c_acctbal FROM customer{_FRESH}")
def upsert_skip(spark, sf):
    return _upsert(spark, sf, "insert_or_skip")


@query("upsert_newer", f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND {_BUYER} THEN c_acctbal + 1000 ELSE c_acctbal END AS c_acctbal FROM customer{_FRESH}")
def upsert_newer(spark, sf):
    return _upsert(spark, sf, "insert_or_update_if_newer")


@query("upsert_replace", "SELECT c_custkey, " + _UP + " AS c_acctbal FROM customer WHERE " + _BUYER + _FRESH)
def upsert_replace(spark, sf):
    return _upsert(spark, sf, "replace")


@query("upsert_fail", f"SELECT c_custkey, c_acctbal FROM customer{_FRESH}")
def upsert_fail(spark, sf):
    """New keys only, so nothing fails; a known key fails the job (a test shows it)."""
    fresh = table(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return sinks.upsert(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), fresh, ["c_custkey"], "insert_or_fail")


def _upsert_whole(spark, sf, strategy):
    """Each customer's latest order as the target, all customers as new rows; customers without orders are inserted."""
    o = table(spark, sf, "orders")
    target = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("c_acctbal"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return sinks.upsert(target, rows, ["c_custkey"], strategy, "c_acctbal")


_UP_WHOLE = "WITH t AS (SELECT o_custkey AS c_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS b FROM orders GROUP BY o_custkey) SELECT c_custkey, {} AS c_acctbal FROM customer c FULL JOIN t USING (c_custkey)"


@query("upsert_update_whole", _UP_WHOLE.format("CASE WHEN c.c_name IS NULL THEN b ELSE c_acctbal END"))
def upsert_update_whole(spark, sf):
    return _upsert_whole(spark, sf, "insert_or_update")


@query("upsert_skip_whole", _UP_WHOLE.format("coalesce(b, c_acctbal)"))
def upsert_skip_whole(spark, sf):
    return _upsert_whole(spark, sf, "insert_or_skip")


@query("upsert_newer_whole", _UP_WHOLE.format("CASE WHEN b IS NULL OR c_acctbal > b THEN c_acctbal ELSE b END"))
def upsert_newer_whole(spark, sf):
    return _upsert_whole(spark, sf, "insert_or_update_if_newer")


@query("dead_letters", "SELECT doc_id, 'not a number' AS error FROM documents WHERE TRY_CAST(substr(source, 4) AS INT) IS NULL OR substr(source, 4) = '3'")
def dead_letters(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.nullif(F.substring("source", 4, 9), F.lit("3")).alias("s"))
    return sinks.dead_letters(docs, F.col("s").try_cast("int"), "not a number")[1].select("doc_id", "error")


@query("idempotent_sink", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def idempotent_sink(spark, sf):
    return sinks.once(table(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"])
