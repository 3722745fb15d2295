"""Pipeline nodes, routing and workflow over JSON records made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditions
from ..functions import dialect as d
from ..operators import nodes, schemas
from ..session import table
from . import query

VALUE = "'{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}'"
SCHEMA = "id bigint, kind string, user bigint"


def _records(spark, sf):
    e = table(spark, sf, "events")
    value = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    return nodes.records(e, F.col("user_id"), value, "in", F.col("ts"))


def _kv(df):
    return df.select("key", "value")


@query("node_filter", f"SELECT CAST(user_id AS VARCHAR) AS key, {VALUE} AS value FROM events WHERE event_type = 'click'")
def node_filter(spark, sf):
    return _kv(nodes.filter_node(_records(spark, sf), "$.kind == click"))


@query("node_filter_negated", f"SELECT CAST(user_id AS VARCHAR) AS key, {VALUE} AS value FROM events WHERE NOT (user_id > 50)")
def node_filter_negated(spark, sf):
    return _kv(nodes.filter_node(_records(spark, sf), "$.user > 50", negate=True))


@query("node_condition_text", "SELECT event_id FROM events WHERE contains(event_type, 'i') OR starts_with(event_type, 'pur')")
def node_condition_text(spark, sf):
    r = _records(spark, sf).where(conditions.condition("$.kind contains I") | conditions.condition("$.kind startsWith PUR"))
    return r.select(F.get_json_object("value", "$.id").cast("bigint").alias("event_id"))


@query("typed_predicate", "SELECT event_id FROM events WHERE (value > 5 AND event_type <> 'error') OR user_id = 7")
def typed_predicate(spark, sf):
    f = conditions.Field
    return table(spark, sf, "events").where(((f("value") > 5) & (f("event_type") != "error")) | (f("user_id") == 7)).select("event_id")


@query("node_map", "SELECT CAST(user_id AS VARCHAR) AS key, '{\"what\":\"' || event_type || '\",\"src\":\"web\"}' AS value FROM events")
def node_map(spark, sf):
    return _kv(nodes.map_node(_records(spark, sf), {"what": "$.kind", "src": "'web'"}))


@query("node_replace_field", "SELECT CAST(user_id AS VARCHAR) AS key, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS value FROM events")
def node_replace_field(spark, sf):
    return _kv(nodes.replace_field(_records(spark, sf), exclude=["user"], rename={"kind": "type"}))


@query("node_insert_field", "SELECT CAST(user_id AS VARCHAR) AS key, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\",\"user\":' || user_id || ',\"topic\":\"in\",\"static\":1}' AS value FROM events")
def node_insert_field(spark, sf):
    return _kv(nodes.insert_field(_records(spark, sf), {"topic": F.col("topic"), "static": F.lit(1)}, SCHEMA))


@query("node_extract_field", "SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value FROM events")
def node_extract_field(spark, sf):
    return _kv(nodes.extract_field(_records(spark, sf), "$.kind"))


@query("node_hoist_field", f"SELECT CAST(user_id AS VARCHAR) AS key, '{{\"event\":' || {VALUE} || '}}' AS value FROM events")
def node_hoist_field(spark, sf):
    return _kv(nodes.hoist_field(_records(spark, sf), "event", SCHEMA))


@query("node_flatten", "SELECT CAST(user_id AS VARCHAR) AS key, '{\"event.id\":' || event_id || ',\"event.kind\":\"' || event_type || '\",\"event.user\":' || user_id || '}' AS value FROM events")
def node_flatten(spark, sf):
    return _kv(nodes.flatten(nodes.hoist_field(_records(spark, sf), "event", SCHEMA), f"event struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>"))


@query("node_cast", "SELECT CAST(user_id AS VARCHAR) AS key, '{\"id\":\"' || event_id || '\",\"kind\":true,\"user\":' || user_id || '}' AS value FROM events")
def node_cast(spark, sf):
    return _kv(nodes.cast_node(_records(spark, sf), {"id": "string", "kind": "boolean", "user": "int32"}, SCHEMA))


@query("node_mask_field", "SELECT CAST(user_id AS VARCHAR) AS key, '{\"id\":' || event_id || ',\"kind\":\"***\",\"user\":0}' AS value FROM events")
def node_mask_field(spark, sf):
    return _kv(nodes.mask_field(_records(spark, sf), ["kind", "user"], SCHEMA, "***"))


@query("node_value_to_key", f"SELECT '{{\"kind\":\"' || event_type || '\",\"user\":\"' || user_id || '\"}}' AS key, {VALUE} AS value FROM events")
def node_value_to_key(spark, sf):
    return _kv(nodes.value_to_key(_records(spark, sf), ["kind", "user"]))


@query("node_header_from", "SELECT '{\"id\":' || event_id || ',\"user\":' || user_id || '}' AS value, event_type AS h FROM events")
def node_header_from(spark, sf):
    return nodes.header_from(_records(spark, sf), {"kind": "k"}, move=True).select("value", F.col("headers")["k"].alias("h"))


@query("node_header_to", "SELECT '{\"id\":' || event_id || ',\"user\":' || user_id || ',\"kind2\":\"' || event_type || '\"}' AS value FROM events")
def node_header_to(spark, sf):
    return nodes.header_to(nodes.header_from(_records(spark, sf), {"kind": "k"}, move=True), {"k": "kind2"}).select("value")


@query("node_schema_decode", "SELECT event_id AS schema_id, event_type AS value FROM events")
def node_schema_decode(spark, sf):
    framed = F.concat(F.lit(b"\x00"), F.unhex(F.lpad(F.hex("event_id"), 8, "0")), F.col("event_type").cast("binary"))
    return nodes.schema_decode(table(spark, sf, "events").select(framed.alias("message"))).select("schema_id", "value")


@query("node_schema_filter", "SELECT event_type AS value FROM events WHERE event_id IN (1, 2, 3)")
def node_schema_filter(spark, sf):
    framed = F.concat(F.lit(b"\x00"), F.unhex(F.lpad(F.hex("event_id"), 8, "0")), F.col("event_type").cast("binary"))
    return nodes.schema_filter(nodes.schema_decode(table(spark, sf, "events").select(framed.alias("message"))), [1, 2, 3]).select("value")


@query("node_inspect", f"SELECT '{{\"key\":\"' || user_id || '\",\"value\":\"' || replace({VALUE}, '\"', '\\\"') || '\"}}' AS value FROM events")
def node_inspect(spark, sf):
    return nodes.inspect(_records(spark, sf), "compact").select("value")


@query("node_split", "SELECT '{\"id\":' || event_id || ',\"item\":\"' || event_type || '\",\"_index\":0}' AS value FROM events UNION ALL SELECT '{\"id\":' || event_id || ',\"item\":' || user_id || ',\"_index\":1}' FROM events")
def node_split(spark, sf):
    e = table(spark, sf, "events")
    value = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"items":["'), F.col("event_type"), F.lit('",'), F.col("user_id").cast("string"), F.lit("]}"))
    return nodes.split(nodes.records(e, F.col("user_id"), value), "$.items", keep_parent=True).select("value")


@query("node_timestamp_converter", "SELECT '{\"id\":' || event_id || ',\"t\":' || CAST(epoch_ms(date_trunc('second', ts)) // 1000 AS BIGINT) || '}' AS value FROM events")
def node_timestamp_converter(spark, sf):
    e = table(spark, sf, "events")
    value = F.to_json(F.struct(F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t")))
    return nodes.convert_timestamp(nodes.records(e, F.col("user_id"), value), "t", "unix", "id bigint, t bigint").select("value")


@query("node_if", "SELECT event_id, CASE WHEN user_id >= 50 THEN 'high' ELSE 'low' END AS topic FROM events")
def node_if(spark, sf):
    return nodes.if_node(_records(spark, sf), "$.user >= 50", "high", "low").select(F.get_json_object("value", "$.id").cast("bigint").alias("event_id"), "topic")


@query("node_switch", "SELECT event_id, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE 'rest' END AS topic FROM events")
def node_switch(spark, sf):
    return nodes.switch(_records(spark, sf), "$.kind", {"CLICK": "c", "View": "v"}, "rest").select(F.get_json_object("value", "$.id").cast("bigint").alias("event_id"), "topic")


@query("node_multi_output", "SELECT event_id, 'all' AS topic FROM events UNION ALL SELECT event_id, 'clicks' FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'big' FROM events WHERE user_id > 100")
def node_multi_output(spark, sf):
    out = nodes.multi_output(_records(spark, sf), {"all": None, "clicks": "$.kind == click", "big": "$.user > 100"})
    return out.select(F.get_json_object("value", "$.id").cast("bigint").alias("event_id"), "topic")


@query("branch_independent", "SELECT event_id, 1 AS branch FROM events WHERE value > 5 UNION ALL SELECT event_id, 2 FROM events WHERE event_type = 'click'")
def branch_independent(spark, sf):
    a, b = nodes.branch(table(spark, sf, "events"), F.col("value") > 5, F.col("event_type") == "click")
    return a.select("event_id", F.lit(1).alias("branch")).union(b.select("event_id", F.lit(2)))


@query("node_regex_router", "SELECT event_id, 'out-' || event_type AS topic FROM events")
def node_regex_router(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("in-"), "event_type").alias("topic"))
    return nodes.regex_router(e, "^in-(.*)$", "out-$1")


@query("node_timestamp_router", "SELECT event_id, 'in-' || strftime(ts, '%Y%m%d') AS topic FROM events")
def node_timestamp_router(spark, sf):
    return nodes.timestamp_router(table(spark, sf, "events").select("event_id", "ts", F.lit("in").alias("topic")), "ts").select("event_id", "topic")


@query("node_priority", "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id // 100 ORDER BY user_id DESC, event_id) AS INT) AS place FROM events")
def node_priority(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_json(F.struct("user_id")).alias("value"))
    return nodes.priority(e, "user_id", 0.0, F.floor(F.col("event_id") / 100), ["event_id"]).select("event_id", "place")


@query("node_repartition_round_robin", "SELECT s_suppkey, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) % 4 AS INT) AS partition FROM supplier")
def node_repartition_round_robin(spark, sf):
    return nodes.repartition(table(spark, sf, "supplier").select("s_suppkey"), 4, "round_robin", order=["s_suppkey"])


@query("node_repartition_key")
def node_repartition_key(spark, sf):
    return nodes.repartition(_records(spark, sf), 8, "field", field="user").groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


GATES = "SELECT ts, event_id, CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END AS o FROM events"


@query("node_gate_drop", f"FROM (SELECT event_id, event_type, coalesce(last_value(o IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), true) AS is_open FROM ({GATES}) JOIN events USING (event_id, ts)) SELECT event_id WHERE event_type = 'view' AND is_open")
def node_gate_drop(spark, sf):
    e = table(spark, sf, "events")
    signals = e.where("event_type in ('signup', 'error')").select("ts", (F.col("event_type") == "signup").alias("is_open"))
    return nodes.gate(e.where("event_type = 'view'").select("event_id", "ts"), signals, "ts", buffer=False).select("event_id")


@query("node_gate_buffer", f"FROM (SELECT event_id, event_type, ts, coalesce(last_value(o IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), true) AS is_open, min(CASE WHEN o THEN ts END) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opens FROM ({GATES}) JOIN events USING (event_id, ts)) SELECT event_id, CASE WHEN is_open THEN ts ELSE opens END AS released_at WHERE event_type = 'view' AND (is_open OR opens IS NOT NULL)")
def node_gate_buffer(spark, sf):
    e = table(spark, sf, "events")
    signals = e.where("event_type in ('signup', 'error')").select("ts", (F.col("event_type") == "signup").alias("is_open"))
    return nodes.gate(e.where("event_type = 'view'").select("event_id", "ts"), signals, "ts").select("event_id", "released_at")


@query("node_wait_for_input", "SELECT v.event_id AS v_id, p.event_id AS p_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts - INTERVAL 30 MINUTE AND v.ts + INTERVAL 30 MINUTE")
def node_wait_for_input(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    pairs, _ = nodes.wait_for_input(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "ts", "30 minutes")
    return pairs.select(F.col("event_id").alias("v_id"), F.col("other.event_id").alias("p_id"))


@query("node_wait_timeout", "SELECT event_id FROM events v WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events p WHERE v.user_id = p.user_id AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts - INTERVAL 30 MINUTE AND v.ts + INTERVAL 30 MINUTE)")
def node_wait_timeout(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return nodes.wait_for_input(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "ts", "30 minutes")[1].select("event_id")


@query("node_loop", "SELECT o_orderkey, o_orderkey + 3 AS x FROM orders")
def node_loop(spark, sf):
    return nodes.loop(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("x")), lambda df: df.withColumn("x", F.col("x") + 1), 3)


@query("pipeline_spec", "SELECT event_id, 'big-clicks' AS topic FROM events WHERE event_type = 'click' AND user_id > 50")
def pipeline_spec(spark, sf):
    from ..plans.pipelines import Pipeline

    spec = {
        "nodes": [
            {"id": "clicks", "type": "filter", "test": "$.kind == click"},
            {"id": "big", "type": "filter", "after": ["clicks"], "test": "$.user > 50"},
            {"id": "route", "type": "if", "after": ["big"], "test": "$.user > 0", "true_topic": "big-clicks", "false_topic": "none"},
        ]
    }
    return Pipeline(spec).run(_records(spark, sf)).select(F.get_json_object("value", "$.id").cast("bigint").alias("event_id"), "topic")


@query("schema_migrate", "SELECT n_nationkey AS id, CAST(n_regionkey AS VARCHAR) AS region, 'new' AS flag FROM nation")
def schema_migrate(spark, sf):
    return schemas.migrate(table(spark, sf, "nation"), [("rename", "n_nationkey", "id"), ("rename", "n_regionkey", "region"), ("cast", "region", "string"), ("remove", "n_name"), ("add", "flag", "string", "new")])


@query("schema_infer", "SELECT 'struct<k:bigint>' AS found")
def schema_infer(spark, sf):
    found = schemas.infer(table(spark, sf, "events"), "props")
    return spark.range(1).select(F.lit(found.simpleString()).alias("found"))


@query("schema_compatible", "SELECT * FROM (VALUES ('backward', true), ('forward', false), ('full', false), ('none', true)) t(mode, ok)")
def schema_compatible(spark, sf):
    """May readers of a nation table with a wider key and a new field that may be null follow the table as it is?"""
    from pyspark.sql.types import LongType, StructField, StructType

    old = table(spark, sf, "nation").schema
    wide = StructType([StructField(f.name, LongType() if f.name == "n_nationkey" else f.dataType, f.nullable) for f in old.fields]).add("note", "string")
    rows = [(mode, not schemas.compatible(wide, [old], mode)) for mode in ("backward", "forward", "full", "none")]
    return spark.createDataFrame(rows, "mode string, ok boolean")


@query("schema_statistics", "SELECT 'k' AS field, count(*) AS present, CAST(0 AS BIGINT) AS nulls, false AS nullable, CAST(NULL AS VARCHAR) AS format FROM events")
def schema_statistics(spark, sf):
    return schemas.field_statistics(table(spark, sf, "events"), "props")


@query("compat_dialect", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1) = nullif(n_nationkey, 3), (n_regionkey = 1) AND (n_nationkey = 3)) AS same, lower(n_name) = 'france' AS fr FROM nation")
def compat_dialect(spark, sf):
    a, b = F.nullif("n_regionkey", F.lit(1)), F.nullif("n_nationkey", F.lit(3))
    return table(spark, sf, "nation").select("n_nationkey", d.null_equal(a, b).alias("same"), d.any_case_equal(F.col("n_name"), F.lit("France")).alias("fr"))
