"""Small literal inputs and the results that the semantics ask for."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions import conditions, dialect
from millrace.operators import aggregates, cep, joins, nodes, schemas, tables, windows
from millrace.plans import questions
from millrace.plans.pipelines import Pipeline
from millrace.plans.query import Query, Store
from millrace.plans.sql import StreamingSql, duration
from millrace.sources import files, sinks, topics

BASE = dt.datetime(2026, 1, 15, 10)


@pytest.fixture(scope="module")
def engine(spark):
    e = StreamingSql(spark)
    rows = [(1, "Alice", 100.0, "Widget", "EU"), (2, "Bob", 250.0, "Gadget", "US"), (3, "Alice", 75.0, "Gadget", "EU"), (4, "Charlie", 500.0, "Widget", "US"), (5, "Bob", 150.0, "Widget", "EU")]
    e.register("orders", spark.createDataFrame(rows, "id int, customer string, amount double, product string, region string"))
    times = [(0, "Alice", 100.0), (1, "Bob", 200.0), (2, "Alice", 50.0), (6, "Alice", 300.0), (7, "Bob", 150.0), (12, "Alice", 75.0)]
    e.register("clicks", spark.createDataFrame([(BASE + dt.timedelta(minutes=m), u, a) for m, u, a in times], "ts timestamp_ntz, user string, amount double"))
    return e


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, value, **more):
    return nodes.records(spark.createDataFrame([(json.dumps(value),)], "v string"), F.lit("k"), F.col("v")).withColumns(more)


def values(df):
    return [json.loads(r.value) for r in df.collect()]


def test_sql_in_cast_substring_concat(engine):
    assert len(engine.execute("SELECT * FROM orders WHERE customer IN ('Alice', 'Charlie')").collect()) == 3
    assert rows(engine.execute("SELECT CAST(amount AS INT) AS a, SUBSTRING(customer, 1, 3) AS s, CONCAT(customer, '-', region) AS c FROM orders WHERE id = 1")) == [(100, "Ali", "Alice-EU")]


def test_sql_streams_insert_and_views(spark, engine):
    engine.execute("CREATE STREAM eu AS SELECT * FROM orders WHERE region = 'EU'")
    engine.execute("INSERT INTO eu SELECT * FROM orders WHERE region = 'US'")
    assert engine.execute("SELECT * FROM eu").count() == 5
    engine.execute("CREATE MATERIALIZED VIEW totals AS SELECT customer, SUM(amount) AS total FROM orders GROUP BY customer")
    with pytest.raises(ValueError):
        engine.execute("CREATE MATERIALIZED VIEW Totals AS SELECT 1 AS x FROM orders")
    engine.execute("CREATE MATERIALIZED VIEW IF NOT EXISTS totals AS SELECT 1 AS x FROM orders")
    assert ("Bob", 400.0) in rows(engine.execute("SELECT * FROM TOTALS"))
    assert engine.views.refresh("totals").refreshes == 2
    engine.execute("DROP MATERIALIZED VIEW totals")
    engine.execute("DROP VIEW IF EXISTS totals")
    with pytest.raises(KeyError):
        engine.execute("DROP VIEW totals")
    assert engine.emits_changes("SELECT * FROM orders EMIT CHANGES;") and not engine.emits_changes("SELECT * FROM orders")
    assert engine.tables_of("SELECT * FROM `eu-orders` o JOIN b ON o.x = b.x") == ["eu-orders", "b"]


def test_sql_windows(engine):
    out = rows(engine.execute("SELECT window_start, user, SUM(amount) AS total FROM clicks WINDOW TUMBLE(ts, 5 MINUTES) GROUP BY user"))
    at = lambda m: BASE + dt.timedelta(minutes=m)
    assert out == [(at(0), "Alice", 150.0), (at(0), "Bob", 200.0), (at(5), "Alice", 300.0), (at(5), "Bob", 150.0), (at(10), "Alice", 75.0)]
    assert engine.execute("SELECT SUM(n) AS s FROM (SELECT COUNT(*) AS n FROM clicks WINDOW HOP(ts, 10 MINUTES, 5 MINUTES))").first().s == 12
    assert duration("INTERVAL '5' MINUTE") == "5 minutes" and duration("'30 s'") == "30 seconds" and duration("2 H") == "2 hours"


def test_sessions_include_an_event_at_the_gap(spark):
    s = [(BASE + dt.timedelta(seconds=x), v) for x, v in ((0, 10), (15, 20), (25, 30), (120, 40), (150, 1))]
    out = windows.sessions(spark.createDataFrame(s, "ts timestamp_ntz, v int"), "ts", "30 seconds", [], F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    assert rows(out.select("n", "s")) == [(2, 41), (3, 60)]


def test_left_join_keeps_the_row(spark):
    e = StreamingSql(spark)
    e.register("o", spark.createDataFrame([(1, "C1", 100), (2, "C9", 200)], "order_id int, customer_id string, amount int"))
    e.register("c", spark.createDataFrame([("C1", "Alice"), ("C2", "Bob")], "cid string, name string"))
    assert rows(e.execute("SELECT order_id, coalesce(name, '-') AS name FROM o LEFT JOIN c ON customer_id = cid")) == [(1, "Alice"), (2, "-")]


def test_topic_rows(spark):
    raw = spark.createDataFrame([(0, 0, BASE, "a", '{"name":"Alice","age":30}', {"h": "1"}), (1, 0, BASE, "b", "plain text value", {}), (2, 0, BASE, None, None, None)], "offset long, partition int, timestamp timestamp_ntz, key string, value string, headers map<string,string>")
    out = topics.topic_scan(raw, "name string, age bigint", headers=["h"]).orderBy("_offset").collect()
    assert (out[0].name, out[0].age, out[0]._value, out[0]._header_h) == ("Alice", 30, None, "1")
    assert (out[1].name, out[1]._value, out[2]._value) == (None, "plain text value", None)
    assert topics.topic_scan(raw, "name string", limit=2).count() == 2
    assert topics.browse(raw, 0, 1, 1).first().offset == 1
    assert topics.topic_rows(spark.createDataFrame([(1, 2, 3)], "an_id int, _x int, b int"), "an_id").first().value == '{"anId":1,"b":3}'


def test_nodes(spark):
    assert values(nodes.cast_node(one(spark, {"name": "Alice", "age": "30"}), {"age": "int32"}, "name string, age string")) == [{"name": "Alice", "age": 30}]
    assert values(nodes.cast_node(one(spark, {"age": "25", "score": "9.5", "active": "true"}), {"age": "int32", "score": "float64", "active": "boolean"}, "age string, score string, active string")) == [{"age": 25, "score": 9.5, "active": True}]
    carol = {"user": {"name": "Carol", "id": 1}, "status": "active"}
    assert nodes.extract_field(one(spark, carol), "$.user.name").first().value == "Carol"
    assert nodes.extract_field(one(spark, {"id": 1}), "$.user.name").count() == 0
    assert values(nodes.flatten(one(spark, carol), "user struct<name:string,id:int>, status string")) == [{"user.name": "Carol", "user.id": 1, "status": "active"}]
    assert values(nodes.mask_field(one(spark, carol), ["user.name", "user.id"], "user struct<name:string,id:int>, status string")) == [{"user": {"name": "", "id": 0}, "status": "active"}]
    assert values(nodes.replace_field(one(spark, carol), include=["user"])) == [{"user": {"name": "Carol", "id": 1}}]
    assert values(nodes.split(one(spark, {"id": 7, "xs": [{"a": 1}, 2, "t"]}), "$.xs")) == [{"a": 1, "_index": 0}, {"item": 2, "_index": 1}, {"item": "t", "_index": 2}]
    assert nodes.value_to_key(one(spark, {"a": 1, "b": 2}), ["a"]).first().key == "1"
    moved = nodes.header_from(one(spark, {"a": "x", "b": 2}), {"a": "h"}, move=True)
    assert moved.first().headers == {"h": "x"} and values(moved) == [{"b": 2}]
    assert values(nodes.header_to(moved, {"h": "c", "none": "d"}, move=True)) == [{"b": 2, "c": "x", "d": None}]
    assert values(nodes.convert_timestamp(one(spark, {"t": 1700000000}), "t", "unix_ms", "t string")) == [{"t": 1700000000000}]
    assert values(nodes.convert_timestamp(one(spark, {"t": 1700000000000}), "t", "string", "t string")) == [{"t": "2023-11-14T22:13:20.000Z"}]


def test_conditions(spark):
    df = one(spark, {"s": "Hello", "n": 5, "o": {"x": "10"}})
    hit = lambda text: nodes.filter_node(df, text).count() == 1
    assert hit("$.s contains HELL") and hit("$.s startsWith he") and hit("$.s endsWith 'LO'") and not hit("$.s == hello") and hit("$.s == Hello")
    assert hit("$.n > 4") and not hit("$.n > 5") and hit("$.o.x >= 10") and hit("$.n != 6") and not hit("$.missing == 1") and not hit("$.missing != 1")
    with pytest.raises(ValueError):
        conditions.condition("no path > 1")


def test_node_join_gate_and_wait(spark):
    left = spark.createDataFrame([("u1", 1), ("u1", 2), ("u2", 3)], "k string, l int")
    right = spark.createDataFrame([("u1", 10)], "k string, r int")
    assert rows(joins.one_to_one(left, right, ["k"], ["l"], ["r"])) == [("u1", 1, 10)]
    data = spark.createDataFrame([(1, BASE), (2, BASE + dt.timedelta(minutes=2)), (3, BASE + dt.timedelta(minutes=9))], "id int, ts timestamp_ntz")
    signals = spark.createDataFrame([(BASE + dt.timedelta(minutes=1), False), (BASE + dt.timedelta(minutes=5), True)], "ts timestamp_ntz, is_open boolean")
    assert [r.id for r in nodes.gate(data, signals, "ts", buffer=False).orderBy("id").collect()] == [1, 3]
    assert [r.released_at for r in nodes.gate(data, signals, "ts").orderBy("id").collect()][1] == BASE + dt.timedelta(minutes=5)


def test_watermarks(spark):
    e = spark.createDataFrame([(0, 10_000), (1, 20_000), (2, 15_000)], "i int, ms long").withColumn("ts", F.timestamp_millis("ms"))
    assert [r.w for r in e.select("i", windows.running_watermark("ts", ["i"], 5000).alias("w")).orderBy("i").collect()] == [4999, 14999, 14999]
    assert windows.aligned_start(7 * 86400) == "345600 seconds"


def test_cep(spark):
    ints = spark.createDataFrame([("a", i, v) for i, v in enumerate((50, 150, 200, 10, -5, -7))], "k string, i int, v int").withColumn("ts", F.lit(BASE) + F.make_dt_interval(secs=F.col("i")))
    big = cep.Pattern.begin("big", F.col("v") > 100)
    assert [r.big_id for r in cep.match(ints, big, ["k"], "ts", ["i"], "i").orderBy("big_id").collect()] == [1, 2]
    turn = cep.Pattern.begin("up", F.col("v") > 0).where(F.col("v") < 20).followed_by("down", F.col("v") < 0).within("10 seconds")
    assert rows(cep.match(ints, turn, ["k"], "ts", ["i"], "i").select("up_id", "down_id")) == [(3, 4)]
    many = cep.Pattern.begin("up", F.col("v") > 0).one_or_more().next("down", F.col("v") < 0).times(1, 2)
    assert rows(cep.match_quantified(ints, many, ["k"], "ts", ["i"], "i").select("start_id", "end_id", "n_events")) == [(0, 5, 6)]
    maybe = cep.Pattern.begin("a", F.col("v") == 50).next("b", F.col("v") == 99).optional().next("c", F.col("v") == 150)
    assert rows(cep.match_quantified(ints, maybe, ["k"], "ts", ["i"], "i").select("start_id", "end_id")) == [(0, 1)]
    assert cep.match_any(ints, F.col("v") == 50, F.col("v") < 0, ["k"], "ts", "i", "1 minute").count() == 2


def test_tables_and_upserts(spark):
    log = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("a", None, 3), ("b", "3", 4)], "key string, value string, offset int")
    assert rows(tables.compact(log).select("key", "value")) == [("b", "3")]
    other = spark.createDataFrame([("b", "x", 1), ("c", "y", 2)], "key string, value string, offset int")
    assert rows(joins.table_join(log, other, "key", "offset")) == [("b", "3", "x")]
    assert joins.table_join(log, other, "key", "offset", "full").count() == 2
    target, new = spark.createDataFrame([(1, "a", 5)], "id int, v string, ver int"), spark.createDataFrame([(1, "b", 4), (2, "c", 1)], "id int, v string, ver int")
    assert rows(sinks.upsert(target, new, ["id"], "insert_or_update")) == [(1, "b", 4), (2, "c", 1)]
    assert rows(sinks.upsert(target, new, ["id"], "insert_or_skip")) == [(1, "a", 5), (2, "c", 1)]
    assert rows(sinks.upsert(target, new, ["id"], "insert_or_update_if_newer", "ver")) == [(1, "a", 5), (2, "c", 1)]
    assert rows(sinks.upsert(target, new, ["id"], "replace")) == rows(new)
    with pytest.raises(Exception, match="key exists"):
        sinks.upsert(target, new, ["id"], "insert_or_fail").collect()
    countries = spark.createDataFrame([("US", "United States"), ("DE", "Germany")], "key string, name string")
    assert rows(joins.lookup(spark.createDataFrame([("US",), ("FR",)], "key string"), countries, ["key"], small=True)) == [("US", "United States")]
    store = Store(countries).put_all(spark.createDataFrame([("US", None), ("FR", "France")], "key string, name string"))
    assert [r.key for r in store.all().collect()] == ["DE", "FR"] and store.get("DE").name == "Germany" and store.get("XX") is None and store.delete("DE").count() == 1
    assert store.prefix("F").count() == 1 and store.put_if_absent(countries).count() == 3


def test_asof_and_fold(spark):
    a = spark.createDataFrame([("k", 5), ("k", 1)], "k string, t int")
    b = spark.createDataFrame([("k", 5, "same"), ("k", 3, "before")], "k string, u int, v string")
    assert sorted((r.t, r.v) for r in joins.asof_join(a, b, ["k"], "t", "u", ["v"]).collect()) == [(1, None), (5, "same")]
    assert sorted((r.t, r.v) for r in joins.asof_join(a, b, ["k"], "t", "u", ["v"], strict=True).collect()) == [(1, None), (5, "before")]
    assert aggregates.fold(b, ["k"], ["u"], "u", F.lit(0), lambda s, x: s * 10 + x, "f").first().f == 35


def test_schemas(spark):
    old, new = StructType.fromDDL("a int not null, b string"), StructType.fromDDL("a bigint not null, b string, c int")
    assert schemas.compatible(new, [old], "backward") == [] and schemas.compatible(new, [old], "forward") and schemas.compatible(new, [old], "none") == []
    assert schemas.compatible(StructType.fromDDL("a int not null, d int not null"), [old], "full_transitive")
    found = schemas.infer(spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":2.5,"c":[1]}',)], "j string"), "j")
    assert {f.name for f in found.fields} == {"a", "b", "c"}
    forms = {"2024-01-01": "date", "2024-13-01": None, "2024-01-01T10:00:00Z": "date-time", "a@b.de": "email", "a@b": None, "x": None, "": None, "10.0.0.255": "ipv4", "10.0.0.256": None, "1.2.3": None, "::1": "ipv6", "fe80::1:2": "ipv6", "1:2:3:4:5:6:7:8": "ipv6", "1:2:3": None, "12:30:00": None, "https://a.b/c": "uri", "6d696c6c-7261-6365-0000-000000000001": "uuid", "6d696c6c-7261-6365-0000-00000000000g": None}
    kinds = spark.createDataFrame([(v,) for v in forms], "v string").select("v", schemas.text_format(F.col("v")).alias("f"))
    assert {r.v: r.f for r in kinds.collect()} == forms
    stats = schemas.field_statistics(spark.createDataFrame([('{"a":1,"d":"2024-01-01"}',), ('{"a":null,"d":"2024-02-01","e":"x"}',), ("bad",)], "j string"), "j")
    assert rows(stats) == [("a", 2, 1, True, None), ("d", 2, 0, False, "date"), ("e", 1, 0, True, None)]


def test_dialect(spark):
    r = spark.range(1).select(dialect.round_even(F.lit(2.5)).alias("a"), dialect.ratio(F.lit(1), F.lit(0)).alias("b"), dialect.length0(F.lit(None).cast("string")).alias("c"), dialect.try_cast(F.lit("x"), "int", compat=True).alias("d"), dialect.timestamp_of(F.lit("1700000000000")).cast("string").alias("e"), dialect.truthy_text(F.lit("0")).alias("f"))
    a, b, c, d, e, f = r.first()
    assert a == 2.0 and b != b and (c, d, e, f) == (0, 0, "2023-11-14 22:13:20", False)


def test_pipelines_queries_questions(spark, tmp_path):
    spec = {"nodes": [{"id": "a", "type": "filter", "test": "$.n > 1"}, {"id": "b", "type": "filter", "test": "$.n == 0"}, {"id": "m", "type": "merge", "after": ["a", "b"]}]}
    data = spark.range(4).select(F.lit("k").alias("key"), F.to_json(F.struct(F.col("id").alias("n"))).alias("value"))
    assert sorted(v["n"] for v in values(Pipeline(spec).run(data))) == [0, 2, 3]
    with pytest.raises(ValueError, match="cycle"):
        Pipeline({"nodes": [{"id": "a", "type": "merge", "after": ["b"]}, {"id": "b", "type": "merge", "after": ["a"]}]})
    assert nodes.dry_run(data, {"f": lambda df: nodes.filter_node(df, "$.n > 2")})["f"][0]["value"] == '{"n":3}'
    q = Query(spark.range(10)).where(F.col("id") > 3)
    assert q.count() == 6 and q.order_by("id").skip(1).first().id == 5 and q.any(F.col("id") == 4) and q.where(F.col("id") == 4).single().id == 4
    with pytest.raises(LookupError):
        q.single()
    assert questions.to_sql("average of amount in orders by region") == "SELECT region, AVG(amount) AS value FROM orders GROUP BY region"
    with pytest.raises(ValueError):
        questions.guard("DROP TABLE x")
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\n4,5\n")
    assert rows(files.read_csv(spark, str(tmp_path / "x.csv")))[0] == ("1", "2")
    assert files.incremental(spark.range(5), "id", 2).count() == 2
    assert files.generate(spark, 20).select("key").distinct().count() == 10


def test_continuous_queries(spark, sf_dir, tmp_path):
    from millrace.plans.views import ContinuousQueries
    from millrace.streaming.run import replay

    running, seen = ContinuousQueries(most=1), []
    stream = replay(spark, sf_dir, "events").groupBy("event_type").count()
    query = running.start("counts", stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "c"), mode="complete", availableNow=True)
    query.awaitTermination()
    assert seen and set(seen) == {5} and running.list() == {"counts": False}
    running.stop("counts")
    assert running.list() == {}


def test_after_match(spark):
    rows = [("k", i, s) for i, s in enumerate("aabab")]
    df = spark.createDataFrame(rows, "k string, i int, s string").withColumn("ts", F.lit(BASE) + F.make_dt_interval(secs=F.col("i")))
    p = cep.Pattern.begin("a", F.col("s") == "a").one_or_more().next("b", F.col("s") == "b")
    find = lambda after: sorted((r.start_id, r.end_id) for r in cep.match_quantified(df, p, ["k"], "ts", ["i"], "i", after).collect())
    assert find("past_last") == [(0, 2), (3, 4)]
    assert find("no_skip") == [(0, 2), (1, 2), (3, 4)]
    assert find(("to_last", "a")) == [(0, 2), (1, 2), (3, 4)]
    assert find(("to_first", "b")) == [(0, 2), (3, 4)]


@pytest.mark.parametrize("least, most", [(1, None), (2, 3), (2, None)])
def test_quantified_within_equals_brute_force(spark, least, most):
    minutes = {1: [0, 30, 120], 2: [0, 10, 20, 50, 60, 61, 125, 126, 200, 260], 3: [0, 61, 122]}
    table = spark.createDataFrame([(k, k * 100 + i, BASE + dt.timedelta(minutes=m)) for k, at in minutes.items() for i, m in enumerate(at)], "k int, id long, ts timestamp_ntz")
    begin = cep.Pattern.begin("a", F.lit(True))
    pattern = (begin.one_or_more() if (least, most) == (1, None) else cep.Pattern((cep.Step("a", F.lit(True), least=least, most=most),))).within("1 hour")
    want = []
    for k, at in minutes.items():
        i = 0
        while i < len(at):
            n = min(sum(at[i] <= m <= at[i] + 60 for m in at[i:]), most or len(at))
            if n >= least:
                want.append((k, k * 100 + i, k * 100 + i + n - 1, n))
            i += n if n >= least else 1
    assert rows(cep.match_quantified(table, pattern, ["k"], "ts", ["ts", "id"], "id")) == want


def test_stream_matcher_within_takes_the_shorter_run():
    from types import SimpleNamespace

    from millrace.streaming.patterns import Matcher

    matcher = object.__new__(Matcher)
    matcher.expression, matcher.width, matcher.limit = cep.re.compile("(?P<s0>(?:<1>){1,})"), 3, 60
    matcher.counts, matcher.grows = ((0, None),), True
    kept = []
    matcher.state = SimpleNamespace(exists=lambda: bool(kept), get=lambda: kept[-1], update=kept.append)
    event = lambda m: SimpleNamespace(ms=m, id=m, symbol="<1>")
    found = [tuple(r) for batch in ([0, 30, 120], [130, 200]) for r in matcher.handleInputRows(("k",), iter([event(m) for m in batch]), None)]
    assert found == [("k", 0, 30, 2), ("k", 120, 130, 2)]


def _letters(spark, text, seconds=None):
    rows = [("k", i, s) for i, s in enumerate(text)]
    at = F.col("i") if seconds is None else F.element_at(F.array(*map(F.lit, seconds)), F.col("i") + 1)
    return spark.createDataFrame(rows, "k string, i int, s string").withColumn("ts", F.lit(BASE) + F.make_dt_interval(secs=at.cast("double")))


def test_not_followed_by_counts_from_the_first_event(spark):
    s = F.col("s")
    p = cep.Pattern.begin("a", s == "a").followed_by("b", s == "b").not_followed_by("c", s == "c").within("10 seconds")
    find = lambda text, at: rows(cep.match(_letters(spark, text, at), p, ["k"], "ts", ["i"], "i").select("a_id", "b_id"))
    assert find("abc", [0, 8, 12]) == [(0, 1)]
    assert find("abc", [0, 8, 10]) == []
    assert find("abxc", [0, 8, 9, 30]) == [(0, 1)]


def test_more_than_ten_steps_keep_their_order(spark):
    text = "abcdefghijkl"
    p = cep.Pattern.begin("a", F.col("s") == "a")
    for c in text[1:]:
        p = p.followed_by(c, F.col("s") == c)
    events = _letters(spark, text)
    assert cep.match(events, p.within("11 seconds"), ["k"], "ts", ["i"], "i").count() == 1
    assert cep.match(events, p.within("10 seconds"), ["k"], "ts", ["i"], "i").count() == 0


@pytest.mark.parametrize("strict, want", [(False, [(0, 5, 4)]), (True, [(0, 2, 2)])])
def test_relaxed_and_consecutive_repeats(spark, strict, want):
    s = F.col("s")
    p = cep.Pattern.begin("a", s == "a").followed_by("b", s == "b").one_or_more()
    p = p.consecutive() if strict else p
    found = rows(cep.match_quantified(_letters(spark, "axbxbb"), p, ["k"], "ts", ["i"], "i").select("start_id", "end_id", "n_events"))
    assert found == want
    kinds = cep.Pattern.begin("a", F.lit(True)).subtype("s", "a").next("x", F.lit(True)).subtype("s", "x")
    assert rows(cep.match(_letters(spark, "axbxbb"), kinds, ["k"], "ts", ["i"], "i").select("a_id", "x_id")) == [(0, 1)]


def test_followed_by_takes_the_first_event_that_fits_however_patterns_are_run(spark):
    s = F.col("s")
    p = cep.Pattern.begin("a", s == "a").followed_by("b", s == "b").next("c", s == "c")
    for text in ("abxbc", "axbc", "aabc"):
        one = rows(cep.match(_letters(spark, text), p, ["k"], "ts", ["i"], "i").select("a_id", "c_id"))
        many = rows(cep.match_quantified(_letters(spark, text), p, ["k"], "ts", ["i"], "i", "no_skip").select("start_id", "end_id"))
        assert one == many


def test_many_keys_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        events = spark.range(400).select(F.pmod("id", F.lit(23)).cast("string").alias("k"), F.when(F.col("id") < 23, None).otherwise(F.lit(1)).alias("k2"), "id", (F.lit(BASE) + F.make_dt_interval(secs=F.col("id").cast("double"))).alias("ts"))
        p = cep.Pattern.begin("a", F.lit(True)).one_or_more()
        found = cep.match_quantified(events, p, ["k", "k2"], "ts", ["id"], "id")
        want = events.groupBy("k", "k2").agg(F.min("id").alias("start_id"), F.max("id").alias("end_id"), F.count("*").alias("n_events"))
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_anti", "left_semi"])
def test_interval_join_by_cells_equals_the_plain_join(spark, how):
    left = spark.range(300).select(F.pmod("id", F.lit(3)).alias("k"), F.col("id").alias("l"), F.when(F.col("id") % 17 != 0, F.lit(BASE) + F.make_dt_interval(secs=(F.col("id") * 37 % 5000).cast("double"))).alias("lt"))
    right = spark.range(200).select(F.pmod("id", F.lit(4)).alias("k"), F.col("id").alias("r"), F.when(F.col("id") % 13 != 0, F.lit(BASE) + F.make_dt_interval(secs=(F.col("id") * 53 % 5000).cast("double"))).alias("rt"))
    test = (F.col("k") == F.col("__k")) & F.col("rt").between(F.col("lt") - F.expr("interval 1 minute"), F.col("lt") + F.expr("interval 90 seconds"))
    plain = left.join(right.withColumnRenamed("k", "__k"), test, how)
    cells = joins.interval_join(left, right, ["k"], "lt", "rt", "1 minute", "90 seconds", how)
    cols = ["l"] if how.startswith("left_") else ["l", "r"]
    as_text = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert as_text(cells) == as_text(plain) and plain.count()


def test_ranges_of_any_width_meet_their_points(spark):
    points = spark.range(0, 2000, 7).select(F.col("id").cast("double").alias("p"))
    ranges = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 9.0), (3, -50.0, 1500.0), (4, 700.0, 700.5), (5, 20.0, 10.0), (6, 100.0, 1_000_000.0)], "r int, lo double, hi double")
    want = points.crossJoin(ranges).where("p between lo and hi").select("p", "r")
    assert rows(joins.expand_range_join(points, ranges, "p", "lo", "hi", 10.0).select("p", "r")) == rows(want)


def test_numbers_and_maxima_over_ranges(spark):
    from millrace.operators.ranges import greatest_before, numbered

    table = spark.range(500).select((F.col("id") * 7919 % 311).alias("v"), F.col("id").alias("i"), F.pmod("id", F.lit(2)).alias("g"))
    assert rows(numbered(table, ["v", "i"], "n", rows=40)) == rows(numbered(table, ["v", "i"], "n"))
    assert rows(numbered(table, ["v", "i"], "n", ["g"], rows=40)) == rows(numbered(table, ["v", "i"], "n", ["g"]))
    assert sorted(map(str, greatest_before(table, "v", ["i"], "top", rows=40).collect())) == sorted(map(str, greatest_before(table, "v", ["i"], "top").collect()))


def test_odd_keys_and_bad_records_in_nodes(spark):
    odd = {"it's": 1, "a.b": "x", "c]['": [1, {"z": 2.5}], 'q"': None, "ok": "5"}
    df = nodes.records(spark.createDataFrame([(json.dumps(odd),), ("no json",), ("[1]",)], "v string"), F.lit("k"), F.col("v"))
    out = [r.value for r in nodes.replace_field(df, exclude=["a.b"], rename={"it's": "its"}).collect()]
    assert json.loads(out[0]) == {"its": 1, "c]['": [1, {"z": 2.5}], 'q"': None, "ok": "5"} and out[1:] == [None, None]
    assert json.loads(nodes.replace_field(df, include=["it's", 'q"']).first().value) == {"it's": 1, 'q"': None}
    moved = nodes.header_from(df, {"it's": "h", "ok": "o"}, move=True)
    assert moved.first().headers == {"h": "1", "o": "5"}
    assert json.loads(nodes.header_to(moved, {"h": 'n"w'}).first().value)['n"w'] == "1"
    items = nodes.records(spark.createDataFrame([('{"id":7,"xs":[{"a":1},2,"5",null,[1]]}',), ("no json",)], "v string"), F.lit("k"), F.col("v"))
    want = [{"a": 1, "_index": 0}, {"item": 2, "_index": 1}, {"item": "5", "_index": 2}, {"item": None, "_index": 3}, {"item": [1], "_index": 4}]
    assert values(nodes.split(items, "$.xs")) == want
    assert values(nodes.split(items, "$.xs", keep_parent=True)) == [{"id": 7, **w} for w in want]


def test_names_inside_texts_are_left_alone(spark):
    e = StreamingSql(spark)
    e.register("orders", spark.createDataFrame([(1, "ship from orders now"), (2, "it's from orders {x}"), (3, "window tumble(ts, 1 day)")], "id int, note string"))
    assert rows(e.execute("SELECT id FROM orders WHERE note = 'ship from orders now'")) == [(1,)]
    assert rows(e.execute("SELECT id, 'from orders' AS f FROM orders WHERE note = 'it''s from orders {x}' OR note = 'it\\'s from orders {x}'")) == [(2, "from orders")]
    assert rows(e.execute("SELECT id FROM orders WHERE note = 'window tumble(ts, 1 day)'")) == [(3,)]
    assert e.tables_of("SELECT 'from a' FROM b") == ["b"]
    e.execute("CREATE STREAM x WITH (format='json', note='a, b') AS SELECT 'insert into orders select' AS t FROM orders LIMIT 1")
    assert rows(e.execute("SELECT * FROM x EMIT CHANGES")) == [("insert into orders select",)]


def test_snapshots_and_stored_rows_do_not_follow_their_source(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(3).write.parquet(at)
    e = StreamingSql(spark)
    e.register("t", lambda: spark.read.parquet(at))
    e.execute("CREATE MATERIALIZED VIEW v AS SELECT id FROM t")
    e.views.refresh("V")
    e.execute("CREATE TABLE c AS SELECT id FROM t")
    e.execute("INSERT INTO c SELECT id + 100 AS id FROM t")
    held = e.execute("SELECT * FROM v")
    spark.range(3, 8).write.mode("append").parquet(at)
    counts = lambda: [e.execute(f"SELECT * FROM {x}").count() for x in ("t", "v", "c")]
    assert counts() == [8, 3, 6]
    e.views.refresh("v")
    assert counts() == [8, 8, 6] and held.count() == 3
    e.execute("DROP VIEW v")


def test_a_batch_that_is_tried_again_counts_once(spark, tmp_path, monkeypatch):
    from pyspark.sql.streaming.readwriter import DataStreamWriter

    from millrace.streaming import run

    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    wrote, plain = [], DataStreamWriter.foreachBatch
    monkeypatch.setattr(DataStreamWriter, "foreachBatch", lambda self, f: plain(self, lambda batch, n: [wrote.append(f(batch, n)) for _ in range(2)] and None))
    assert run.drain(stream).count() == 5 and len(wrote) == 2
    monkeypatch.undo()
    assert run.drain(stream.where("id < 0")).count() == 0


def test_window_and_session_stores(spark):
    from millrace.plans.query import SessionStore, WindowStore

    at = lambda m: BASE + dt.timedelta(minutes=m)
    w = WindowStore(spark.createDataFrame([("a", at(0), 1), ("a", at(5), 2), ("b", at(5), 3)], "key string, window_start timestamp_ntz, n int"))
    w = w.put(spark.createDataFrame([("a", at(5), 9), ("a", at(10), 4)], "key string, window_start timestamp_ntz, n int"))
    assert [r.n for r in w.fetch("a", at(1), at(10)).collect()] == [9, 4] and w.fetch_all().count() == 4
    assert w.expired("5 minutes").fetch_all().count() == 3
    kind = "key string, window_start timestamp_ntz, window_end timestamp_ntz, n int"
    s = SessionStore(spark.createDataFrame([("a", at(0), at(5), 1), ("a", at(20), at(25), 2), ("b", at(0), at(30), 3)], kind))
    assert [r.n for r in s.find_sessions("a", at(5), at(19)).collect()] == [1]
    s = s.put(spark.createDataFrame([("a", at(0), at(5), 7)], kind)).remove(spark.createDataFrame([("a", at(20), at(25))], "key string, window_start timestamp_ntz, window_end timestamp_ntz"))
    assert [r.n for r in s.fetch("a").collect()] == [7]


def test_watermark_of_sources_of_which_one_falls_idle(spark):
    log = [(0, "x", 10), (1, "y", 5), (2, "x", 20), (3, "x", 100), (4, "y", 50), (5, "x", 101)]
    e = spark.createDataFrame(log, "i int, s string, sec int").withColumn("ts", F.timestamp_seconds("sec")).withColumn("at", F.timestamp_seconds(F.col("i") * 10))
    find = lambda idle: [r.w for r in windows.combined_watermark(e, "ts", "s", ["x", "y"], [], ["i"], 0, idle, "w", "at").orderBy("i").collect()]
    assert find(1_000_000) == [9_999, 9_999, 9_999, 9_999, 49_999, 49_999]
    assert find(15_000) == [9_999, 9_999, 9_999, 99_999, 99_999, 99_999]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        spark.range(10).withColumnRenamed("id", "N").write.option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").jdbc(url, "T")
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no database driver: {str(e)[:80]}")
    read = files.read_jdbc(spark, url, "T", "N", 0, 10, 3, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert read.count() == 10 and read.rdd.getNumPartitions() == 3


def test_feed_moves_the_clock(spark):
    from millrace.streaming.run import Feed

    at = lambda m: BASE + dt.timedelta(minutes=m)
    feed = Feed(spark, "ts timestamp, k string")
    counts = windows.tumble(windows.watermarked(feed.stream, "ts", "0 seconds"), "ts", "5 minutes", ["k"], F.count("k").alias("n"))
    feed.put((at(0), "a"), (at(1), "a"), (at(3), "b"))
    assert feed.read(counts) == []
    feed.advance("ts", at(30))
    assert sorted((r.k, r.n) for r in feed.read(counts)) == [("a", 2), ("b", 1)]
    feed.put((at(2), "a"))
    assert feed.read(counts) == []


def test_named_topologies(spark, sf_dir, tmp_path):
    from millrace.streaming.run import Topologies, replay

    named, seen = Topologies(spark), {}
    named.add("kinds", lambda s: replay(s, sf_dir, "events").groupBy("event_type").count())
    named.add("users", lambda s: replay(s, sf_dir, "events").groupBy("user_id").count())
    with pytest.raises(ValueError):
        named.add("users", lambda s: s.range(1))
    assert "event_type" in named.describe("kinds") and "user_id" in named.describe("users")
    for name in ("kinds", "users"):
        named.start(name, lambda batch, n, name=name: seen.__setitem__(name, batch.count()), str(tmp_path / name), "complete", availableNow=True).awaitTermination()
    assert seen["kinds"] == 5 and seen["users"] > 5 and named.active() == {"kinds": False, "users": False}
    named.stop("kinds")
