"""Projection, predicates, scalar functions, joins, aggregates, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dialect as d
from ..operators import aggregates, joins
from ..session import table
from . import query


def money(c: str):
    """An exact sum of amounts of two decimals, as a double."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


M = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


@query("project_all", "SELECT * FROM nation")
def project_all(spark, sf):
    return table(spark, sf, "nation").select("*")


@query("project_expressions", "SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderstatus) AS status FROM orders")
def project_expressions(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice"), F.upper("o_orderstatus").alias("status"))


@query("project_drop_rename", "SELECT n_nationkey AS id, n_name FROM nation")
def project_drop_rename(spark, sf):
    return table(spark, sf, "nation").drop("n_regionkey").withColumnRenamed("n_nationkey", "id")


@query("project_flat_map", "SELECT c_custkey, unnest([c_nationkey, c_nationkey + 100]) AS item FROM customer")
def project_flat_map(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.explode(F.array("c_nationkey", F.col("c_nationkey") + 100)).alias("item"))


@query("filter_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def filter_where(spark, sf):
    return table(spark, sf, "orders").where((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "O")).select("o_orderkey")


@query("filter_not", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O')")
def filter_not(spark, sf):
    return table(spark, sf, "orders").where(~(F.col("o_orderstatus") == "O")).select("o_orderkey")


@query("predicate_comparisons", "SELECT p_partkey FROM part WHERE (p_size <> 5 AND p_size >= 3 AND p_size < 40) OR p_size = 45 OR p_size <= 1 OR NOT p_size > 2")
def predicate_comparisons(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").where(((s != 5) & (s >= 3) & (s < 40)) | (s == 45) | (s <= 1) | ~(s > 2)).select("p_partkey")


@query("predicate_in_between", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2) AND c_acctbal BETWEEN 0 AND 5000 AND c_custkey NOT BETWEEN 10 AND 20")
def predicate_in_between(spark, sf):
    c = table(spark, sf, "customer")
    return c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2) & F.col("c_acctbal").between(0, 5000) & ~F.col("c_custkey").between(10, 20)).select("c_custkey")


@query("predicate_like", "SELECT p_partkey FROM part WHERE p_name ILIKE '%A%' AND p_type NOT ILIKE 'small%' AND p_brand ILIKE 'brand#_1'")
def predicate_like(spark, sf):
    return table(spark, sf, "part").where(d.like_any_case(F.col("p_name"), "%A%") & ~d.like_any_case(F.col("p_type"), "small%") & d.like_any_case(F.col("p_brand"), "Brand#_1")).select("p_partkey")


@query("predicate_null", "SELECT c_custkey, nullif(c_nationkey, 3) IS NULL AS missing FROM customer WHERE nullif(c_nationkey, 4) IS NOT NULL")
def predicate_null(spark, sf):
    c = table(spark, sf, "customer").where(F.nullif("c_nationkey", F.lit(4)).isNotNull())
    return c.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).isNull().alias("missing"))


@query("predicate_text", "SELECT p_partkey FROM part WHERE contains(p_name, 'e') AND starts_with(p_brand, 'Brand#1') AND NOT ends_with(p_type, 'N')")
def predicate_text(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").contains("e") & F.col("p_brand").startswith("Brand#1") & ~F.col("p_type").endswith("N")).select("p_partkey")


@query("null_drop_fill_replace", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS region, CASE WHEN n_name = 'FRANCE' THEN 'FR' ELSE n_name END AS name FROM nation WHERE nullif(n_nationkey, 7) IS NOT NULL")
def null_drop_fill_replace(spark, sf):
    n = table(spark, sf, "nation").select(F.nullif("n_nationkey", F.lit(7)).alias("n_nationkey"), F.nullif("n_regionkey", F.lit(1)).alias("region"), F.col("n_name").alias("name"))
    return n.na.drop(subset=["n_nationkey"]).na.fill({"region": -1}).na.replace("FRANCE", "FR", subset=["name"])


@query("fn_string", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, trim('  ' || c_name || ' ') AS t, CAST(length(coalesce(nullif(c_mktsegment, 'BUILDING'), '')) AS BIGINT) AS len, substr(c_name, 1, 4) AS s, concat(c_name, '-', nullif(c_mktsegment, 'BUILDING')) AS c, replace(c_name, 'Customer', 'C') AS r FROM customer")
def fn_string(spark, sf):
    seg = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return table(spark, sf, "customer").select(
        "c_custkey", F.upper("c_name").alias("u"), F.lower("c_mktsegment").alias("l"), F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("t"),
        d.length0(seg).cast("bigint").alias("len"), d.substring_from(F.col("c_name"), 0, 4).alias("s"), d.concat_text(F.col("c_name"), F.lit("-"), seg).alias("c"), d.replace_text(F.col("c_name"), "Customer", "C").alias("r"),
    )


@query("fn_trim_sides", "SELECT n_nationkey, ltrim('  ' || n_name || ' ') AS l, rtrim('  ' || n_name || ' ') AS r FROM nation")
def fn_trim_sides(spark, sf):
    x = F.concat(F.lit("  "), "n_name", F.lit(" "))
    return table(spark, sf, "nation").select("n_nationkey", F.ltrim(x).alias("l"), F.rtrim(x).alias("r"))


@query("fn_math", "SELECT p_partkey, abs(p_size - 20) AS a, round_even(p_retailprice / 4, 1) AS r, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(sqrt(p_size), 6) AS s, pow(CAST(p_size AS DOUBLE), 2.0) AS p, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS g FROM part")
def fn_math(spark, sf):
    p = F.col("p_retailprice")
    return table(spark, sf, "part").select(
        "p_partkey", F.abs(F.col("p_size") - 20).alias("a"), d.round_even(p / 4, 1).alias("r"), d.ceil_double(p).alias("c"), d.floor_double(p).alias("f"),
        F.round(F.sqrt("p_size"), 6).alias("s"), F.pow("p_size", F.lit(2.0)).alias("p"), F.round(F.ln(p), 6).alias("l"), F.round(F.log10(p), 6).alias("g"),
    )


@query("fn_arithmetic", "SELECT p_partkey, p_size + 1 AS a, p_size - 1 AS b, p_size * 2 AS c, -p_size AS n, CASE WHEN p_size % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p_size / CAST(p_size % 3 AS DOUBLE) END AS q, CASE WHEN p_size % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(p_size AS DOUBLE) % (p_size % 3) END AS m FROM part")
def fn_arithmetic(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", (s + 1).alias("a"), (s - 1).alias("b"), (s * 2).alias("c"), (-s).alias("n"), d.ratio(s, s % 3).alias("q"), d.remainder(s, s % 3).alias("m"))


@query("fn_case_cast", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS code, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS txt, TRY_CAST(o_orderpriority AS INT) AS bad FROM orders")
def fn_case_cast(spark, sf):
    p, st = F.col("o_totalprice"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(p > 200000, "high").when(p > 50000, "mid").otherwise("low").alias("band"), F.when(st == "O", 1).when(st == "F", 2).otherwise(0).alias("code"),
        d.try_cast(p, "long").alias("whole"), d.try_cast(F.col("o_orderkey"), "varchar").alias("txt"), d.try_cast(F.col("o_orderpriority"), "int").alias("bad"),
    )


@query("fn_null", "SELECT c_custkey, coalesce(nullif(c_nationkey, 1), nullif(c_nationkey, 2), -1) AS c, ifnull(nullif(c_mktsegment, 'BUILDING'), 'none') AS i FROM customer")
def fn_null(spark, sf):
    n = F.col("c_nationkey")
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(F.nullif(n, F.lit(1)), F.nullif(n, F.lit(2)), F.lit(-1)).alias("c"), F.nvl(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("i"))


@query("fn_date", "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS mo, CAST(day(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s FROM events")
def fn_date(spark, sf):
    return table(spark, sf, "events").select("event_id", F.year("ts").alias("y"), F.month("ts").alias("mo"), F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"), F.minute("ts").alias("mi"), F.second("ts").alias("s"))


@query("fn_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, '{\"a\":' || user_id || ',\"b\":\"' || event_type || '\"}' AS j FROM events")
def fn_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct(F.col("user_id").alias("a"), F.col("event_type").alias("b"))).alias("j"))


@query("fn_json_typed", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS k2 FROM events")
def fn_json_typed(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.from_json("props", "k bigint")["k"] * 2).alias("k2"))


@query("fn_array", "SELECT n_nationkey, list_contains(string_split(n_name, 'A'), '') AS has, CAST(len(string_split(n_name, 'A')) AS INT) AS n FROM nation")
def fn_array(spark, sf):
    a = F.split("n_name", "A")
    return table(spark, sf, "nation").select("n_nationkey", d.array_contains(a, "").alias("has"), F.size(a).alias("n"))


@query("fn_explode_outer", "SELECT n_nationkey, w FROM nation LEFT JOIN (SELECT n_nationkey AS k, unnest(list_filter(string_split(n_name, 'A'), lambda x: length(x) > 4)) AS w FROM nation) ON k = n_nationkey")
def fn_explode_outer(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.explode_outer(F.filter(F.split("n_name", "A"), lambda x: F.length(x) > 4)).alias("w"))


@query("sample_fraction")
def sample_fraction(spark, sf):
    return table(spark, sf, "orders").sample(withReplacement=False, fraction=0.1, seed=7).select("o_orderkey")


_DESCRIBED = {"count": "count(o_totalprice)", "mean": "avg(o_totalprice)", "stddev": "stddev_samp(o_totalprice)", "min": "min(o_totalprice)", "max": "max(o_totalprice)"}


@query("describe_orders", " UNION ALL ".join(f"SELECT '{k}' AS summary, round(CAST({v.replace('o_totalprice', 'o_custkey')} AS DOUBLE), 2) AS n FROM orders" for k, v in _DESCRIBED.items()))
def describe_orders(spark, sf):
    return table(spark, sf, "orders").select("o_custkey").describe().select("summary", F.round(F.col("o_custkey").cast("double"), 2).alias("n"))


@query("describe_orders_whole", " UNION ALL ".join(f"SELECT '{k}' AS summary, round(CAST({v} AS DOUBLE), 2) AS n FROM orders" for k, v in _DESCRIBED.items()))
def describe_orders_whole(spark, sf):
    return table(spark, sf, "orders").select("o_totalprice").describe().select("summary", F.round(F.col("o_totalprice").cast("double"), 2).alias("n"))


@query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


def _poor(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice > 150000").select("o_orderkey", "o_custkey")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) ON o_custkey = c_custkey")
def join_left(spark, sf):
    return table(spark, sf, "customer").join(_poor(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("join_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) RIGHT JOIN orders ON o_custkey = c_custkey")
def join_right(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 0").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "o_orderkey")


@query("join_full", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) ON o_custkey = c_custkey")
def join_full(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 0").join(_poor(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "full").select("c_custkey", "o_orderkey")


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf):
    return table(spark, sf, "region").crossJoin(F.broadcast(table(spark, sf, "nation"))).select("r_name", "n_name")


@query("join_multi_way", "SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_multi_way(spark, sf):
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name", "r_name")


@query("join_theta_range", "SELECT p_partkey, b.lo FROM part JOIN (SELECT unnest(range(900, 2200, 100)) AS lo) b ON p_retailprice BETWEEN b.lo AND b.lo + 99")
def join_theta_range(spark, sf):
    bands = spark.range(900, 2200, 100).select(F.col("id").alias("lo"), (F.col("id") + 99).alias("hi"))
    return joins.expand_range_join(table(spark, sf, "part"), bands, "p_retailprice", "lo", "hi", 100.0).select("p_partkey", "lo")


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def join_semi(spark, sf):
    return table(spark, sf, "customer").join(_poor(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("join_using", "SELECT n_regionkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_using(spark, sf):
    return table(spark, sf, "nation").withColumnRenamed("n_regionkey", "k").join(table(spark, sf, "region").withColumnRenamed("r_regionkey", "k"), ["k"]).select("k", "n_name", "r_name")


@query("join_global_table", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_global_table(spark, sf):
    return joins.lookup(table(spark, sf, "supplier"), table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), small=True).select("s_suppkey", "n_name")


@query("agg_basic", f"SELECT l_returnflag, l_linestatus, {M.format('l_quantity')} AS sum_qty, round(avg(l_discount), 6) AS avg_disc, min(l_tax) AS min_tax, max(l_extendedprice) AS max_price, count(*) AS n FROM lineitem GROUP BY ALL")
def agg_basic(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(money("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.min("l_tax").alias("min_tax"), F.max("l_extendedprice").alias("max_price"), F.count(F.lit(1)).alias("n"))


@query("agg_global", f"SELECT count(*) AS n, {M.format('o_totalprice')} AS total FROM orders")
def agg_global(spark, sf):
    return table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), money("o_totalprice").alias("total"))


@query("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(nullif(l_linenumber, 1)) AS later FROM lineitem GROUP BY l_returnflag")
def agg_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count(F.nullif("l_linenumber", F.lit(1))).alias("later"))


@query("agg_collect", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(DISTINCT left(n_name, 1), ',' ORDER BY left(n_name, 1)) AS firsts FROM nation GROUP BY n_regionkey")
def agg_collect(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"), F.array_join(F.sort_array(F.collect_set(F.left("n_name", F.lit(1)))), ",").alias("firsts"))


@query("agg_collect_nulls", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def agg_collect_nulls(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.size(d.collect_keep_nulls(F.nullif("n_nationkey", F.lit(3)))).cast("bigint").alias("n"))


@query("agg_stats_pop", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag")
def agg_stats_pop(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.stddev_pop("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("v"))


@query("agg_expression", f"SELECT l_suppkey, round({M.format('l_extendedprice')} / count(*), 4) AS mean_price FROM lineitem GROUP BY l_suppkey")
def agg_expression(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(d.ratio(money("l_extendedprice"), F.count(F.lit(1))), 4).alias("mean_price"))


@query("agg_having", f"SELECT o_custkey, {M.format('o_totalprice')} AS total FROM orders GROUP BY o_custkey HAVING count(*) > 5")
def agg_having(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(money("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n")).where("n > 5").drop("n")


@query("agg_first_last", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def agg_first_last(spark, sf):
    order = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", order).alias("first_type"), F.max_by("event_type", order).alias("last_type"))


@query("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) + grouping(o_orderpriority) AS INT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, sf):
    level = (F.grouping("o_orderstatus").cast("int") + F.grouping("o_orderpriority").cast("int")).alias("level")
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), level)


@query("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("agg_pivot", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS O, count(*) FILTER (l_linestatus = 'F') AS F FROM lineitem GROUP BY l_returnflag")
def agg_pivot(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count(F.lit(1))).na.fill(0)


@query("agg_fold", "SELECT user_id, string_agg(left(event_type, 1), '' ORDER BY ts, event_id) AS path FROM events GROUP BY user_id")
def agg_fold(spark, sf):
    e = table(spark, sf, "events").withColumn("s", F.left("event_type", F.lit(1)))
    return aggregates.fold(e, ["user_id"], ["ts", "event_id"], "s", F.lit(""), lambda a, x: F.concat(a, x), "path")


@query("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_limit(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("sort_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 20")
def sort_offset(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").offset(20).limit(50)


@query("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey"))


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("set_union_by_name", "SELECT c_nationkey AS k, c_name AS name, NULL AS extra FROM customer UNION ALL SELECT s_nationkey, NULL, s_name FROM supplier")
def set_union_by_name(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("extra"), F.col("s_nationkey").alias("k")), allowMissingColumns=True)


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def set_except(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, sf, "supplier").where("s_acctbal > 9000").select("s_nationkey"))


@query("set_intersect_whole", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect_whole(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf, "orders").select("o_custkey"))


@query("set_except_whole", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except_whole(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select("o_custkey"))


@query("set_drop_duplicates", "SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey")
def set_drop_duplicates(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))


@query("set_merge_sources", "SELECT c_nationkey AS k, 'customer' AS source FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def set_merge_sources(spark, sf):
    from ..sources.topics import merge_topics

    return merge_topics(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), sources=["customer", "supplier"])


@query("vector_dim_check", "SELECT vec_id, len(embedding) = 64 AS ok FROM embeddings")
def vector_dim_check(spark, sf):
    from ..operators.schemas import vector_ok

    return table(spark, sf, "embeddings").select("vec_id", vector_ok(F.col("embedding"), 64).alias("ok"))
