"""Pipeline nodes: functions from records to records. A record is (key, value, headers, topic, timestamp ...), value a JSON text.

Every node is Column expressions over the record, so a pipeline of nodes is one Catalyst plan.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructType

from ..functions.conditions import condition
from ..functions.dialect import truthy_text, wire_payload, wire_schema_id
from .joins import interval_join
from .ranges import numbered

NUMBERS = {"int32": "int", "int64": "bigint", "float32": "float", "float64": "double"}


def records(df: DataFrame, key: Column | None = None, value: Column | None = None, topic: str = "input", timestamp: Column | None = None) -> DataFrame:
    """Rows of a table as records."""
    return df.select(
        (key if key is not None else F.lit(None)).cast("string").alias("key"),
        (value if value is not None else F.to_json(F.struct(*df.columns))).alias("value"),
        F.create_map().cast("map<string,string>").alias("headers"),
        F.lit(topic).alias("topic"),
        (timestamp if timestamp is not None else F.lit(None).cast("timestamp")).alias("timestamp"),
    )


def _map(value: Column) -> Column:
    """A JSON object as map<string,variant>, parsed once, fields in order; null for what is no object or no JSON."""
    return F.from_json(value, "map<string,variant>")


def _fields(value: Column) -> Column:
    """Top-level fields of a JSON object: array<struct<key, value>>, values as JSON texts in order."""
    return F.transform(F.map_entries(_map(value)), lambda f: F.struct(f["key"].alias("key"), F.to_json(f["value"]).alias("value")))


def _text(value: Column, field: str) -> Column:
    """A field as text, or what lies at a dotted path; names of other characters are taken as they are."""
    if re.fullmatch(r"[\w.]+", field):
        return F.get_json_object(value, f"$.{field}")
    return F.try_element_at(_map(value), F.lit(field)).cast("string")


def _object(fields: Column) -> Column:
    pairs = F.transform(fields, lambda f: F.concat(_quoted(f["key"]), F.lit(":"), F.coalesce(f["value"], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _renamed(fields: Column, old: str, new: str) -> Column:
    return F.transform(fields, lambda f: F.struct(F.when(f["key"] == old, new).otherwise(f["key"]).alias("key"), f["value"].alias("value")))


def filter_node(df: DataFrame, test: str, negate: bool = False) -> DataFrame:
    return df.where(~condition(test) if negate else condition(test))


def map_node(df: DataFrame, mapping: dict[str, str], schema: str | None = None) -> DataFrame:
    """New values with the mapped fields: a JSON path, or 'quoted text'. With ``schema`` the fields of the original stay in front."""
    made = [(F.lit(p[1:-1]) if p[:1] == "'" else F.get_json_object("value", p)).alias(name) for name, p in mapping.items()]
    kept = [F.col(f"__v.{c}") for c in StructType.fromDDL(schema).names if c not in mapping] if schema else []
    base = df.withColumn("__v", F.from_json("value", schema)) if schema else df
    return base.withColumn("value", F.to_json(F.struct(*kept, *made))).drop("__v")


def replace_field(df: DataFrame, include: list[str] = (), exclude: list[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """Values with some fields only, without some, or with new names; a value that is no JSON object becomes null."""
    keep = lambda k: (k.isin(*include) if include else F.lit(True)) & (~k.isin(*exclude) if exclude else F.lit(True))
    if not rename:
        return df.withColumn("value", F.to_json(F.map_filter(_map(F.col("value")), lambda k, _: keep(k))))
    fields = F.filter(_fields(F.col("value")), lambda f: keep(f["key"]))
    for old, new in rename.items():
        fields = _renamed(fields, old, new)
    return df.withColumn("value", _object(fields))


def insert_field(df: DataFrame, fields: dict[str, Column], schema: str) -> DataFrame:
    """Adds fields (a topic, a timestamp, an offset, a literal) to values of a known schema."""
    return df.withColumn("__v", F.from_json("value", schema)).withColumn("value", F.to_json(F.struct("__v.*", *(c.alias(n) for n, c in fields.items())))).drop("__v")


def extract_field(df: DataFrame, path: str) -> DataFrame:
    """The value at a path; records without it are dropped."""
    return df.withColumn("value", F.get_json_object("value", path)).where("value is not null")


def hoist_field(df: DataFrame, name: str, schema: str | None = None) -> DataFrame:
    inner = F.from_json("value", schema) if schema else F.col("value")
    return df.withColumn("value", F.to_json(F.struct(inner.alias(name))))


def flatten(df: DataFrame, schema: str, delimiter: str = ".") -> DataFrame:
    """Nested objects as top-level fields; arrays stay."""

    def leaves(kind: StructType, at: str, name: str):
        for f in kind.fields:
            path, label = f"{at}.`{f.name}`", f"{name}{delimiter}{f.name}" if name else f.name
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, path, label)
            else:
                yield F.col(path).alias(label)

    made = df.withColumn("__v", F.from_json("value", schema))
    return made.withColumn("value", F.to_json(F.struct(*leaves(StructType.fromDDL(schema), "__v", "")))).drop("__v")


def cast_node(df: DataFrame, kinds: dict[str, str], schema: str) -> DataFrame:
    """Casts fields to int32, int64, float32, float64, boolean or string; text is true unless empty, 'false' or '0'."""
    types = {f.name: f.dataType for f in StructType.fromDDL(schema).fields}

    def cast(name: str) -> Column:
        x, to = F.col(f"__v.`{name}`"), kinds.get(name)
        if to is None:
            return x.alias(name)
        if to == "boolean" and isinstance(types[name], StringType):
            return truthy_text(x).alias(name)
        return x.try_cast(NUMBERS.get(to, to)).alias(name)

    return df.withColumn("__v", F.from_json("value", schema)).withColumn("value", F.to_json(F.struct(*(cast(n) for n in types)))).drop("__v")


def _blank(kind: DataType) -> Column:
    if isinstance(kind, NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, BooleanType):
        return F.lit(False)
    if isinstance(kind, ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, StructType):
        return F.from_json(F.lit("{}"), kind)
    return F.lit("").cast(kind)


def mask_field(df: DataFrame, paths: list[str], schema: str, custom: str | None = None) -> DataFrame:
    """Blanks fields (dots name nested ones) by type, or with a text of choice where the field is text."""
    kind = StructType.fromDDL(schema)
    out = F.from_json("value", schema)
    for path in paths:
        at: DataType = kind
        for part in path.split("."):
            at = at[part].dataType
        out = out.withField(path, F.lit(custom) if custom is not None and isinstance(at, StringType) else _blank(at))
    return df.withColumn("value", F.to_json(out))


def value_to_key(df: DataFrame, fields: list[str]) -> DataFrame:
    """One field becomes the key as it is, several as a JSON object."""
    found = {f: _text(F.col("value"), f) for f in fields}
    return df.withColumn("key", found[fields[0]] if len(fields) == 1 else F.to_json(F.struct(*(c.alias(n) for n, c in found.items()))))


def header_from(df: DataFrame, fields: dict[str, str], move: bool = False) -> DataFrame:
    """Copies or moves fields into headers: {field: header}."""
    made = F.map_from_arrays(F.array(*(F.lit(h) for h in fields.values())), F.array(*(_text(F.col("value"), f) for f in fields)))
    merged = F.map_concat(F.map_filter("headers", lambda k, _: ~k.isin(*fields.values())), made)
    out = df.withColumn("headers", merged)
    return replace_field(out, exclude=list(fields)) if move else out


def header_to(df: DataFrame, headers: dict[str, str], move: bool = False) -> DataFrame:
    """Copies or moves headers into fields: {header: field}."""
    added = [F.concat(F.lit(json.dumps(f) + ":"), F.coalesce(_quoted(F.col("headers")[h]), F.lit("null"))) for h, f in headers.items()]
    own = F.to_json(F.map_filter(_map(F.col("value")), lambda k, _: ~k.isin(*headers.values())))
    out = df.withColumn("value", F.when(own.isNotNull(), _joined(_inside(own), *added)))
    return out.withColumn("headers", F.map_filter("headers", lambda k, _: ~k.isin(*headers))) if move else out


def schema_decode(df: DataFrame, message: str = "message") -> DataFrame:
    """Strips a five-byte wire header from binary messages; the schema id becomes a header."""
    framed = (F.octet_length(message) >= 5) & (F.hex(F.substring(message, 1, 1)) == "00")
    out = df.withColumn("schema_id", F.when(framed, wire_schema_id(F.col(message))))
    return out.withColumn("value", F.when(framed, wire_payload(F.col(message))).otherwise(F.col(message)).cast("string"))


def schema_filter(df: DataFrame, ids: list[int]) -> DataFrame:
    return df.where(F.col("schema_id").isin(*ids))


def inspect(df: DataFrame, mode: str = "full") -> DataFrame:
    """Records as envelopes: full, compact (no headers), or headers only."""
    parts = {"full": ["topic", "key", "value", "headers"], "compact": ["key", "value"], "headers": ["headers"]}[mode]
    return df.withColumn("value", F.to_json(F.struct(*parts)))


def split(df: DataFrame, path: str, keep_parent: bool = False) -> DataFrame:
    """A record for each element of an array: objects as they are, scalars as {"item": x}; ``_index`` counts from 0."""
    field = path.removeprefix("$.")
    if keep_parent and re.fullmatch(r"\w+", field):  # one parse gives the elements and the parent's other fields
        out = df.withColumn("__m", _map(F.col("value"))).withColumn("__a", F.try_element_at("__m", F.lit(field)).try_cast("array<variant>"))
    else:
        out = df.withColumn("__a", F.from_json(F.get_json_object("value", path), "array<variant>"))
    rest = lambda m: F.to_json(F.map_filter(m, lambda k, _: k != field))
    out = out.withColumn("__p", _inside(rest(F.col("__m") if "__m" in out.columns else _map(F.col("value")))) if keep_parent else F.lit(""))
    out = out.select(*df.columns, "__p", F.posexplode("__a").alias("__i", "__v")).withColumn("__j", F.to_json("__v"))
    body = F.when(F.col("__j").startswith("{"), _inside(F.col("__j"))).otherwise(F.concat(F.lit('"item":'), F.coalesce("__j", F.lit("null"))))
    value = _joined(F.col("__p"), body, F.concat(F.lit('"_index":'), F.col("__i").cast("string")))
    return out.withColumn("value", value).drop("__p", "__i", "__v", "__j")


def _joined(*parts: Column) -> Column:
    """A JSON object of parts that aren't empty."""
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda x: x != ""), ","), F.lit("}"))


def _inside(json_object: Column) -> Column:
    """What stands between the braces of a JSON object; empty for null."""
    return F.coalesce(F.substr(json_object, F.lit(2), F.length(json_object) - 2), F.lit(""))


def _quoted(text: Column) -> Column:
    """A text as JSON; null for null."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substr(whole, F.lit(6), F.length(whole) - 6))


def convert_timestamp(df: DataFrame, field: str, to: str, schema: str) -> DataFrame:
    """A time as text, ``unix`` seconds or ``unix_ms``, from any of them; numbers above 1e12 are milliseconds."""
    raw = F.get_json_object("value", f"$.{field}")
    number = raw.try_cast("double")
    time = F.when(number.isNotNull(), F.timestamp_millis(F.when(number > 1e12, number).otherwise(number * 1000).cast("bigint"))).otherwise(raw.try_cast("timestamp"))
    made = {"unix": F.unix_seconds(time), "unix_ms": F.unix_millis(time), "string": F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")}[to]
    kept = [F.col(f"__v.{c}") for c in StructType.fromDDL(schema).names if c != field]
    return df.withColumn("__v", F.from_json("value", schema)).withColumn("value", F.to_json(F.struct(*kept, made.alias(field)))).drop("__v")


def deduplicate(df: DataFrame, keys: list[str], ts: str, within: str, order: list[str], keep: str = "first") -> DataFrame:
    """Of a key's records in every interval the first or the last."""
    w = Window.partitionBy(*keys, F.window(ts, within)["start"])
    ordered = [F.col(c) if keep == "first" else F.col(c).desc() for c in order]
    return df.withColumn("__k", F.row_number().over(w.orderBy(*ordered))).where("__k = 1").drop("__k")


def if_node(df: DataFrame, test: str, true_topic: str, false_topic: str) -> DataFrame:
    return df.withColumn("topic", F.when(condition(test), true_topic).otherwise(false_topic))


def switch(df: DataFrame, path: str, cases: dict[str, str], default: str | None = None) -> DataFrame:
    """Routes by a field's value, any case; records without a case go to the default or are dropped."""
    table = F.create_map(*[F.lit(x) for k, v in cases.items() for x in (k.lower(), v)])
    topic = F.coalesce(F.try_element_at(table, F.lower(F.get_json_object("value", path))), F.lit(default))
    return df.withColumn("topic", topic).where("topic is not null")


def multi_output(df: DataFrame, routes: dict[str, str | None], broadcast: bool = True) -> DataFrame:
    """A copy for each route whose condition holds (None: always), or for the first one only."""
    found = F.filter(F.array(*(F.when(F.lit(True) if c is None else condition(c), F.lit(t)) for t, c in routes.items())), lambda t: t.isNotNull())
    return df.withColumn("topic", F.explode(found if broadcast else F.slice(found, 1, 1)))


def branch(df: DataFrame, *tests: Column) -> list[DataFrame]:
    """One result for each predicate; a row may be in several."""
    return [df.where(t) for t in tests]


def regex_router(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    return df.withColumn("topic", F.regexp_replace("topic", pattern, replacement))


def timestamp_router(df: DataFrame, ts: str = "timestamp", form: str = "yyyyMMdd") -> DataFrame:
    return df.withColumn("topic", F.concat("topic", F.lit("-"), F.date_format(ts, form)))


def priority(df: DataFrame, field: str, default: float, batch: Column, order: list[str], descending: bool = True) -> DataFrame:
    """Rows with their place within a batch once it is ordered by a priority field."""
    level = F.coalesce(F.get_json_object("value", f"$.{field}").try_cast("double"), F.lit(default))
    w = Window.partitionBy(batch).orderBy(level.desc() if descending else level.asc(), *order)
    return df.withColumn("place", F.row_number().over(w))


def repartition(df: DataFrame, partitions: int, how: str = "key", field: str | None = None, static: int = 0, order: list[str] = ()) -> DataFrame:
    """Records with the partition they go to: static, round_robin (in turn by ``order``, or in each task's own turn without one), field or key."""
    if how == "static":
        return df.withColumn("partition", F.lit(static))
    if how == "round_robin" and order:
        return numbered(df, list(order), "__n").withColumn("partition", (F.col("__n") % partitions).cast("int")).drop("__n")
    if how == "round_robin":
        return df.withColumn("partition", (F.monotonically_increasing_id() % partitions).cast("int"))
    key = F.get_json_object("value", f"$.{field}") if how == "field" else F.col("key")
    return df.withColumn("partition", F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int"))


def gate(df: DataFrame, signals: DataFrame, ts: str, buffer: bool = True, open_first: bool = True, slice_seconds: int = 600) -> DataFrame:
    """Records that a gate lets through, with ``released_at``. ``signals`` (ts, is_open) open and close it; while it is closed records wait
    for the next opening if ``buffer``, else they are dropped.

    Time is cut into slices that are worked on apart; each slice knows the state that earlier ones leave and the next opening in later
    ones from one row a slice, so no task sees the whole stream.
    """
    cell = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / slice_seconds).cast("bigint")
    sent = signals.select(F.col("ts").alias("__t"), F.col("is_open").alias("__open"), cell(F.col("ts")).alias("__c"))
    both = df.select(F.col(ts).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("boolean").alias("__open"), F.struct(*df.columns).alias("__r"), cell(F.col(ts)).alias("__c")).unionByName(
        sent.select("__t", F.lit(0).alias("__side"), "__open", F.lit(None).alias("__r"), "__c")
    )
    slices = both.groupBy("__c").agg(
        F.max_by("__open", F.when(F.col("__side") == 0, F.col("__t"))).alias("left"), F.min(F.when(F.col("__open"), F.col("__t"))).alias("opens")
    )
    w = Window.orderBy("__c")
    slices = slices.select("__c", F.last("left", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__was"), F.first("opens", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__then"))
    within = Window.partitionBy("__c").orderBy("__t", "__side")
    state = F.coalesce(F.last("__open", True).over(within.rowsBetween(Window.unboundedPreceding, 0)), F.col("__was"), F.lit(open_first))
    opening = F.coalesce(F.first(F.when(F.col("__open"), F.col("__t")), True).over(within.rowsBetween(0, Window.unboundedFollowing)), F.col("__then"))
    out = both.join(slices, "__c").withColumn("released_at", F.when(state, F.col("__t")).otherwise(opening if buffer else F.lit(None)))
    return out.where("__r is not null and released_at is not null").select("__r.*", "released_at")


def wait_for_input(left: DataFrame, right: DataFrame, key: str, ts: str, timeout: str) -> tuple[DataFrame, DataFrame]:
    """(pairs of records of a key within the timeout, left records that none joined in time)."""
    r = right.select(F.col(key), F.col(ts).alias("__ts"), F.struct(*[c for c in right.columns if c != key]).alias("other"))
    return interval_join(left, r, [key], ts, "__ts", timeout, timeout).drop("__ts"), interval_join(left, r, [key], ts, "__ts", timeout, timeout, "left_anti")


def loop(df: DataFrame, body, times: int) -> DataFrame:
    """A bounded loop: ``body`` applied ``times`` times, as one plan."""
    for _ in range(times):
        df = body(df)
    return df


def pipeline(df: DataFrame, *nodes) -> DataFrame:
    """Nodes one after another, each a function of records."""
    for node in nodes:
        df = node(df)
    return df


def dry_run(df: DataFrame, nodes: dict[str, object], rows: int = 20) -> dict[str, list[dict]]:
    """What each node of a pipeline makes of a few records."""
    trace, at = {}, df.limit(rows)
    for name, node in nodes.items():
        at = node(at)
        trace[name] = [json.loads(x) for x in at.toJSON().take(rows)]
    return trace
