"""Schemas: inference from JSON, migration of rows, compatibility of versions, vector checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType

_WIDER = [ShortType(), IntegerType(), LongType(), FloatType(), DoubleType()]


def infer(df: DataFrame, column: str) -> StructType:
    """The schema that the JSON texts of a column share, types widened."""
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0]
    return DataType.fromDDL(found.replace("OBJECT<", "STRUCT<")) if found and found.startswith("OBJECT<") else StructType()


def _hex(x: Column) -> Column:
    return F.coalesce(F.unhex(F.concat(F.repeat(F.lit("0"), F.length(x) % 2), x)).isNotNull(), F.lit(False))


def text_format(x: Column) -> Column:
    """date-time, date, ipv4, ipv6, uuid, email, uri or null: what Spark's own parsers take the text for, or its parts look like."""
    dots, dashes, colons, at = (F.split(x, sep) for sep in (r"\.", "-", ":", "@"))
    number = lambda p: F.coalesce(p.try_cast("int").between(0, 255) & (p.try_cast("int").cast("string") == p), F.lit(False))
    sizes = F.transform(dashes, lambda p: F.length(p))
    short = lambda p: (F.length(p) <= 4) & _hex(p)
    gaps = F.size(F.split(x, "::")) - 1
    tests = {
        "date-time": x.contains(":") & (F.size(dashes) >= 3) & F.try_to_timestamp(x).isNotNull(),
        "date": (F.length(x) == 10) & (F.size(dashes) == 3) & x.try_cast("date").isNotNull(),
        "ipv4": (F.size(dots) == 4) & F.forall(dots, number),
        "uuid": (sizes == F.array(*map(F.lit, (8, 4, 4, 4, 12)))) & F.forall(dashes, _hex),
        "ipv6": (F.size(colons) >= 3) & F.forall(colons, short) & (((gaps == 0) & (F.size(colons) == 8)) | ((gaps == 1) & (F.size(colons) <= 8))),
        "email": (F.size(at) == 2) & (F.length(at[0]) > 0) & at[1].contains(".") & ~x.contains(" ") & ~at[1].startswith(".") & ~at[1].endswith("."),
        "uri": x.contains("://") & F.try_parse_url(x, F.lit("PROTOCOL")).isNotNull(),
    }
    return F.coalesce(*(F.when(test, name) for name, test in tests.items()))


def field_statistics(df: DataFrame, column: str) -> DataFrame:
    """(field, present, nulls, nullable, format) of the top-level fields of a column's JSON objects; a format that all its texts share.

    A field is nullable if some object lacks it or has it null.
    """
    objects = df.select(F.from_json(column, "map<string,variant>").alias("m")).where("m is not null")
    total = objects.agg(F.count(F.lit(1)).alias("total"))
    fields = objects.select(F.explode("m").alias("field", "v"))
    text = F.when(F.schema_of_variant("v") == "STRING", F.col("v").cast("string"))
    each = fields.select("field", F.coalesce(F.is_variant_null("v"), F.lit(True)).alias("null"), F.coalesce(text_format(text), F.when(text.isNotNull(), "")).alias("form"))
    counted = each.groupBy("field").agg(F.count(F.lit(1)).alias("present"), F.count_if("null").alias("nulls"), F.min("form").alias("lo"), F.max("form").alias("hi"))
    joined = counted.join(F.broadcast(total))
    nullable = (F.col("nulls") > 0) | (F.col("present") < F.col("total"))
    return joined.select("field", "present", "nulls", nullable.alias("nullable"), F.when((F.col("lo") == F.col("hi")) & (F.col("lo") != ""), F.col("lo")).alias("format"))


def migrate(df: DataFrame, changes: list[tuple]) -> DataFrame:
    """Applies changes: ("add", name, type, default), ("remove", name), ("rename", old, new), ("cast", name, type), ("require", name, default)."""
    for what, name, *rest in changes:
        if what == "add":
            df = df.withColumn(name, F.lit(rest[1]).cast(rest[0]))
        elif what == "remove":
            df = df.drop(name)
        elif what == "rename":
            df = df.withColumnRenamed(name, rest[0])
        elif what == "cast":
            df = df.withColumn(name, F.col(name).try_cast(rest[0]))
        elif what == "require":
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(rest[0])))
        else:
            raise ValueError(what)
    return df


def _widens(old: DataType, new: DataType) -> bool:
    return old == new or (old in _WIDER and new in _WIDER and _WIDER.index(old) <= _WIDER.index(new))


def can_read(reader: StructType, writer: StructType) -> list[str]:
    """Why rows of ``writer`` can't be read as ``reader``; empty if they can."""
    had, why = {f.name: f for f in writer.fields}, []
    for f in reader.fields:
        if f.name not in had:
            why += [] if f.nullable else [f"{f.name} is required and missing"]
        elif not _widens(had[f.name].dataType, f.dataType):
            why.append(f"{f.name}: {had[f.name].dataType.simpleString()} is no {f.dataType.simpleString()}")
        elif had[f.name].nullable and not f.nullable:
            why.append(f"{f.name} may be null")
    return why


def compatible(new: StructType, versions: list[StructType], mode: str) -> list[str]:
    """Why a new version breaks a mode: none, backward, forward, full, each with _transitive for all former versions."""
    kind, _, every = mode.partition("_")
    why: list[str] = []
    for old in versions if every else versions[-1:]:
        why += can_read(new, old) if kind in ("backward", "full") else []
        why += can_read(old, new) if kind in ("forward", "full") else []
    return why


def vector_ok(x: Column, dim: int) -> Column:
    """Whether a vector has the declared number of components, all finite."""
    return F.coalesce((F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))), F.lit(False))
