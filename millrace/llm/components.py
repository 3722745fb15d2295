"""Connected components of a table of links, distributed: local union, then hooking and pointer jumping to a fixed point."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


class Union:
    """Union-find by least id over the links of one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        ids = [x for x in self.up if self.root(x) != x]
        return ids, [self.root(x) for x in ids]


def _contract(batches):
    links = Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            links.join(a, b)
    ids, roots = links.stars()
    for k in range(0, len(ids), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 100_000], pa.int64()), pa.array(roots[k : k + 100_000], pa.int64())], names=["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every id in ``links`` (two bigint columns): the least id that links reach.

    Null ends and links of an id to itself are ignored; repeated links do no harm. Each task first shrinks its own links to
    stars; hot ids meet only in partial minima and in joins that adaptive execution can split.
    """
    a, b = links.columns[:2]
    plain = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    stars = plain.mapInArrow(_contract, "a bigint, b bigint")
    both = staged(stars.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct(), "cc-links")
    at = staged(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("p")), "cc-parents")
    while True:
        near = both.join(at.select(F.col("id").alias("v"), "p"), "v").groupBy("u").agg(F.min("p").alias("m"))
        met = staged(at.join(near.withColumnRenamed("u", "id"), "id"), "cc-met")
        hooks = met.groupBy(F.col("p").alias("id")).agg(F.min("m").alias("h"))
        hooked = staged(met.join(hooks, "id", "left").select("id", F.col("p").alias("old"), F.least("p", "m", "h").alias("q")), "cc-hooked")
        jumped = hooked.join(hooked.select(F.col("id").alias("q"), F.col("q").alias("p")), "q").select("id", "old", "p")
        former, at = at, staged(jumped, "cc-parents")
        discard(former, met, hooked)
        if at.where("old <> p").isEmpty():
            return at.select("id", F.col("p").alias("component_id"))
