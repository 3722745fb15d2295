"""Near-duplicate vectors: sign hashes of random hyperplanes in several tables, exact cosines, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, width
from .components import Union, connected_components
from .textnum import mix

BLOCK = 1024


def usable(vector: Column) -> Column:
    """Whether a vector is not null or zero and holds no null or non-finite component."""
    size = lambda x: F.abs(x.cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (size(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def plan_tables(rows: int, least: float, miss: float) -> tuple[int, int]:
    """(bits, tables): about two unrelated rows of the largest group share a bucket; a pair at ``least`` is missed with chance ``miss``."""
    bits = min(40, max(6, math.ceil(math.log2(max(rows, 2) / 2))))
    meet = (1 - math.acos(min(1.0, least)) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet)) if meet < 1 else 1


def signatures(units: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Rows by tables: each table's sign bits as one integer."""
    planes = np.random.default_rng([seed, units.shape[1]]).standard_normal((units.shape[1], tables * bits))
    signs = (units @ planes >= 0).reshape(len(units), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat**2).sum(axis=1))[:, None]


def _parts(batch: pa.RecordBatch, column: str):
    """(dimension, row numbers) of a batch."""
    sizes = np.asarray(batch.column(column).value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return [(int(d), np.flatnonzero(sizes == d)) for d in np.unique(sizes)]


def near_duplicates(vectors: DataFrame, least: float = 0.98, miss: float = 1e-5, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label; other columns are ignored).

    Vectors of equal, non-null label and equal size link at a cosine of ``least`` or more, in double precision; null, zero and
    non-finite vectors link with nothing. Equal vectors are compared once and count with their number; distinct ones are known by a
    number of their own, so rows that repeat a vec_id, with equal or other vectors or labels, count as vectors of their own. A null
    vec_id links with nothing; an empty table gives no rows. Buckets of over 1024 vectors are compared block by block, and only sums
    and spanning links leave a block.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label")
    good = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("h", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), F.reverse("embedding"), F.size("embedding")))
    distinct = good.groupBy("label", "h", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("embedding").alias("embedding"))
    reps = staged(distinct.withColumn("rep", F.monotonically_increasing_id()), "vectors-distinct")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits, tables = plan_tables(largest, least, miss)

    def deal(batches):
        for batch in batches:
            for dim, at in _parts(batch, "embedding"):
                sub = batch.take(pa.array(at))
                sigs = signatures(_matrix(sub.column("embedding"), dim), bits, tables, seed)
                salt = sub.column("label").to_numpy().view(np.uint64)
                key = mix(mix(salt + np.uint64(dim << 40))[:, None] + mix(sigs.astype(np.uint64) + (np.arange(tables, dtype=np.uint64) << np.uint64(40))))
                yield pa.RecordBatch.from_arrays([sub.column("rep"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(sub) * tables + 1, tables, dtype=np.int32)), pa.array(key.view(np.int64).ravel()))], names=["rep", "keys"])

    hashed = staged(reps.withColumn("label", F.xxhash64("label")).select("rep", "label", "embedding").mapInArrow(deal, "rep bigint, keys array<bigint>"), "vectors-keys")
    dealt = hashed.select("rep", F.posexplode("keys").alias("t", "key"))
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = staged(dealt.join(shared, "key").select("rep", "t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "vectors-buckets")
    loaded = members.join(reps.select("rep", "embedding", "copies"), "rep").join(hashed, "rep")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = loaded.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "t", "rep", "copies", "embedding", "keys")
    laid = pairs.repartition(width(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(batches):
        counts: dict[int, int] = {}
        links = Union()
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "lo", "hi")], 1)
            edge = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            cuts = [0, *edge.tolist()]
            _compare_groups(batch, cuts, counts, links, least)
            held = batch.slice(cuts[-1])
        if held is not None and len(held):
            _compare_groups(held, [0, len(held)], counts, links, least)
        ids, roots = links.stars()
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(counts) + [1] * len(ids), pa.int32()), pa.array([*counts, *ids], pa.int64()), pa.array([*counts.values(), *roots], pa.int64())], names=["kind", "a", "b"])

    met = staged(laid.mapInArrow(compare, "kind int, a bigint, b bigint"), "vectors-links")
    links = met.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    parts = connected_components(met.where("kind = 1").select("a", "b")).withColumnRenamed("id", "rep")
    names = parts.join(reps.select("rep", "least"), "rep").groupBy("component_id").agg(F.min("least").alias("name"))
    named = parts.join(names, "component_id").select("rep", "name")
    done = reps.join(links, "rep", "left").join(named, "rep", "left").select("label", "h", "h2", "copies", "links", F.coalesce("name", "least").alias("component_id"))
    keyed = rows.withColumn("ok", F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        "vec_id", F.when(F.col("ok"), F.col("label")).alias("label"), F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), F.reverse("embedding"), F.size("embedding")).alias("h2")
    )
    return keyed.join(done, ["label", "h", "h2"], "left").select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )


def _compare_groups(batch: pa.RecordBatch, cuts: list[int], counts: dict[int, int], links: Union, least: float) -> None:
    """Compare the rows within each group [cuts[k], cuts[k+1]) of a batch; a pair counts in the first table where it meets."""
    if len(cuts) < 2:
        return
    reps, copies, mine, t = (batch.column(c).to_numpy() for c in ("rep", "copies", "mine", "t"))
    lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
    keys = batch.column("keys").flatten().to_numpy().reshape(len(batch), -1)
    sizes = np.asarray(batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False), np.int64)
    dim = int(sizes[0])
    units = _matrix(batch.column("embedding"), dim) if (sizes == dim).all() else None
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a < 2:
            continue
        here = units[a:b] if units is not None else _matrix(batch.column("embedding").slice(a, b - a), int(sizes[a]))
        near = here @ here.T >= least
        np.fill_diagonal(near, False)
        if lo[a] != hi[a]:
            near &= mine[a:b][:, None] != mine[a:b][None, :]
        if not near.any():
            continue
        i, j = np.nonzero(near)
        k = keys[a:b, : t[a]]
        fresh = ~(k[i] == k[j]).any(axis=1) if len(i) < 50_000 else np.concatenate([~(k[i[s : s + 50_000]] == k[j[s : s + 50_000]]).any(axis=1) for s in range(0, len(i), 50_000)])
        i, j = i[fresh], j[fresh]
        for x, n in zip(reps[a:b].tolist(), np.bincount(i, copies[a:b][j], b - a).astype(np.int64).tolist(), strict=True):
            if n:
                counts[x] = counts.get(x, 0) + n
        first = np.full(b - a, -1)
        while True:  # spanning links: each row to the least row that its neighbours lead to
            now = np.where(first < 0, np.arange(b - a), first)
            low = now.copy()
            np.minimum.at(low, i, now[j])
            if (low == now).all():
                break
            first = low
        for x in np.unique(i).tolist():
            links.join(int(reps[a + x]), int(reps[a + now[x]]))
