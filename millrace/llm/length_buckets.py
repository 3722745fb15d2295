"""Packing into optimal length buckets.

A global histogram of lengths is all that leaves the tasks; dynamic programming over it finds the bucket bounds that minimise
padding. Inside each bucket, sequences form batches of a fixed token budget: a bucket padded to ``pad`` tokens puts
budget // pad sequences (one at least) into a batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, staged

#: Rows that are numbered together.
BLOCK_ROWS = 200_000


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over sorted distinct lengths that minimise the sum of (bound - length) * count.

    cost(i, j) obeys the quadrangle inequality, so the best cut moves one way and each layer needs O(n log n) evaluations.
    """
    n = len(lengths)
    if n <= buckets:
        return lengths.tolist()
    upto = np.concatenate([[0.0], np.cumsum(counts.astype(np.float64))])
    cost = np.concatenate([[0.0], lengths.astype(np.float64) * upto[1:]])  # one bucket of the first j bins, padded
    cuts = np.zeros((buckets, n + 1), np.int32)
    for layer in range(1, buckets):
        best, now = np.full(n + 1, np.inf), cuts[layer]
        best[0] = 0.0
        spans = [(1, n, 0, n - 1)]
        while spans:
            ahead = []
            for a, b, lo, hi in spans:
                mid = (a + b) // 2
                i = np.arange(lo, min(mid - 1, hi) + 1)
                value = cost[i] + lengths[mid - 1] * (upto[mid] - upto[i])
                k = int(value.argmin())
                best[mid], now[mid] = value[k], i[k]
                if a < mid:
                    ahead.append((a, mid - 1, lo, int(i[k])))
                if mid < b:
                    ahead.append((mid + 1, b, int(i[k]), hi))
            spans = ahead
        cost = best
    bounds, j = [], n
    for layer in range(buckets - 1, -1, -1):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cuts[layer][j])
    return bounds[::-1]


def word_count(text: Column) -> Column:
    """Words between white space, and one for the end."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("bigint")


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 65_536, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, bucket, pad_to, batch, slot, padding) for each row of ``docs``, with the columns named in ``carry``; others are ignored.

    ``length`` (words of ``text`` and an end if not given) is at least 1; null counts as 1. Every row is packed once: repeated rows get
    slots of their own, a sequence longer than the budget fills a batch alone, an empty table gives no rows. Batches are numbered within
    a bucket, slots within a batch; rows of equal length may stand in any order. Numbering adds per-block offsets, so no bucket
    passes through one task. The histogram has a row for each distinct length: fewer than the square root of twice the sum of all lengths.
    """
    spark = docs.sparkSession
    length = word_count(F.col("text")) if length is None else length
    whole = docs.select("doc_id", *carry, F.greatest(F.coalesce(length.cast("bigint"), F.lit(1)), F.lit(1)).alias("n_tokens"))
    sized = staged(whole.withColumn("row", F.monotonically_increasing_id()), "pack-lengths")
    histogram = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").collect()
    lengths, each = (np.array([r[c] for r in histogram], np.int64) for c in ("n_tokens", "n"))
    bounds = optimal_bounds(lengths, each, buckets) if histogram else [1]
    limits = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    bucket = F.size(F.filter(limits, lambda b: b < F.col("n_tokens")))
    blocks = max(64, -(-int(each.sum()) // BLOCK_ROWS))
    placed = sized.withColumn("bucket", bucket).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    counts = placed.groupBy("bucket", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("bucket", "block").orderBy("doc_id", "n_tokens", "row")) - 1)
    numbered = numbered.join(hinted(staged(offsets, "pack-offsets")), ["bucket", "block"])
    pad = F.get(limits, F.col("bucket"))
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / pad)).cast("bigint")
    at = F.col("k") + F.col("offset")
    return numbered.select(
        "doc_id", "n_tokens", "bucket", pad.alias("pad_to"), F.floor(at / per).cast("bigint").alias("batch"), (at % per).cast("bigint").alias("slot"), (pad - F.col("n_tokens")).alias("padding"), *carry
    )


def fill_batches(docs: DataFrame, ids: str = "token_ids", pad: int = 0, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """(bucket, batch, pad_to, doc_ids, sizes, tokens): the batches of ``docs`` (doc_id, ids) as rows of token ids, each padded to its bucket's bound.

    A sequence without ids counts as one padding token. A batch holds ``budget`` ids at most, or one longer sequence.
    """
    rows = docs.select("doc_id", F.coalesce(ids, F.array().cast(docs.schema[ids].dataType)).alias("__ids"))
    packed = pack(rows, F.size("__ids"), buckets, budget, ("__ids",))
    filled = F.concat("__ids", F.array_repeat(F.lit(pad).cast("int"), (F.col("pad_to") - F.size("__ids")).cast("int")))
    row = F.struct("slot", "doc_id", F.size("__ids").alias("size"), filled.alias("tokens"))
    grouped = packed.groupBy("bucket", "batch", "pad_to").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return grouped.select("bucket", "batch", "pad_to", F.col("rows.doc_id").alias("doc_ids"), F.col("rows.size").alias("sizes"), F.col("rows.tokens").alias("tokens"))
