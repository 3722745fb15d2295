"""Context-triggered piecewise hashing: rolling-hash boundaries cut a text into chunks, a fingerprint names each chunk by twelve bits.

A boundary follows byte i where the hash of the seven bytes up to i ends in ``level`` zero bits. A text's block size is
2**level for the least level that leaves at most 63 boundaries; its fingerprint holds the chunk signatures at that level and at the
next, so texts whose block sizes differ by a factor of two still compare. Likeness is one minus the edit distance (insertions and
deletions) of two signatures at a shared block size, over their joint length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches, width
from .textnum import powers

MOST = 63
SPAN = 7
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
MIX = np.uint64(0xD6E8FEB86659FD93)


def fingerprint(data: bytes) -> str:
    """level:signature:signature at the next level; ``0::`` for no data."""
    n = len(data)
    if not n:
        return "0::"
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    window = raw.copy()
    for k in range(1, SPAN):
        window[k:] |= raw[:-k] << np.uint64(8 * k)
    mixed = (window * MIX) >> np.uint64(40)
    inner = mixed[:-1]
    at = np.flatnonzero((inner & np.uint64(3)) == 0)
    low = inner[at]
    levels = np.full(len(at), 32, np.int64)
    some = low > 0
    levels[some] = np.log2((low[some] & (~low[some] + np.uint64(1))).astype(np.float64)).astype(np.int64)
    counts = np.bincount(levels, minlength=34)[::-1].cumsum()[::-1]
    level = next(k for k in range(2, 34) if counts[k] <= MOST)
    up, down = powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * up[:n])])
    return f"{level}:{_signature(sums, down, at[levels >= level], n)}:{_signature(sums, down, at[levels > level], n)}"


def _signature(sums: np.ndarray, down: np.ndarray, at: np.ndarray, n: int) -> str:
    starts, ends = np.concatenate([[0], at + 1]), np.concatenate([at + 1, [n]])
    chunk = (sums[ends] - sums[starts]) * down[starts] * MIX
    return LETTERS[np.stack([(chunk >> np.uint64(58)), (chunk >> np.uint64(52)) & np.uint64(63)], 1).astype(np.int64)].tobytes().decode()


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a machine word of matches at a time."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def likeness(one: str | None, other: str | None) -> float:
    """0 to 1; 1 for equal fingerprints, 0 without a shared block size."""
    if one is None or other is None:
        return 0.0
    if one == other:
        return 1.0
    (k, a, a2), (m, b, b2) = one.split(":"), other.split(":")
    pairs = {0: [(a, b), (a2, b2)], 1: [(a2, b)], -1: [(a, b2)]}.get(int(m) - int(k), [])
    best = 0.0
    for x, y in pairs:
        x, y = [x[i : i + 2] for i in range(0, len(x), 2)], [y[i : i + 2] for i in range(0, len(y), 2)]
        if x and y:
            best = max(best, 2 * _common(x, y) / (len(x) + len(y)))
    return best


def add_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text (null: empty); other columns, rows and repeats stay as they are."""

    def run(batches):
        for batch in batches:
            prints = pa.array([fingerprint((x or "").encode()) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, out])

    docs = docs.drop(out)
    return docs.mapInArrow(run, docs.withColumn(out, F.lit("")).schema)


def likeness_column(one: Column, other: Column) -> Column:
    return F.pandas_udf(lambda a, b: a.combine(b, likeness), "double")(one, other)


EDITED = "doc_id bigint, n_chars bigint, next_id bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, use, schema: str) -> DataFrame:
    """Run ``use(rows)`` over runs of documents in descending doc_id; rows yields (doc_id, text, next_id, next_text).

    The document after the last is the first. Ids are cut into ranges of about equal size; each range's first document goes
    along with the range before it too, so texts move once, and a range is worked through as a stream. Repeated ids stand side by
    side, ordered by text; null ids come last.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = max(2, 2 * width(docs.sparkSession))
    cuts = sorted({int(c) for c in docs.stat.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges)}, reverse=True)
    dealt = docs.withColumn("range", _range_of(cuts))
    firsts = dealt.groupBy("range").agg(F.max("doc_id").alias("head")).orderBy("range").collect()
    heads, leads = [None] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for k, r in enumerate(firsts):
        heads[r["range"]], leads[r["range"]] = r["head"], firsts[k - 1]["range"]
    heads, leads = F.array(*[F.lit(x).cast("bigint") for x in heads]), F.array(*[F.lit(x) for x in leads])
    own = F.struct(F.col("range").alias("to"), F.lit(False).alias("tail"))
    ahead = F.struct(F.get(leads, F.col("range")).alias("to"), F.lit(True).alias("tail"))
    is_head = F.col("doc_id").eqNullSafe(F.get(heads, F.col("range")))
    twice = dealt.select("doc_id", "text", F.explode(F.when(is_head, F.array(own, ahead)).otherwise(F.array(own))).alias("d"))
    laid = twice.select("d.to", "d.tail", "doc_id", "text").repartition(max(1, len(firsts)), "to")
    laid = laid.sortWithinPartitions("to", "tail", F.desc_nulls_last("doc_id"), "text")

    def rows(batches):
        held = None
        for batch in batches:
            for to, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] == to:
                    yield held[1], held[2], doc_id, text
                held = None if tail else (to, doc_id, text)

    return laid.mapInArrow(lambda batches: use(rows(batches)), schema)


def _range_of(cuts: list[float]) -> Column:
    """How many of the descending cuts lie above an id, by binary search in a literal array; null ids go behind the last."""
    lo, hi = 0, len(cuts)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < F.lit(int(cuts[mid])), search(mid + 1, hi)).otherwise(search(lo, mid))

    return F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(search(lo, hi))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of the text with its last half replaced by the next document's head, and their likeness.

    A null text counts as empty; an empty text is edited to itself; a lone document is its own next; repeated ids follow each other
    in the order of their texts, a null doc_id comes last; other columns are ignored; an empty table gives no rows.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    names = [x.split(" ")[0] for x in EDITED.split(", ")]

    def use(rows):
        out, last = [], ("", "0::")
        for doc_id, text, next_id, following in rows:
            mine = last[1] if last[0] is text else fingerprint(text.encode())
            last = (following, fingerprint(following.encode()))
            half = len(text) // 2
            edited = (text[: len(text) - half] + following[:half]).encode()
            changed = fingerprint(edited)
            out.append((doc_id, len(text), next_id, hashlib.sha256(edited).hexdigest(), mine, changed, likeness(mine, changed), likeness(mine, last[1])))
            if len(out) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    text_batches(docs.sparkSession)
    return with_next(docs, use, EDITED)
