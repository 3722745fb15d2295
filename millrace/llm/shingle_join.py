"""N-gram Jaccard join by parity sketches.

Every shingle of a document flips one bit of a wide sketch, so the Hamming distance of two sketches never exceeds the symmetric
difference of their sets. At a Jaccard likeness of 4/5 or more two sets differ in at most a ninth of their joint size. A sketch cut into
more parts than that shares parts with every partner: parts, XOR-hashed to 64 bits, are join keys. Part counts are fixed for each band
of set sizes; a document emits keys in its own band and in the next smaller one, which covers all sizes a partner may have.

A part is a stretch of 2**32 bits or more, kept as the XOR of its set bits' codes. Empty parts are equal too often to help: each band has
spare parts, and a document emits its empty parts only where it has more of them than the band has to spare, so no pair is lost.

Hashes only propose pairs: what links is decided on the words of both texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, staged, text_batches, width
from .components import connected_components
from .textnum import SPACE, Buffer, blocks, mix

WORDS = 5
#: Rows of candidate groups with one least id that go to one task.
SPREAD = 5_000
#: Bytes of text whose parts meet in one shard, and ids of a candidate group in one row.
SHARD_BYTES, CHUNK = 32_000_000, 10_000
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
LIMITS = [1]
while LIMITS[-1] < 1 << 40:
    LIMITS.append(LIMITS[-1] * 5 // 4 + 1)
LIMITS = np.array(LIMITS)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word shingles of each text, sorted by row; a text of fewer words has its whole sequence as one."""
    buffer = Buffer(texts)
    starts, ends, row = buffer.words(SPACE)
    word = buffer.hashes(starts, ends)
    full = np.flatnonzero(row[WORDS - 1 :] == row[: len(row) - WORDS + 1]) if len(row) >= WORDS else np.zeros(0, np.int64)
    rows, sums = [row[full]], [sum((word[full + k] * STEP ** np.uint64(k + 1) for k in range(WORDS)), np.zeros(len(full), np.uint64))]
    counts = np.bincount(row, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    for n in range(1, WORDS):
        few = np.flatnonzero(counts == n)
        rows.append(few)
        sums.append(sum((word[first[few] + k] * STEP ** np.uint64(k + 1) for k in range(n)), np.full(len(few), n, np.uint64)))
    rows, codes = np.concatenate(rows), mix(np.concatenate(sums))
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    return rows[new], codes[new]


def shared_shingles(one: pa.Array, other: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of texts the sizes of both shingle sets and of their intersection, by the words themselves."""
    n = len(one)
    buffer = Buffer(pa.chunked_array([one, other], pa.string()))
    starts, ends, row = buffer.words(SPACE)
    ids = np.append(buffer.exact_ids(starts, ends), len(row))  # the last number stands for no word
    counts = np.bincount(row, minlength=2 * n)
    first = np.cumsum(counts) - counts
    full = np.flatnonzero(row[WORDS - 1 :] == row[: len(row) - WORDS + 1]) if len(row) >= WORDS else np.zeros(0, np.int64)
    at = np.concatenate([full, first[(counts > 0) & (counts < WORDS)]])
    whose = row[at]
    name = ids[at]
    for k in range(1, WORDS):
        there = np.minimum(at + k, len(row))
        there = np.where((there < len(row)) & (np.append(row, -1)[there] == whose), there, len(row))
        name = np.unique(name * np.int64(len(ids)) + ids[there], return_inverse=True)[1]
    pair, right = whose % max(n, 1), whose >= n
    kind = pair * np.int64(len(ids) + 1) + name
    left_set, right_set = np.unique(kind[~right]), np.unique(kind[right])
    sizes = [np.bincount(x // (len(ids) + 1), minlength=n) for x in (left_set, right_set, np.intersect1d(left_set, right_set, assume_unique=True))]
    return sizes[0], sizes[1], sizes[2]


def band_parts(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, parts to spare) of each band: a pair whose smaller set lies in it shares at least one part more than it spares."""
    small = LIMITS[band + 1] - 1
    differ = (small + small * 5 // 4) // 9
    spare = 4 + differ * 2 // 25
    return differ + 1 + spare, spare


def part_keys(rows: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every part that a document emits, for the band of its size and for the next smaller one."""
    own = np.searchsorted(LIMITS, np.maximum(sizes, 1), "right") - 1
    out = []
    for back in (0, 1):
        band = own - back
        some = (sizes > 0) & (band >= 0)
        parts, spare = band_parts(np.maximum(band, 0))
        parts = np.where(some, parts, 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        use = some[rows]
        r, c = rows[use], codes[use]
        salted = mix(c ^ (band[r].astype(np.uint64) * STEP))
        part = ((salted >> np.uint64(32)) * parts[r].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        flat = base[r] + part
        order = np.argsort(flat, kind="stable")
        flat, bits = flat[order], mix(c[order] + np.uint64(1))
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        held, sums = flat[first], np.bitwise_xor.reduceat(bits, first) if len(first) else np.zeros(0, np.uint64)
        full = np.bincount(np.searchsorted(base, held, "right") - 1, minlength=len(sizes))[: len(sizes)]
        poor = np.flatnonzero(parts - full > spare)
        if len(poor):
            every = np.concatenate([np.arange(base[p], base[p + 1]) for p in poor])
            empty = np.setdiff1d(every, held, assume_unique=True)
            held, sums = np.concatenate([held, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        row = np.searchsorted(base, held, "right") - 1
        place = (held - base[row]).astype(np.uint64) + (band[row].astype(np.uint64) << np.uint64(44))
        out.append((row, mix(sums + mix(place))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def parity_sketches(rows: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A parity sketch of each document, twice as many bits as shingles, rounded up to a power of two."""
    bits = 1 << np.maximum(8, np.ceil(np.log2(np.maximum(2 * sizes, 2))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    flat = base[rows] + (codes & (bits[rows] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(flat, minlength=base[-1]) & 1).astype(np.uint8))
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(base[:-1], base[1:], strict=True)]


def sketch_distance(one: bytes, other: bytes) -> int:
    """A lower bound of the symmetric difference: the wider sketch folds onto the narrower."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def may_link(n: int, m: int, one: bytes, other: bytes) -> bool:
    return 5 * min(n, m) >= 4 * max(n, m) and 9 * sketch_distance(one, other) <= n + m


PACKED = "shard int, ids binary, a binary, b binary, sketches array<binary>"
MET = "kind int, a bigint, b bigint, n bigint, docs array<bigint>, sketch binary"


def _deal(shards: int):
    def deal(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                ids = batch.column(0).slice(a, b - a).to_numpy()
                rows, codes = shingles(batch.column(1).slice(a, b - a))
                leads = np.flatnonzero(batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False))
                sizes = np.bincount(rows, minlength=len(ids))
                whole = np.zeros(len(ids), np.uint64)
                edges = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else []
                if len(rows):
                    whole[rows[edges]] = np.add.reduceat(mix(codes + np.uint64(7)), edges)
                _, first = np.unique(np.stack([sizes.astype(np.uint64), whole], 1)[leads], axis=0, return_index=True)
                lead = np.zeros(len(ids), bool)
                lead[leads[first]] = True
                out = [(-1 - int(ids[0]) % shards, ids.tobytes(), sizes.astype(np.int64).tobytes(), whole.tobytes(), parity_sketches(rows, codes, sizes))]
                keep = lead[rows]
                row, key = part_keys(rows[keep], codes[keep], np.where(lead, sizes, 0))
                shard = (key >> np.uint64(33)).astype(np.int64) % shards
                order = np.argsort(shard, kind="stable")
                row, key, shard = row[order].astype(np.uint32), key[order], shard[order]
                cuts = np.searchsorted(shard, np.arange(shards + 1))
                for s in range(shards):
                    if cuts[s] < cuts[s + 1]:
                        part = row[cuts[s] : cuts[s + 1]]
                        used, local = np.unique(part, return_inverse=True)
                        out.append((s, ids[used].tobytes(), key[cuts[s] : cuts[s + 1]].tobytes(), local.astype(np.uint32 if len(used) > 65535 else np.uint16).tobytes(), None))
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
                for k in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 64], strict=True), kinds, strict=True)], names=["shard", "ids", "a", "b", "sketches"])

    return deal


def _met(kind, a=(), b=(), n=(), docs=None, sketch=None) -> pa.Table:
    size = len(a) if docs is None else len(docs)
    column = lambda x, t: pa.array(x, t) if x is not None and len(x) else pa.nulls(size, t)
    return pa.table([pa.array(np.full(size, kind, np.int32)), column(a, pa.int64()), column(b, pa.int64()), column(n, pa.int64()), docs if docs is not None else pa.nulls(size, pa.list_(pa.int64())), column(sketch, pa.binary())], names=["kind", "a", "b", "n", "docs", "sketch"])


def _meet(table: pa.Table) -> pa.Table:
    """One shard: profiles pass through; equal keys make groups of documents, and star links to each group's least id."""
    out = []
    keys, docs = [], []
    for shard, ids, a, b, sketches in zip(*(c.to_pylist() for c in table.columns), strict=True):
        ids = np.frombuffer(ids, np.int64)
        if shard < 0:
            out.append(_met(0, ids, np.frombuffer(b, np.int64), np.frombuffer(a, np.int64), sketch=sketches))
        else:
            keys.append(np.frombuffer(a, np.uint64))
            docs.append(ids[np.frombuffer(b, np.uint16 if len(b) == 2 * len(keys[-1]) else np.uint32)])
    if keys:
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        keys, docs = keys[new], docs[new]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        lists = np.stack([np.add.reduceat(mix(docs.view(np.uint64)), starts), sizes.astype(np.uint64)], 1)
        many = np.flatnonzero(sizes > 1)
        if len(many):
            in_many = np.repeat(sizes > 1, sizes)
            docs, lead = docs[in_many], np.repeat(docs[starts], sizes)[in_many]
            known, at = np.unique(docs, return_inverse=True)
            pair, count = np.unique(at[docs != lead] * len(known) + np.searchsorted(known, lead[docs != lead]), return_counts=True)
            out.append(_met(1, known[pair // len(known)], known[pair % len(known)], count.astype(np.int64)))
            _, once = np.unique(lists[many], axis=0, return_index=True)
            ends = np.cumsum(sizes[many])
            begins = ends - sizes[many]
            rows = [(k, x, min(x + CHUNK, ends[k])) for k in np.sort(once) for x in range(begins[k], ends[k], CHUNK)]
            group = np.array([k for k, _, _ in rows])
            picks = np.concatenate([np.arange(x, y) for _, x, y in rows])
            offsets = np.concatenate([[0], np.cumsum([y - x for _, x, y in rows])]).astype(np.int32)
            name = mix(lists[many][group, 0] ^ mix(lists[many][group, 1])).view(np.int64)
            out.append(_met(2, name, docs[begins[group]], docs=pa.ListArray.from_arrays(pa.array(offsets), pa.array(docs[picks]))))
    return pa.concat_tables(out) if out else _met(0)


def _sizes(batches):
    for batch in batches:
        for a, b in blocks(batch.column(0)):
            rows, _ = shingles(batch.column(0).slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array(np.bincount(rows, minlength=b - a).astype(np.int64))], names=["n_shingles"])


def _leads(docs: DataFrame) -> DataFrame:
    """(doc_id, text, leads): of a text's copies only the one of least id leads.

    Copies that don't lead send no parts: their equal sets link them. A group with a third of all rows is thus one row where parts meet.
    """
    same = {"h": F.xxhash64("text"), "h2": F.hash("text"), "size": F.octet_length("text")}
    named = [c.alias(name) for name, c in same.items()]
    counted = docs.groupBy(*named).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lead"))
    copied = staged(counted.where("n > 1").select(*same, "lead"), "shingle-copied")
    keyed = docs.select("doc_id", "text", *named).join(hinted(copied), list(same), "left")
    return keyed.select("doc_id", "text", F.coalesce(F.col("doc_id") == F.col("lead"), F.lit(True)).alias("leads"))


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets' exact likeness is 4/5 or more."""
    pairs = staged(pairs, "shingle-pairs")
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "shingle-ids")
    texts = staged(docs.join(hinted(ids, 2_000_000), "doc_id", "left_semi").select("doc_id", "text"), "shingle-texts")
    both = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "x"}), "a").join(texts.withColumnsRenamed({"doc_id": "b", "text": "y"}), "b")

    def run(batches):
        for batch in batches:
            sizes = pc.add(pc.binary_length(batch.column("x")), pc.binary_length(batch.column("y")))
            for a, b in blocks(sizes):
                n, m, k = shared_shingles(batch.column("x").slice(a, b - a), batch.column("y").slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(100 * k >= 80 * (n + m - k)))

    return both.mapInArrow(run, "a bigint, b bigint")


def _filtered(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketches allow a link, with ``same`` where the sets are equal."""
    one = profile.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha"), F.col("sketch").alias("sa"))
    two = profile.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"), F.col("sketch").alias("sb"))
    joined = pairs.join(one, "a").join(two, "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")

    def run(batches):
        for batch in batches:
            keep, same = [], []
            for na, nb, ha, hb, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ha", "hb", "sa", "sb")), strict=True):
                same.append(na == nb and ha == hb and sa == sb)
                keep.append(same[-1] or may_link(na, nb, sa, sb))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.bool_())], names=["a", "b", "same"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a bigint, b bigint, same boolean")


def _across(groups: DataFrame, profile: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs of different components within a group that sizes and sketches allow: no other rows leave a task."""
    members = groups.select("g", "lead", F.explode("docs").alias("id")).distinct()
    placed = members.join(parts, "id", "left").withColumn("c", F.coalesce("component_id", "id")).select("g", "lead", "id", "c")
    placed = staged(placed, "shingle-members")
    mixed = placed.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("g")
    open_ = staged(placed.join(mixed, "g", "left_semi"), "shingle-open")
    known = profile.select(F.col("doc_id").alias("id"), "n", "sketch")
    # groups of one least id share most of their pairs: they go to one task, which puts a pair out once, or to more tasks where they are many
    spread = open_.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / SPREAD).alias("tasks"))
    dealt = open_.join(hinted(staged(spread, "shingle-spread")), "lead").withColumn("deal", F.pmod("g", F.col("tasks")))
    laid = dealt.join(known, "id").select("g", "c", "id", "n", "sketch", "lead", "deal").repartition(width(groups.sparkSession), "lead", "deal")
    laid = laid.sortWithinPartitions("g", "n").drop("lead", "deal")

    def enumerate_(rows: list[tuple], found: set) -> None:
        n = np.array([r[3] for r in rows])
        widths = np.array([len(r[4]) for r in rows])
        comp = np.array([r[1] for r in rows])
        for k, row in enumerate(rows):
            last = int(np.searchsorted(n, row[3] * 5 // 4, "right"))
            near = np.arange(k + 1, last)[comp[k + 1 : last] != row[1]]
            for w in np.unique(widths[near]):
                some = near[widths[near] == w]
                stack = np.frombuffer(b"".join([rows[j][4] for j in some]), np.uint64).reshape(len(some), -1)
                mine = np.frombuffer(row[4], np.uint64)
                while stack.shape[1] > len(mine):
                    half = stack.shape[1] // 2
                    stack = stack[:, :half] ^ stack[:, half:]
                ok = 9 * np.bitwise_count(stack ^ mine).sum(axis=1, dtype=np.int64) <= row[3] + n[some]
                found.update((min(row[2], rows[j][2]), max(row[2], rows[j][2])) for j in some[ok])

    def run(batches):
        held: list[tuple] = []
        found: set = set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    enumerate_(held, found)
                    held = []
                held.append(row)
            if len(found) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
                found = set()
        if held:
            enumerate_(held, found)
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return laid.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents link at a Jaccard likeness of 4/5 or more of their sets of five-word shingles. Texts that are null or without words
    have an empty set and link with nothing; rows that repeat a doc_id are one document whose texts may each bring links; rows
    without a doc_id link with nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id is not null")
    shards = max(2 * width(spark), (docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0) // SHARD_BYTES)
    packed = _leads(known).mapInArrow(_deal(shards), PACKED)
    met = staged(packed.groupBy("shard").applyInArrow(_meet, MET), "shingle-met")
    profile = met.where("kind = 0").select(F.col("a").alias("doc_id"), "n", F.col("b").alias("h"), "sketch")
    stars = met.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("n"))
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    marked = profile.where("n > 0").select("doc_id", "n", "h", F.xxhash64("sketch").alias("h2"))
    equal = marked.groupBy("n", "h", "h2").agg(F.min("doc_id").alias("least"))
    copies = marked.join(equal, ["n", "h", "h2"]).where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    likely = staged(_filtered(best, profile).where("not same").select("a", "b").distinct(), "shingle-likely")
    first = staged(copies.unionByName(_verified(known, likely)), "shingle-links")
    parts = connected_components(first)
    groups = met.where("kind = 2").select(F.col("a").alias("g"), F.col("b").alias("lead"), "docs")
    across = _across(groups, profile, parts)
    links = first.unionByName(_verified(known, across))
    parts = connected_components(links).withColumnRenamed("id", "doc_id")
    out = profile.join(parts, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    lost = docs.where("doc_id is null").select("text").mapInArrow(_sizes, "n_shingles bigint")
    none = F.lit(None).cast("bigint")
    return out.unionByName(lost.select(none.alias("doc_id"), "n_shingles", none.alias("component_id")))
