"""Byte-level BPE: ranked merges folded over byte arrays of distinct words.

Every split of a vocabulary token into two tokens is an entry pair -> merged id. ``RankLiterals`` holds the entries as Spark
literals and folds with higher-order functions; ``RankTable`` holds them for numpy and folds many words at once, which is what
``encode_documents`` uses, as the higher-order functions take some 150 us a word (figures in the README).
"""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import text_batches
from .textnum import blocks

BUCKETS = 65_521
NONE = 2_000_000_000
#: Words beyond this many bytes are folded one by one, in time that grows little faster than their length.
LONG = 192


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankLiterals:
    """The rank map as Spark literals, and the fold that merges by it."""

    def __init__(self, ranks: dict[bytes, int]):
        keys: list[list[int]] = [[] for _ in range(BUCKETS)]
        ids: list[list[int]] = [[] for _ in range(BUCKETS)]
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    key = left * 65536 + right
                    keys[key % BUCKETS].append(key)
                    ids[key % BUCKETS].append(rank)
        self.keys = F.from_json(F.lit(json.dumps(keys, separators=(",", ":"))), "array<array<bigint>>")
        self.ids = F.from_json(F.lit(json.dumps(ids, separators=(",", ":"))), "array<array<int>>")
        self.byte_ids = F.from_json(F.lit(json.dumps([ranks[bytes([b])] for b in range(256)])), "array<int>")

    def pair_rank(self, left: Column, right: Column) -> Column:
        key = left.cast("bigint") * 65536 + right
        bucket = (key % BUCKETS).cast("int")
        return F.coalesce(F.get(F.get(self.ids, bucket), F.array_position(F.get(self.keys, bucket), key).cast("int") - 1), F.lit(NONE))

    def encode(self, word: Column) -> Column:
        """The ids of one word (binary): the pair of least rank merges first, leftmost among equals, until none is left."""
        empty = F.array().cast("array<int>")
        start = _let(
            F.hex(word),
            lambda digits: F.transform(
                F.sequence(F.lit(1), F.octet_length(word)),
                lambda i: F.get(self.byte_ids, F.conv(F.substr(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("int")),
            ),
        )
        state = _let(
            start,
            lambda s: F.struct(
                s.alias("ids"),
                F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x, i: self.pair_rank(x, F.get(s, i + 1))).alias("ranks"),
            ),
        )

        def merge(ids: Column, ranks: Column, least: Column, at: Column) -> Column:
            return F.struct(
                F.concat(F.slice(ids, F.lit(1), at - 1), F.array(least), F.slice(ids, at + 2, F.size(ids))).alias("ids"),
                F.concat(
                    F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))),
                    F.when(at > 1, F.array(self.pair_rank(F.get(ids, at - 2), least))).otherwise(empty),
                    F.when(at < F.size(ranks), F.array(self.pair_rank(least, F.get(ids, at + 1)))).otherwise(empty),
                    F.slice(ranks, at + 2, F.size(ranks)),
                ).alias("ranks"),
            )

        def step(state: Column, _: Column) -> Column:
            return _let(
                F.array_min(state["ranks"]),
                lambda least: F.when(
                    least < NONE,
                    _let(F.array_position(state["ranks"], least).cast("int"), lambda at: merge(state["ids"], state["ranks"], least, at)),
                ).otherwise(state),
            )

        folded = F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), state, step, lambda s: s["ids"])
        n = F.octet_length(word)
        return F.when(n == 0, empty).when(n == 1, start).otherwise(folded)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class RankTable:
    """The same rank map for numpy: a hash table pair -> merged id, and the fold over whole arrays of words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.bits = max(8, (8 * len(pairs)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.full(1 << self.bits, NONE, np.int32)
        left = np.fromiter(pairs, np.int64, len(pairs))
        rank = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(left)
        while len(left):
            free = np.flatnonzero(self.slots[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.slots[at[won]], self.merged[at[won]] = left[won], rank[won]
            rest = np.setdiff1d(np.arange(len(left)), won)
            left, rank, at = left[rest], rank[rest], (at[rest] + 1) & (len(self.slots) - 1)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.whole = ranks

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        found = self.slots[at]
        out = np.where(found == key, self.merged[at], np.int32(NONE))
        todo = np.nonzero((found != key) & (found != -1))
        while len(todo[0]):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            found = self.slots[at[todo]]
            hit, open_ = found == key[todo], found != -1
            out[tuple(x[hit] for x in todo)] = self.merged[at[tuple(x[hit] for x in todo)]]
            todo = tuple(x[open_ & ~hit] for x in todo)
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of distinct words; word k's ids are ids[ends[k-1]:ends[k]]."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        known = np.fromiter((self.whole.get(w, -1) for w in words), np.int64, len(words))
        counts = np.where(known >= 0, 1, 0)
        pieces: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(known >= 0), known[known >= 0].astype(np.int32)[:, None])]
        for k in np.flatnonzero((known < 0) & (sizes > LONG)).tolist():
            pieces.append((np.array([k]), self.fold_long(words[k])[None, :]))
        for n in np.unique(sizes[(known < 0) & (sizes > 0) & (sizes <= LONG)]):
            rows = np.flatnonzero((sizes == n) & (known < 0))
            step = max(1, 2_000_000 // int(n))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                raw = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), n)
                pieces += self._fold(part, self.byte_ids[raw])
        for rows, ids in pieces:
            counts[rows] = ids.shape[1]
        ends = np.cumsum(counts)
        out = np.empty(ends[-1] if len(ends) else 0, np.int32)
        for rows, ids in pieces:
            out[(ends[rows] - counts[rows])[:, None] + np.arange(ids.shape[1])] = ids
        return out, ends

    def _rank(self, left: int, right: int) -> int:
        """``pair_rank`` of one pair."""
        key = left << 32 | right
        at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (found := self.slots.item(at)) != key:
            if found == -1:
                return NONE
            at = (at + 1) & (len(self.slots) - 1)
        return self.merged.item(at)

    def fold_long(self, word: bytes) -> np.ndarray:
        """The ids of one word: pairs wait in a heap by rank and place, parts are a linked list, so a merge costs a logarithm of the length."""
        parts = self.byte_ids[np.frombuffer(word, np.uint8)]
        ranks = self.pair_rank(parts[:-1], parts[1:])
        at = np.flatnonzero(ranks < NONE)
        heap = list(zip(ranks[at].tolist(), at.tolist(), strict=True))
        heapq.heapify(heap)
        ids: list[int | None] = parts.tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            rank, k = heapq.heappop(heap)
            if ids[k] is None or (m := after[k]) >= n or self._rank(ids[k], ids[m]) != rank:
                continue  # one of the two has merged with another part since
            ids[k], ids[m], after[k] = rank, None, after[m]
            if after[k] < n:
                before[after[k]] = k
                if (next_rank := self._rank(rank, ids[after[k]])) < NONE:
                    heapq.heappush(heap, (next_rank, k))
            if before[k] >= 0 and (next_rank := self._rank(ids[before[k]], rank)) < NONE:
                heapq.heappush(heap, (next_rank, before[k]))
        return np.array([x for x in ids if x is not None], np.int32)

    def _fold(self, rows: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge the pair of least rank of each row, leftmost among equals, until no row has one; rows that end leave."""
        done, ranks = [], self.pair_rank(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(at)), at]
            over = least == NONE
            if over.any():
                done.append((rows[over], ids[over]))
                rows, ids, ranks, at, least = rows[~over], ids[~over], ranks[~over], at[~over], least[~over]
            if not len(rows):
                return done
            r, width = np.arange(len(rows)), ids.shape[1] - 1
            cols = np.arange(width)
            ids = ids[r[:, None], cols + (cols > at[:, None])]
            ids[r, at] = least
            ranks = ranks[r[:, None], cols[:-1] + (cols[:-1] >= at[:, None])]
            left, right = at > 0, at < width - 1
            ranks[r[left], at[left] - 1] = self.pair_rank(ids[r[left], at[left] - 1], least[left])
            ranks[r[right], at[right]] = self.pair_rank(least[right], ids[r[right], at[right] + 1])
        return [*done, (rows, ids)]


def encode_by_expressions(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, token_ids) by Spark expressions alone: distinct matches, the fold of ``RankLiterals``, and a join back to the texts.

    ``doc_id`` must be unique. It moves every match of every text through a shuffle; ``encode_documents`` moves none.
    """
    fold, unicode = RankLiterals(ranks), "(?U)" + pattern
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(unicode), F.lit(0))
    rows = docs.select("doc_id", F.posexplode_outer(found).alias("pos", "word"))
    words = rows.where("word is not null").select("word").distinct().withColumn("ids", fold.encode(F.col("word").cast("binary")))
    gathered = rows.join(words, "word", "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    empty = F.array().cast("array<int>")
    return gathered.select("doc_id", F.flatten(F.transform("parts", lambda p: F.coalesce(p["ids"], empty))).alias("token_ids"))


def compiled(pattern: str):
    """The pattern with white space as Unicode defines it."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the column ``ids`` (array<int>) in place of ``text``: each match of ``pattern`` encoded on its own.

    The distinct words of each block of documents are folded together, so nothing is shuffled and a long document costs no more
    than its words; a match of n bytes takes n log n steps at most. A null or empty text has no ids; repeated rows are encoded alike; other columns pass through unchanged, whatever
    their names, but for one named like ``ids``, which is replaced; an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    docs = docs.drop(ids) if ids != text else docs
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(ids, ArrayType(IntegerType()))

    def run(batches):
        table, split = RankTable(ranks.value), compiled(pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            rest = batch.select(kept)
            for a, b in blocks(texts):
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, _encode_block(texts.slice(a, b - a), table, split)], names=[*kept, ids])

    return docs.mapInArrow(run, schema)


def _encode_block(texts: pa.Array, table: RankTable, split) -> pa.Array:
    words: list[str] = []
    counts = [0]
    for x in texts.to_pylist():
        words += split.findall(x) if x else ()
        counts.append(len(words))
    coded = pa.array(words, pa.string()).dictionary_encode()
    flat, ends = table.encode([w.encode() for w in coded.dictionary.to_pylist()])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    which = coded.indices.to_numpy()
    sizes = (ends - starts)[which] if len(ends) else np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    places = np.repeat(starts[which] - upto[:-1], sizes) + np.arange(upto[-1]) if len(which) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(upto[counts].astype(np.int32)), pa.array(flat[places], pa.int32()))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes (binary) that ids stand for: the concatenation of their pieces, by a literal array of pieces."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    literal = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""))
