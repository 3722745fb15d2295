"""Language-model scores from Elias-Fano tries of word n-grams, built and queried in shards.

With ``order`` 3 a word w after the words b, c has probability
- (1 - k(b, c)) * n(b, c, w) / n(b, c) if the training texts hold b, c, w, else k(b, c) * p(w | c); with ``order`` 2 it has p(w | c):
- p(w | c) = (1 - k(c)) * n(c, w) / n(c) if they hold c, w, else k(c) * p(w);
- p(w) = (n(w) + 0.5) / (N + 0.5 * (V + 1));
with k = (1 + n) ** -DECAY of the context's count. These never sum to more than one.

Texts are cut into words once: a table holds each block of documents as numbers of the block's distinct words. Words and pairs are
a pass each, trigrams three. A block sends each distinct n-gram once with its training count, packed, to the shard of its context. The shard adds the counts
up, lays them out as a trie, looks every n-gram up that was sent and answers in the order sent; the block adds the answers up by document.
- level 1 of a trie holds the sorted contexts with their quantised log weights, level 2 the successors of each context as numbers relative
  to that context. Either level is one Elias-Fano sequence: the high bits, in unary, are the monotone pointers that tell which range belongs
  to which context; the low bits, as many as the number of entries asks for, lie packed beside them with 16-bit codes of the log
  probabilities;
- a lookup is a search for the least element not below the wanted one inside the context's range.
The levels are written to one file and memory-mapped while the shard's n-grams are looked up. ``score_documents`` can keep them as a
table, against which ``score_by_model`` scores other documents later.

Very frequent contexts are dealt over all shards by what follows them, very frequent words aren't sent at all. Their totals are
counted once and broadcast: more than N / (2 * shards) occurrences each, so there are at most six for each shard.
"""

from __future__ import annotations

import tempfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, staged, text_batches, width
from .textnum import SPACE, Buffer, blocks, mix

DECAY = 0.2
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000001)
BLOCK = 3_000_000
#: What a number relative to its context is taken modulo.
OTHER_BITS = 40
OTHER = np.uint64((1 << OTHER_BITS) - 1)


class EliasFano:
    """Sorted pairs (bucket, rest): buckets in unary, ``bits`` bits of the rest for each entry."""

    def __init__(self, words: np.ndarray, zeros: np.ndarray, lows: np.ndarray, n: int, bits: int):
        self.words, self.zeros, self.lows, self.n, self.bits = words, zeros, lows, n, bits
        self.eights = np.ndarray(max(0, len(lows) - 7), "<u8", lows, strides=(1,)) if len(lows) else np.zeros(0, np.uint64)

    @staticmethod
    def parts(bucket: np.ndarray, rest: np.ndarray, buckets: int, bits: int) -> list[np.ndarray]:
        """The arrays: unary words, how many zeros stand before each word, packed rests."""
        n = len(rest)
        high = np.zeros(-(-(n + buckets + 1) // 64) * 64, np.uint8)
        high[bucket + np.arange(n)] = 1
        words = np.packbits(high, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))])
        step, packed = 8 * 16_384, []
        for k in range(0, n, step):  # a multiple of eight entries fills whole bytes
            part = np.unpackbits(np.ascontiguousarray(rest[k : k + step]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
            packed.append(np.packbits(part.ravel(), bitorder="little"))
        return [words, zeros, np.concatenate([*packed, np.zeros(8, np.uint8)])]

    def rest(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.bits
        return (self.eights[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def _after_zero(self, k: np.ndarray) -> np.ndarray:
        """How many entries stand before the k-th zero (from 0) of the unary bits: where the k-th bucket ends."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        left, bits, place = k - self.zeros[word], ~self.words[word], np.zeros(len(k), np.int64)
        for size in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((bits >> place.astype(np.uint64)) & np.uint64((1 << size) - 1)).astype(np.int64)
            far = left >= count
            left, place = left - np.where(far, count, 0), place + np.where(far, size, 0)
        return word * 64 + place - k

    def find(self, bucket: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The place of each (bucket, rest), or -1: the least entry of the bucket not below the rest, if equal."""
        if not self.n or not len(bucket):
            return np.full(len(bucket), -1)
        a = np.where(bucket > 0, self._after_zero(np.maximum(bucket - 1, 0)), 0)
        end = self._after_zero(bucket)
        b = end.copy()
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) >> 1
            less = self.rest(mid) < rest[open_]
            a[open_], b[open_] = np.where(less, mid + 1, a[open_]), np.where(less, b[open_], mid)
        return np.where((a < end) & (self.rest(np.minimum(a, self.n - 1)) == rest), a, -1)


def low_bits(entries: int, universe_bits: int, buckets: int = 1, least: int = 0) -> int:
    """How many low bits make an Elias-Fano sequence of so many entries smallest; at most 56, so that one read of eight bytes holds them."""
    cost = lambda bits: entries * bits + (buckets << (universe_bits - bits))
    return min(range(max(least, universe_bits - 20), min(universe_bits, 56) + 1), key=cost)


class Trie:
    """Two levels over a memory-mapped file: contexts, and the partners of each context."""

    HEAD = 8

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.raw = np.memmap(f, np.uint8, "r")
        head, self.scale = self.raw[: 8 * self.HEAD].view(np.int64), self.raw[64:96].view(np.float64)
        self.n, self.m, self.key_bits, self.bits = (int(x) for x in head[:4])
        at, parts = 96, []
        for kind in (np.uint64, np.int64, np.uint8, np.uint64, np.int64, np.uint8, np.uint16, np.uint16):
            size = int(self.raw[at : at + 8].view(np.int64)[0])
            parts.append(self.raw[at + 8 : at + 8 + size].view(kind))
            at += 8 + size + -size % 8
        self.keys = EliasFano(*parts[:3], self.n, self.key_bits)
        self.others = EliasFano(*parts[3:6], self.m, self.bits)
        self.key_codes, self.codes = parts[6:]

    @classmethod
    def build(cls, keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, other: np.ndarray, values: np.ndarray) -> bytes:
        """The file of sorted keys with a weight each, and of (owner, other) in order with a value each; owner is a place among the keys."""
        key_bits, bits = low_bits(len(keys), 64, least=44), low_bits(len(other), OTHER_BITS, max(1, len(keys)))
        key_codes, key_low, key_step = quantised(weights)
        codes, low, step = quantised(values)
        split = lambda x, k: ((x >> np.uint64(k)).astype(np.int64), x & np.uint64((1 << k) - 1))
        key_bucket, key_rest = split(keys.astype(np.uint64), key_bits)
        bucket, rest = split(other.astype(np.uint64), bits)
        bucket = owner.astype(np.int64) << (OTHER_BITS - bits) | bucket
        parts = EliasFano.parts(key_bucket, key_rest, 1 << (64 - key_bits), key_bits) + EliasFano.parts(bucket, rest, len(keys) << (OTHER_BITS - bits), bits) + [key_codes, codes]
        out = [np.array([len(keys), len(other), key_bits, bits, 0, 0, 0, 0], np.int64).tobytes(), np.array([key_low, key_step, low, step]).tobytes()]
        for x in parts:
            out += [np.int64(x.nbytes).tobytes(), x.tobytes(), b"\0" * (-x.nbytes % 8)]
        return b"".join(out)

    def find_key(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in level 1, or -1."""
        return self.keys.find((keys >> np.uint64(self.key_bits)).astype(np.int64), keys & np.uint64((1 << self.key_bits) - 1))

    def successor(self, owner: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Place in level 2 of each (place of its key, partner), or -1."""
        out, some = np.full(len(owner), -1), np.flatnonzero(owner >= 0)
        bucket = owner[some] << (OTHER_BITS - self.bits) | (other[some] >> np.uint64(self.bits)).astype(np.int64)
        out[some] = self.others.find(bucket, other[some] & np.uint64((1 << self.bits) - 1))
        return out

    def value(self, at: np.ndarray) -> np.ndarray:
        return self.scale[2] + self.scale[3] * self.codes[at]

    def key_value(self, at: np.ndarray) -> np.ndarray:
        return self.scale[0] + self.scale[1] * self.key_codes[at]


def quantised(values: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(16-bit codes, least value, step)."""
    if not len(values):
        return np.zeros(0, np.uint16), 0.0, 0.0
    low = float(values.min())
    step = (float(values.max()) - low) / 65535
    return np.round((values - low) / (step or 1.0)).astype(np.uint16), low, step


def backoff(count: np.ndarray) -> np.ndarray:
    return (1.0 + count) ** -DECAY


def is_training(doc_id: int | None, held: int = 1) -> bool:
    """Whether crc32 of the id's decimal text modulo 5 is not ``held``; rows without an id train too."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != held


def _short(x: np.ndarray) -> np.ndarray:
    """What travels of a partner."""
    return mix(x) & OTHER


def _pair(before: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The key of a pair of context words, of which the first is shortened."""
    return mix(context ^ mix(before + np.uint64(3)))


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of 64-bit numbers, all first bytes first: high ones, mostly equal, are compressed away."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(x: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(x) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(x, np.uint8).reshape(width, -1).T
    return wide.view(np.int64).ravel()


def _squeezed(data: bytes) -> bytes:
    """The size, and the bytes coded by their frequencies."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _heaps(batches):
    """Tables of some ``BLOCK`` bytes of text from smaller batches; a larger batch is cut, a longer text stands alone."""
    hold, size = [], 0
    for batch in batches:
        if hold and size + batch.column(1).nbytes > BLOCK:
            yield pa.Table.from_batches(hold)
            hold, size = [], 0
        hold.append(batch)
        size += batch.column(1).nbytes
    if hold:
        yield pa.Table.from_batches(hold)


NUMBERED = "block bigint, n_tokens bigint, train binary, counts binary, names binary, words binary"


def _number(batches):
    """A row for each block of documents: ids, whether they train, how many tokens each has (its words, then its end), and all tokens
    as numbers of the block's distinct words, the most frequent first."""
    block = TaskContext.get().partitionId() << 32
    for heap in _heaps(batches):
        ids, texts = (heap.column(k).combine_chunks() for k in (0, 1))
        for a, b in blocks(texts, BLOCK):
            buffer = Buffer(texts.slice(a, b - a))
            starts, ends, row = buffer.words(SPACE)
            counts = np.bincount(row, minlength=b - a) + 1
            last = np.cumsum(counts) - 1
            token = np.full(int(counts.sum()), END)
            is_word = np.ones(len(token), bool)
            is_word[last] = False
            token[is_word] = buffer.hashes(starts, ends)
            names, words, often = np.unique(token, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            packed = _squeezed(_planes(rank[words], 3 if len(names) < 1 << 24 else 4))
            some = ids.slice(a, b - a)
            train = np.array([is_training(i) for i in some.to_pylist()], bool)
            part = (block, len(token), train.tobytes(), counts.astype(np.uint32).tobytes(), names[order].tobytes(), packed)
            types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            listed = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), some)
            yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(part, types, strict=True)), listed], names=[*_names(NUMBERED), "ids"])
            block += 1


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass
class Level:
    """The n-grams of one length in a block: the number of every token's, and of each distinct one its context's key, its last word's
    hash, how often training texts hold it, and its own key as a context."""

    number: np.ndarray
    key: np.ndarray
    last: np.ndarray
    count: np.ndarray
    own: np.ndarray


class Grams:
    """A block of documents, each text after as many starts as a context has words; ``levels[k]`` are its n-grams of k words.

    The starts have n-grams too, which no text holds: they count nothing.
    """

    def __init__(self, row: dict, order: int, top: int):
        names = np.append(np.frombuffer(row["names"], np.uint64), START)
        counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64) + order - 1
        self.train = np.frombuffer(row["train"], bool)
        first = np.cumsum(counts) - counts
        self.real = np.ones(int(counts.sum()), bool)
        for k in range(order - 1):
            self.real[first + k] = False
        word = np.full(len(self.real), len(names) - 1)
        words = _unsqueezed(row["words"])
        word[self.real] = _from_planes(words, len(words) // row["n_tokens"])
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.weight = self.real & self.train[self.doc]
        number, own = word, names
        self.levels = {1: Level(word, names, names, np.bincount(word, self.weight, len(names)).astype(np.int64), names)}
        for k in range(2, top + 1):
            distinct, number_ = np.unique(np.concatenate([number[:1], number[:-1]]) << 32 | word, return_inverse=True)
            key, last = own[distinct >> 32], names[distinct & 0xFFFFFFFF]
            number, own = number_, _pair(_short(key), last)
            self.levels[k] = Level(number, key, last, np.bincount(number, self.weight, len(key)).astype(np.int64), own)

    def contexts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, training counts) of the contexts of k words."""
        level = self.levels[k]
        return level.own, np.bincount(level.number[:-1], self.weight[1:], len(level.own)).astype(np.int64)

    def dealt(self, k: int, known: Survey) -> tuple[np.ndarray, np.ndarray]:
        """(places of the distinct n-grams of k words, from shard to shard; where each shard begins): frequent words are left out."""
        level, shards = self.levels[k], np.uint64(known.shards)
        shard = (level.key >> np.uint64(24)) % shards
        often = places(known.frequent(k).keys, level.key) >= 0
        if k > 1:
            shard[often] = (mix(level.last[often] ^ level.key[often]) >> np.uint64(24)) % shards
        at = np.flatnonzero(~often) if k == 1 else np.arange(len(shard))
        shard = shard[at].astype(np.uint16 if known.shards < 65_536 else np.int64)
        return at[np.argsort(shard, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=known.shards))])


def _each(batches, order: int, top: int):
    """The blocks of some rows of the numbered table."""
    for batch in batches:
        for row in batch.select(_names(NUMBERED)).to_pylist():
            yield row["block"], Grams(row, order, top)


COUNTED = "kind int, key bigint, n bigint"


def _counted(kinds: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    kind = np.concatenate([np.full(len(keys), k, np.int32) for k, (keys, _) in kinds.items()])
    keys, n = (np.concatenate([x[i] for x in kinds.values()]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])


def _kinds(grams: Grams, order: int):
    """(kind, keys, training counts) of what may be frequent: words (1) and pairs of context words (2)."""
    yield 1, grams.levels[1].own, grams.levels[1].count
    if order > 2:
        yield 2, *grams.contexts(2)


def _survey(shards: int, order: int):
    """The frequent words (kind 1) and pairs (kind 2) of each block of training texts, and its number of tokens (kind 0).

    A key of N / (2 * shards) tokens or more has at least half of them in blocks where its share is over half that, so none is missed.
    """

    def run(batches):
        for _, grams in _each(batches, order, order - 1):
            n = int(grams.weight.sum())
            found = {0: (np.zeros(1, np.uint64), np.array([n]))}
            for kind, keys, counts in _kinds(grams, order):
                often = (counts * 4 * shards >= n) & (counts > 0)
                found[kind] = keys[often], counts[often]
            yield _counted(found)

    return run


def _totals(hot: dict[int, np.ndarray], order: int):
    """The exact numbers of the frequent words and pairs in each block of training texts."""

    def run(batches):
        for _, grams in _each(batches, order, order - 1):
            found = {}
            for kind, keys, counts in _kinds(grams, order):
                some = (places(hot[kind], keys) >= 0) & (counts > 0)
                found[kind] = keys[some], counts[some]
            yield _counted(found)

    return run


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted number stands among sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Frequent:
    """Sorted keys that are dealt over all shards, with their totals."""

    keys: np.ndarray
    totals: np.ndarray

    def overlay(self, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
        """``count`` with the totals of frequent keys in place of what one shard has of them."""
        at = places(self.keys, keys)
        return np.where(at >= 0, self.totals[np.maximum(at, 0)], count) if len(self.keys) else count


@dataclass
class Survey:
    """What is known of the training texts before the passes."""

    order: int
    shards: int
    tokens: int
    words: Frequent
    contexts: Frequent
    pairs: Frequent

    def frequent(self, level: int) -> Frequent:
        """The frequent keys of n-grams of so many words."""
        return (self.words, self.contexts, self.pairs)[level - 1]


SENT = "shard int, block bigint, keys binary, each binary, others binary, counts binary"


def _five(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5])


def _from_five(x: bytes) -> np.ndarray:
    wide = np.zeros((len(x) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8 if not len(x) or x.max() < 256 else np.uint32)


def _slices(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of consecutive parts of an array as one binary column."""
    size = x.nbytes // max(1, len(x))
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _parts(k: int, shards: int) -> list[tuple[int, int]]:
    """The ranges of shards that n-grams of k words are sent to, one after another: trigrams to a third of them at a time, so that less lies on disk at once."""
    cuts = [0, shards // 3, 2 * shards // 3, shards] if k > 2 else [0, shards]
    return list(zip(cuts, cuts[1:], strict=False))


def _send(k: int, known: Survey, shards: tuple[int, int]):
    """The distinct n-grams of k words of each block of documents for a range of shards, packed by shard: contexts, how many partners each
    has, partners, counts."""

    def run(batches):
        for block, grams in _each(batches, known.order, k):
            level, (at, cuts) = grams.levels[k], grams.dealt(k, known)
            cuts = cuts[shards[0] : shards[1] + 1]
            at, cuts = at[cuts[0] : cuts[-1]], cuts - cuts[0]
            filled = np.flatnonzero(np.diff(cuts))
            cuts = np.append(cuts[filled], len(at))
            key = level.key[at]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[cuts[:-1]] = True
            first, key_cuts = np.flatnonzero(new), np.concatenate([[0], np.cumsum(new)])[cuts]
            others = _five(_short(level.last[at])) if k > 1 else np.zeros((len(at), 0), np.uint8)
            columns = [
                pa.array((filled + shards[0]).astype(np.int32)),
                pa.array(np.full(len(filled), block)),
                _slices(key[first], key_cuts),
                _slices(_narrow(np.diff(np.append(first, len(key)))), key_cuts),
                _slices(others, cuts),
                _slices(_narrow(level.count[at]), cuts),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=_names(SENT))

    return run


class Entries:
    """What one shard got: key, partner and training count of every n-gram; which part came from which block."""

    def __init__(self, table: pa.Table):
        key, other, count, sizes = [], [], [], []
        for keys, each, others, counts in zip(*(table.column(c).to_pylist() for c in _names(SENT)[2:]), strict=True):
            keys = np.frombuffer(keys, np.uint64)
            key.append(np.repeat(keys, np.frombuffer(each, np.uint8 if len(each) == len(keys) else np.uint32)))
            sizes.append(len(key[-1]))
            other.append(_from_five(others) if others else np.zeros(sizes[-1], np.uint64))
            count.append(np.frombuffer(counts, np.uint8 if len(counts) == sizes[-1] else np.uint32).astype(np.int64))
        self.key, self.other, self.count = np.concatenate(key), np.concatenate(other), np.concatenate(count)
        self.blocks, self.cuts = table.column("block").to_pylist(), np.concatenate([[0], np.cumsum(sizes)])


class Pairs:
    """The distinct (key, partner) pairs of some n-grams in order, and how often training texts hold them and their keys."""

    def __init__(self, key: np.ndarray, other: np.ndarray, count: np.ndarray):
        order = np.lexsort((other, key))
        key, other, count = key[order], other[order], count[order]
        first = np.ones(min(1, len(key)), bool)
        new_key = np.concatenate([first, key[1:] != key[:-1]])
        new = new_key | np.concatenate([first, other[1:] != other[:-1]])
        starts, pair_starts = np.flatnonzero(new_key), np.flatnonzero(new)
        self.keys, self.owner, self.other = key[starts], (np.cumsum(new_key) - 1)[pair_starts], other[pair_starts]
        total = np.concatenate([[0], np.cumsum(count)])
        self.count = np.diff(total[np.append(starts, len(key))])
        self.n = np.diff(total[np.append(pair_starts, len(key))])
        self.pair = np.empty(len(key), np.int64)
        self.pair[order] = np.cumsum(new) - 1

    def trie(self, totals: Frequent | None = None) -> bytes:
        """The trie of what training texts hold: log weights of contexts, log probabilities of their successors."""
        count = totals.overlay(self.keys, self.count) if totals is not None else self.count
        seen, known = self.n > 0, count > 0
        rank, of = np.cumsum(known) - 1, count[self.owner[seen]]
        values = np.log10((1 - backoff(of)) * self.n[seen] / of)
        return Trie.build(self.keys[known], np.log10(backoff(count[known])), rank[self.owner[seen]], self.other[seen], values)

    def logs(self, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
        """For each n-gram log10 of its probability after its context, or of the context's weight; and whether the trie holds it.

        Unknown contexts weigh one. Each distinct pair is looked up once.
        """
        place = trie.find_key(self.keys)
        owner = place[self.owner]
        at = trie.successor(owner, self.other)
        hit, out = at >= 0, np.zeros(len(at))
        out[hit] = trie.value(at[hit])
        weighed = ~hit & (owner >= 0)
        out[weighed] = trie.key_value(owner[weighed])
        return out[self.pair], hit[self.pair]


#: Log probabilities travel as 23-bit multiples of 2 ** -19 and a bit that tells whether the trie holds the n-gram.
STEP = 1 << 19
ANSWERED = "block bigint, level int, shard int, answers binary, vocabulary bigint, model map<string,binary>"
ANSWERED_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.map_(pa.string(), pa.binary())]


def _learn(k: int, known: Survey, o: Entries) -> tuple[dict[str, bytes], Pairs | None]:
    """The tables of one shard, as they are kept."""
    if k > 1:
        pairs = Pairs(o.key, o.other, o.count)
        o.key = o.other = o.count = None  # a shard's arrays are large
        return {"trie": pairs.trie(known.frequent(k))}, pairs
    words, at = np.unique(o.key, return_inverse=True)
    count = np.bincount(at, o.count, len(words)).astype(np.int64)
    return {"words": words[count > 0].tobytes(), "counts": count[count > 0].tobytes()}, None


def _answer(k: int, o: Entries, pairs: Pairs | None, learnt: dict[str, bytes], shard: int, vocabulary: int, keep: bool) -> pa.Table:
    """A row for each block of documents: what its n-grams look up to, in the order sent."""
    if k > 1:
        logs, hit = pairs.logs(Trie(learnt["trie"]))
        answers, size = np.minimum(np.round(-logs * STEP), (1 << 23) - 1).astype(np.int64) << 1 | hit, 3
    else:
        words, count = np.frombuffer(learnt["words"], np.uint64), np.append(np.frombuffer(learnt["counts"], np.int64), 0)
        answers, size = count[places(words, o.key)], 8
    rows = len(o.blocks)
    columns = [
        o.blocks,
        [k] * rows,
        [shard] * rows,
        [_squeezed(_planes(answers[a:b], size)) for a, b in zip(o.cuts.tolist(), o.cuts[1:].tolist(), strict=False)],
        [vocabulary] + [0] * (rows - 1),
        [list(learnt.items()) if keep else None] + [None] * (rows - 1),
    ]
    return pa.table([pa.array(x, t) for x, t in zip(columns, ANSWERED_TYPES, strict=True)], names=_names(ANSWERED))


def _score(k: int, known: Survey, keep: bool):
    """One shard: add the counts up, build its tables, look every n-gram up in them."""

    def run(table: pa.Table) -> pa.Table:
        o = Entries(table)
        learnt, pairs = _learn(k, known, o)
        return _answer(k, o, pairs, learnt, table.column(0)[0].as_py(), len(learnt["words"]) // 8 if k == 1 else 0, keep)

    return run


def _asked(k: int):
    """The n-grams that one shard got against the tables that are kept of it."""

    def run(asked: pa.Table, kept: pa.Table) -> pa.Table:
        if not len(asked):
            return pa.table([pa.array([], t) for t in ANSWERED_TYPES], names=_names(ANSWERED))
        o, none = Entries(asked), np.zeros(0, np.uint64)
        pairs = Pairs(o.key, o.other, o.count) if k > 1 else None
        if len(kept):
            learnt = dict(kept.column("model")[0].as_py())
        else:  # no training text reached this shard
            learnt = {"trie": Pairs(none, none, none.astype(np.int64)).trie()} if k > 1 else {"words": b"", "counts": b""}
        return _answer(k, o, pairs, learnt, asked.column(0)[0].as_py(), 0, False)

    return run


def _gather(known: Survey, vocabulary: int):
    """One block of documents and the answers to its n-grams: a row for each document."""
    scale = float(np.log10(known.tokens + 0.5 * (vocabulary + 1)))

    def run(numbered: pa.Table, answered: pa.Table) -> pa.Table:
        grams = Grams(numbered.select(_names(NUMBERED)).to_pylist()[0], known.order, known.order)
        got: dict[int, list] = {}
        for k, shard, x in zip(*(answered.column(c).to_pylist() for c in ("level", "shard", "answers")), strict=True):
            got.setdefault(k, []).append((shard, x))
        base = score = np.zeros(0)
        for k, level in grams.levels.items():
            parts = [_from_planes(_unsqueezed(x), 3 if k > 1 else 8) for _, x in sorted(got.get(k, []))]
            answers = np.zeros(len(level.key), np.int64)
            answers[grams.dealt(k, known)[0]] = np.concatenate([np.zeros(0, np.int64), *parts])
            if k == 1:
                count = known.words.overlay(level.key, answers)
                base = score = (np.log10(count + 0.5) - scale)[level.number]
                known_word = (count > 0)[level.number]
            else:
                logs, hit = ((answers >> 1) / -STEP)[level.number], (answers & 1 == 1)[level.number]
                score = logs + np.where(hit, 0.0, score)
        real, docs = grams.real, len(grams.train)
        sums = lambda x: np.bincount(grams.doc[real], x[real], docs)
        columns = [
            numbered.column("ids").combine_chunks().flatten(),
            pa.array(~grams.train),
            pa.array(sums(real).astype(np.int64)),
            pa.array(sums(known_word).astype(np.int64)),
            pa.array(np.full(docs, known.tokens, np.int64)),
            pa.array(sums(base)),
            pa.array(sums(score)),
        ]
        return pa.table(columns, names=["doc_id", *_names(SCORES)])

    return run


SCORES = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _lines(docs: DataFrame) -> DataFrame:
    """The numbered blocks of all documents, as a staged table."""
    text_batches(docs.sparkSession)
    ids = T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return staged(rows.mapInArrow(_number, T.StructType([*T.StructType.fromDDL(NUMBERED).fields, ids])), "lm-numbered")


def survey(rows: DataFrame, shard_tokens: int, order: int = 3) -> Survey:
    """Counts what the passes must know: tokens, and the frequent words and pairs with their totals."""
    spark = rows.sparkSession
    size = rows.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(12, width(spark), -(-size // shard_tokens))
    numbered = rows.select(_names(NUMBERED))
    counted = staged(numbered.mapInArrow(_survey(shards, order), COUNTED).groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-survey")
    tokens = counted.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    frequent = counted.where((F.col("kind") > 0) & (F.col("n") * 4 * shards >= tokens)).select("kind", "key").collect()
    hot = {kind: np.sort(np.array([r["key"] for r in frequent if r["kind"] == kind], np.int64).view(np.uint64)) for kind in (1, 2)}
    totals = {kind: np.zeros(len(keys), np.int64) for kind, keys in hot.items()}
    if frequent:
        for r in numbered.mapInArrow(_totals(hot, order), COUNTED).groupBy("kind", "key").agg(F.sum("n").alias("n")).collect():
            totals[r["kind"]][places(hot[r["kind"]], np.array([r["key"]], np.int64).view(np.uint64))[0]] = r["n"]
    words = Frequent(hot[1], totals[1])
    # every word but a text's last, its end, is the context of one token; the start is the context of as many as there are ends
    begin = np.where(hot[1] == END, START, hot[1])
    sort = np.argsort(begin)
    return Survey(order, shards, int(tokens), words, Frequent(begin[sort], totals[1][sort]), Frequent(hot[2], totals[2]))


def _pass(rows: DataFrame, k: int, known: Survey, shards: tuple[int, int], model: str | None) -> tuple[DataFrame, int]:
    """(answers of a range of shards to the n-grams of k words, words that the shards know)."""
    sent = rows.select(_names(NUMBERED)).mapInArrow(_send(k, known, shards), SENT)
    answered = staged(sent.groupBy("shard").applyInArrow(_score(k, known, model is not None), ANSWERED), "lm-answers")
    if model is not None:
        answered.where("model is not null").select("shard", "model").write.mode("append").parquet(f"{model}/level{k}")
    vocabulary = answered.agg(F.sum("vocabulary")).first()[0] or 0
    release(rows.sparkSession)
    return answered, int(vocabulary)


def _scores(rows: DataFrame, answered: list[DataFrame], known: Survey, vocabulary: int) -> DataFrame:
    """Blocks meet their answers, half of the blocks at a time, so that less lies on disk at once."""
    answers = None
    for table in answered:
        part = table.select("block", "level", "shard", "answers")
        answers = part if answers is None else answers.unionByName(part)
    schema = T.StructType([T.StructField("doc_id", rows.schema["ids"].dataType.elementType), *T.StructType.fromDDL(SCORES).fields])
    halves = []
    for k in (0, 1):
        some, answer = (x.where(F.pmod(F.xxhash64("block"), F.lit(2)) == k).groupBy("block") for x in (rows, answers))
        halves.append(staged(some.cogroup(answer).applyInArrow(_gather(known, vocabulary), schema), "lm-scores"))
        release(rows.sparkSession)
    return halves[0].unionByName(halves[1])


def score_documents(docs: DataFrame, shard_tokens: int = 1_200_000, model: str | None = None, order: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, text).

    Rows whose crc32(doc_id as text) modulo 5 is 1 are held out and bring no counts; a null doc_id trains. A null or
    empty text is one token, its end. Repeated rows count each and get equal scores; other columns are ignored; an empty table gives no rows.
    Words are known by 64-bit hashes, a context's successors by 40 bits. With ``model``, a new folder, what was learnt is kept there for
    ``score_by_model``.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    rows = _lines(docs)
    known = survey(rows, shard_tokens, order)
    answered, vocabulary = [], int((known.words.totals > 0).sum())
    for k in range(1, order + 1):
        for shards in _parts(k, known.shards):
            table, words = _pass(rows, k, known, shards, model)
            answered.append(table)
            vocabulary += words
    if model is not None:
        numbers = [(kind, int(key), int(n)) for kind, x in (("words", known.words), ("contexts", known.contexts), ("pairs", known.pairs)) for key, n in zip(x.keys.view(np.int64), x.totals, strict=True)]
        numbers += [("order", 0, order), ("shards", 0, known.shards), ("tokens", 0, known.tokens), ("vocabulary", 0, vocabulary)]
        docs.sparkSession.createDataFrame(numbers, "kind string, key bigint, n bigint").write.parquet(f"{model}/survey")
    return _scores(rows, answered, known, vocabulary)


def score_by_model(spark: SparkSession, docs: DataFrame, model: str) -> DataFrame:
    """Scores of ``docs`` by a model that ``score_documents`` kept: the same columns; nothing is learnt from these documents."""
    rows = _lines(docs)
    numbers: dict[str, list] = {}
    for r in spark.read.parquet(f"{model}/survey").orderBy("kind", "key").collect():
        numbers.setdefault(r["kind"], []).append((r["key"], r["n"]))

    def frequent(kind: str) -> Frequent:
        keys, n = (np.array([x[k] for x in numbers.get(kind, [])], np.int64) for k in (0, 1))
        order = np.argsort(keys.view(np.uint64))
        return Frequent(keys.view(np.uint64)[order], n[order])

    known = Survey(numbers["order"][0][1], numbers["shards"][0][1], numbers["tokens"][0][1], frequent("words"), frequent("contexts"), frequent("pairs"))
    answered = []
    for k in range(1, known.order + 1):
        held = spark.read.schema("shard int, model map<string,binary>").parquet(f"{model}/level{k}")
        for shards in _parts(k, known.shards):
            sent = rows.select(_names(NUMBERED)).mapInArrow(_send(k, known, shards), SENT).groupBy("shard")
            some = held.where((F.col("shard") >= shards[0]) & (F.col("shard") < shards[1])).groupBy("shard")
            answered.append(staged(sent.cogroup(some).applyInArrow(_asked(k), ANSWERED), "lm-asked"))
    return _scores(rows, answered, known, numbers["vocabulary"][0][1])
