"""Words of many texts as numpy arrays: bounds, documents and 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROOT = np.uint64(0x9E3779B97F4A7C15)
UNROOT = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: What separates words: space and \x09-\x0D; or every ASCII byte that is no letter or digit.
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Spans up to this many bytes are hashed together, eight bytes a round; longer ones one by one.
SHORT = 256
_masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ROOT**k and ROOT**-k modulo 2**64 for k up to n at least."""
    if max(_tables, default=-1) < n:
        size = -(-(n + 1) // (1 << 20)) << 20 if n >= 1 << 16 else 1 << 16
        made = []
        for base in (ROOT, UNROOT):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _tables.clear()
        _tables[size - 1] = (made[0], made[1])
    return next(iter(_tables.values()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: pa.Array, most: int = 1_500_000):
    """(from, to) ranges of rows with some ``most`` bytes each; a longer text is a block of its own. Numbers count as sizes."""
    sizes = texts if pa.types.is_integer(texts.type) else pc.binary_length(texts)
    sizes = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


class Buffer:
    """Texts laid out one after another, a space after each; starts[k]:ends[k] is the k-th text."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        parts = [(x or "").encode() if not isinstance(x, bytes) else x for x in texts.to_pylist()]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        raw = b" ".join(parts) + b" "
        self.raw = raw.translate(LOWER) if lower else raw
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
        self.ends = self.starts + sizes
        self._eights: np.ndarray | None = None

    @property
    def eights(self) -> np.ndarray:
        """The eight bytes from each place on as one number."""
        if self._eights is None:
            self._eights = np.ndarray(len(self.raw) + 1, "<u8", self.raw + bytes(8), strides=(1,))
        return self._eights

    def words(self, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of all words."""
        gap = np.concatenate([[True], gaps[self.bytes]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, np.searchsorted(self.starts, starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span's bytes, the same wherever the span lies.

        Every eight bytes are mixed into a state that begins with the length, so spans of equal length up to eight bytes never
        collide, and no other texts by their structure; spans beyond ``SHORT`` bytes take the head of their BLAKE2 digest.
        """
        sizes = ends - starts
        out = mix(sizes.astype(np.uint64) * ROOT + UNROOT)
        now, at = np.flatnonzero((sizes > 0) & (sizes <= SHORT)), 0
        while len(now):
            left = sizes[now] - at
            out[now] = mix(out[now] ^ (self.eights[starts[now] + at] & _masks[np.minimum(left, 8)]))
            now, at = now[left > 8], at + 8
        for k in np.flatnonzero(sizes > SHORT).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(self.raw[starts[k] : ends[k]], digest_size=8).digest(), "little")
        return out

    def same(self, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
        """Whether the bytes of each span equal those of the other one."""
        sizes = ends - starts
        out = sizes == other_ends - others
        now, at = np.flatnonzero(out & (sizes > 0) & (sizes <= SHORT) & (starts != others)), 0
        while len(now):
            left = sizes[now] - at
            equal = (self.eights[starts[now] + at] ^ self.eights[others[now] + at]) & _masks[np.minimum(left, 8)] == 0
            out[now[~equal]] = False
            now, at = now[equal & (left > 8)], at + 8
        for k in np.flatnonzero(out & (sizes > SHORT) & (starts != others)).tolist():
            out[k] = self.raw[starts[k] : ends[k]] == self.raw[others[k] : other_ends[k]]
        return out

    def exact_ids(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A number below their count for each span; equal numbers mean equal bytes: hashes propose, the bytes decide."""
        _, first, ids = np.unique(self.hashes(starts, ends), return_index=True, return_inverse=True)
        one = first[ids]
        if not self.same(starts, ends, starts[one], ends[one]).all():
            known: dict[bytes, int] = {}
            ids = np.array([known.setdefault(self.raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        return ids
