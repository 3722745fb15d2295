"""Removal of repeated passages by prefix-free parsing.

A rolling hash over 32 bytes picks triggers: every window of ``span`` bytes (200) is anchored at the position of its least hash, the
leftmost among equals, so equal windows have equal anchors at equal places. Neighbouring windows of one anchor form a phrase: the bytes
that they cover. The dictionary holds each distinct phrase once; the parse tells where in the corpus each phrase occurs.

Phrases overlap by ``span`` - 1 bytes, so a suffix of the corpus is ordered to the depth of ``span`` bytes by the suffix of the phrase that
it begins in: the suffix array of the dictionary, with the parse's occurrences of each phrase laid beside its suffixes, is the
corpus order to that depth, and what is repeated has a neighbour there with ``span`` bytes in common.

1. Documents send their triggers to shards; a trigger that occurs once in the corpus starts no repeat, and its phrase goes no further.
2. Phrases of the other triggers meet in shards by trigger, where a dictionary over their bytes makes them distinct. The suffixes of
   phrases that share a trigger are ranked by prefix doubling: equal ranks are equal bytes. A suffix occurs again if another
   suffix has its rank or if the parse has its phrase twice.
3. Repeated windows are laid back through the parse onto the documents, whose remaining bytes are kept.

What occurs twice in one block of documents is known to be repeated there: the block sends it once, without its occurrences, so a passage
that a third of all documents hold is an entry for each block. Phrases of a trigger that occurs more than ``HOT`` times are cut in
two, windows that hold the 84 bytes before the trigger and windows that hold the 84 bytes behind its end, and meet by these bytes too.

Hashes only choose triggers and shards; what is equal is decided on bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, release, staged, text_batches, width
from .textnum import blocks, mix, powers

GRAM = 32
PLACE = np.uint64((1 << 24) - 1)
#: Bytes of text that are parsed at once, and that share a dictionary before the shuffle.
PIECE, BLOCK = 600_000, 2_000_000
#: Bytes of text whose triggers meet in one shard.
SHARD_BYTES = 32_000_000
#: Occurrences beyond which the phrases of a trigger are dealt by their bytes beside it.
HOT = 4_000
#: Kinds of rows: what a block holds once, what it holds more than once, and where it holds that.
ONCE, MANY, PLACES = 0, 1, 2


def _sums(raw: np.ndarray) -> np.ndarray:
    up, _ = powers(len(raw) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), then the same from starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Phrases:
    """The phrases of some texts: row, place in the text, number of windows, trigger, and the trigger's place in the text."""

    def __init__(self, texts: list[bytes], span: int):
        self.span, self.texts = span, texts
        out: list[list[np.ndarray]] = []
        batch: list[tuple[int, int, bytes]] = []
        held = 0
        for row, text in enumerate(texts):
            for at in range(0, len(text) - span + 1, PIECE):
                batch.append((row, at, text[at : at + PIECE + span - 1]))
                held += len(batch[-1][2])
                if held >= PIECE:
                    out.append(self._parse(batch))
                    batch, held = [], 0
        if batch:
            out.append(self._parse(batch))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64)]
        self.row, self.start, self.windows, self.trigger, self.anchor = columns
        counts = np.bincount(self.row, minlength=len(texts))
        self.ordinal = np.arange(len(self.row)) - np.repeat(np.cumsum(counts) - counts, counts)

    def _parse(self, batch: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(x[2] for x in batch), np.uint8)
        sizes = np.array([len(x[2]) for x in batch])
        begins = np.cumsum(sizes) - sizes
        sums, (_, down) = _sums(raw), powers(len(raw) + 1)
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) - GRAM + 1])
        reach = self.span - GRAM + 1
        ranked = np.full(-(-len(grams) // reach) * reach, np.uint64(2**64 - 1))
        ranked[: len(grams)] = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        ranked = ranked.reshape(-1, reach)
        n = len(raw) - self.span + 1
        least = np.minimum(
            np.minimum.accumulate(ranked[:, ::-1], axis=1)[:, ::-1].ravel()[:n], np.minimum.accumulate(ranked, axis=1).ravel()[reach - 1 : reach - 1 + n]
        )
        windows = sizes - self.span + 1
        at = _ranges(begins, windows)
        anchor = (least[at] & PLACE).astype(np.int64)
        piece = np.repeat(np.arange(len(batch)), windows)
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [len(at)]]))
        begin, piece = at[first], piece[first]
        rows, places = np.array([x[0] for x in batch]), np.array([x[1] for x in batch])
        return [rows[piece], places[piece] + begin - begins[piece], count, grams[anchor[first]], places[piece] + anchor[first] - begins[piece]]


def _small(x: np.ndarray, n: int) -> bytes:
    return x.astype(np.uint16 if n < 65536 else np.uint32).tobytes()


def _from_small(x: bytes, size: int) -> np.ndarray:
    return np.frombuffer(x, np.uint16 if len(x) == 2 * size else np.uint32).astype(np.int64)


def _emit(rows: list[tuple], names: list[str], kinds: list[pa.DataType], at_once: int = 64):
    for k in range(0, len(rows), at_once):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + at_once], strict=True), kinds, strict=True)], names=names)


TRIGGERS = "shard int, kind int, ids binary, local binary, ordinal binary, trigger binary"


def _send_triggers(shards: int, span: int):
    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK):
                ids = batch.column(0).slice(a, b - a).to_numpy()
                p = Phrases([x or b"" for x in batch.column(1).slice(a, b - a).to_pylist()], span)
                known, at, count = np.unique(p.trigger, return_inverse=True, return_counts=True)
                out = []

                def places(kind, shard, some):
                    used, local = np.unique(p.row[some], return_inverse=True)
                    trigger = p.trigger[some].tobytes() if kind == ONCE else None
                    out.append((shard, kind, ids[used].tobytes(), _small(local, len(used)), p.ordinal[some].astype(np.uint32).tobytes(), trigger))

                once = np.flatnonzero(count[at] == 1)
                for s, some in _dealt(p.trigger[once], shards):
                    places(ONCE, s, once[some])
                many = np.flatnonzero(count > 1)
                for s, some in _dealt(known[many], shards):
                    out.append((s, MANY, None, None, count[many[some]].astype(np.uint32).tobytes(), known[many[some]].tobytes()))
                if len(again := np.flatnonzero(count[at] > 1)):
                    places(PLACES, int(ids[0] % shards), again)
                yield from _emit(out, [c.split()[0] for c in TRIGGERS.split(", ")], [pa.int32(), pa.int32(), *[pa.binary()] * 4])

    return run


def _dealt(keys: np.ndarray, shards: int):
    """(shard, places of its keys) of every shard that gets some."""
    shard = (keys >> np.uint64(33)).astype(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, order[cuts[s] : cuts[s + 1]]


def _by_id(ids: np.ndarray, data: np.ndarray, width_: int) -> pa.Table:
    """(uid, data) rows: for each id the bytes of its data, ``width_`` numbers an entry."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    raw = data.tobytes()
    step = data.dtype.itemsize * width_
    ends = [*first[1:].tolist(), len(ids)]
    return pa.table([pa.array(ids[first], pa.int64()), pa.array([raw[a * step : b * step] for a, b in zip(first.tolist(), ends, strict=True)] if len(first) else [], pa.binary())], names=["uid", "data"])


def _repeated_triggers(hot: int):
    """One shard: (uid, ordinals of its phrases whose trigger occurs elsewhere too), and the triggers that occur more than ``hot`` times."""

    def run(table: pa.Table) -> pa.Table:
        none = [np.zeros(0, t) for t in (np.int64, np.uint32, np.uint64, np.int64)]
        ids, ordinals, triggers, weight, known, placed = ([x] for x in (none[0], none[1], none[2], none[3], none[0], none[1]))
        for _, kind, i, local, ordinal, trigger in zip(*(c.to_pylist() for c in table.columns), strict=True):
            numbers = np.frombuffer(ordinal, np.uint32)
            whose = np.frombuffer(i, np.int64)[_from_small(local, len(numbers))] if i is not None else np.full(len(numbers), -1)
            if kind == PLACES:
                known.append(whose)
                placed.append(numbers)
                continue
            ids.append(whose)
            ordinals.append(numbers)
            triggers.append(np.frombuffer(trigger, np.uint64))
            weight.append(numbers.astype(np.int64) if kind == MANY else np.full(len(numbers), -1))
        ids, ordinals, triggers, weight, known, placed = (np.concatenate(x) for x in (ids, ordinals, triggers, weight, known, placed))
        names, at = np.unique(triggers, return_inverse=True)
        count = np.bincount(at, np.abs(weight), len(names)).astype(np.int64)
        wanted = (count[at] > 1) & (weight < 0)
        out = _by_id(np.concatenate([ids[wanted], known]), np.concatenate([ordinals[wanted], placed]), 1)
        often = names[count > hot]
        top = pa.table([pa.nulls(1, pa.int64()), pa.array([often.tobytes()], pa.binary())], names=["uid", "data"])
        return pa.concat_tables([out, top]) if len(often) else out

    return run


PHRASES = "shard int, kind int, key binary, windows binary, text binary, ids binary, local binary, start binary"


def _halves(p: Phrases, some: np.ndarray, hot: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, key) of the phrases to send: those of hot triggers in two parts, each keyed by the bytes beside the trigger."""
    row, start, windows, key = p.row[some], p.start[some], p.windows[some], p.trigger[some].copy()
    at = np.flatnonzero(np.isin(key, hot)) if len(hot) else np.zeros(0, np.int64)
    if not len(at):
        return row, start, windows, key
    half, anchor = (span - GRAM) // 2, p.anchor[some][at]
    first = np.clip(anchor - half - start[at] + 1, 0, windows[at])  # windows that hold the bytes before the trigger
    beside = [(p.texts[r][x - half : x + GRAM], p.texts[r][x : x + span - half]) for r, x in zip(row[at].tolist(), anchor.tolist(), strict=True)]
    name = lambda side, part: int.from_bytes(hashlib.blake2b(side + part, digest_size=8).digest(), "little")
    left = np.array([name(b"<", x) for x, _ in beside], np.uint64)
    right = np.array([name(b">", x) for _, x in beside], np.uint64)
    cold = np.setdiff1d(np.arange(len(some)), at, assume_unique=True)
    row = np.concatenate([row[cold], row[at], row[at]])
    start, windows = np.concatenate([start[cold], start[at], start[at] + first]), np.concatenate([windows[cold], first, windows[at] - first])
    key = np.concatenate([key[cold], left, right])
    held = windows > 0
    return row[held], start[held], windows[held], key[held]


def _distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each text's distinct value, place of each value's first text)."""
    known: dict[bytes, int] = {}
    which = np.fromiter((known.setdefault(t, len(known)) for t in texts), np.int64, len(texts))
    return which, np.unique(which, return_index=True)[1]


def _send_phrases(shards: int, span: int, hot: np.ndarray):
    """Distinct phrases of each block, and where they occur."""

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK):
                ids = batch.column(0).slice(a, b - a).to_numpy()
                wanted = batch.column(2).slice(a, b - a).to_pylist()
                texts = [(x or b"") if w else b"" for x, w in zip(batch.column(1).slice(a, b - a).to_pylist(), wanted, strict=True)]
                p = Phrases(texts, span)
                counts = np.bincount(p.row, minlength=len(texts))
                base = np.cumsum(counts) - counts
                use = np.zeros(len(p.row), bool)
                for k, w in enumerate(wanted):
                    if w:
                        use[base[k] + np.frombuffer(b"".join(w), np.uint32).astype(np.int64)] = True
                row, start, windows, key = _halves(p, np.flatnonzero(use), hot, span)
                phrases = [texts[r][x : x + n + span - 1] for r, x, n in zip(row.tolist(), start.tolist(), windows.tolist(), strict=True)]
                at, first = _distinct(phrases)
                count = np.bincount(at, minlength=len(first))
                out = []

                def places(some):
                    used, local = np.unique(row[some], return_inverse=True)
                    return ids[used].tobytes(), _small(local, len(used)), start[some].astype(np.uint32).tobytes()

                for kind, mine in ((ONCE, first[count == 1]), (MANY, first[count > 1])):
                    for s, some in _dealt(key[mine], shards):
                        some = mine[some]
                        where = places(some) if kind == ONCE else (None, None, None)
                        out.append((s, kind, key[some].tobytes(), windows[some].astype(np.uint16).tobytes(), b"".join([phrases[k] for k in some.tolist()]), *where))
                if len(again := np.flatnonzero(count[at] > 1)):
                    out.append((int(ids[0] % shards), PLACES, None, windows[again].astype(np.uint16).tobytes(), None, *places(again)))
                yield from _emit(out, [c.split()[0] for c in PHRASES.split(", ")], [pa.int32(), pa.int32(), *[pa.binary()] * 6])

    return run


def suffix_ranks(raw: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """The rank of each place in ``at`` by the ``span`` bytes that follow it: prefix doubling from eight bytes on, so equal ranks mean equal bytes."""
    rank = np.zeros(len(raw) - 7, np.uint64)
    for k in range(8):
        rank = rank << np.uint64(8) | raw[k : len(raw) - 7 + k].astype(np.uint64)
    rank, depth = np.unique(rank, return_inverse=True)[1], 8
    while 2 * depth <= span:
        rank, depth = np.unique(rank[:-depth] * np.int64(len(raw)) + rank[depth:], return_inverse=True)[1], 2 * depth
    return np.unique(rank[at] * np.int64(len(raw)) + rank[at + span - depth], return_inverse=True)[1]


def _met_again(texts: list[bytes], windows: np.ndarray, trigger: np.ndarray, span: int) -> np.ndarray:
    """For each window of the distinct phrases (those of one trigger stand together), whether another window has its rank."""
    flags = np.zeros(int(windows.sum()), bool)
    upto = np.concatenate([[0], np.cumsum(windows)])
    size = np.cumsum(windows + span - 1)
    a = 0
    while a < len(texts):
        b = int(np.searchsorted(size, (size[a - 1] if a else 0) + PIECE, "right"))
        b = max(b, a + 1)
        while b < len(texts) and trigger[b] == trigger[b - 1]:
            b += 1
        begins = size[a:b] - windows[a:b] - span + 1 - (size[a - 1] if a else 0)
        ranks = suffix_ranks(np.frombuffer(b"".join(texts[a:b]), np.uint8), _ranges(begins, windows[a:b]), span)
        flags[upto[a] : upto[b]] = np.bincount(ranks)[ranks] > 1
        a = b
    return flags


def _repeated_windows(span: int):
    def run(table: pa.Table) -> pa.Table:
        none = [np.zeros(0, t) for t in (np.uint64, np.int64)]
        key, windows, texts, kinds, ids, starts, which = [none[0]], [none[1]], [], [none[1]], [none[1]], [none[1]], [none[1]]
        known, spans = [none[1]], [np.zeros((0, 2), np.int64)]
        for _, kind, t, n, text, i, local, start in zip(*(c.to_pylist() for c in table.columns), strict=True):
            n = np.frombuffer(n, np.uint16).astype(np.int64)
            if i is not None:
                begin = np.frombuffer(start, np.uint32).astype(np.int64)
                whose = np.frombuffer(i, np.int64)[_from_small(local, len(begin))]
            if kind == PLACES:
                known.append(whose)
                spans.append(np.stack([begin, begin + n + span - 1], 1))
                continue
            if kind == ONCE:
                ids.append(whose)
                starts.append(begin)
                which.append(len(texts) + np.arange(len(n)))
            key.append(np.frombuffer(t, np.uint64))
            windows.append(n)
            kinds.append(np.full(len(n), kind))
            ends = np.cumsum(n + span - 1)
            texts += [text[b - s : b] for b, s in zip(ends.tolist(), (n + span - 1).tolist(), strict=True)]
        key, windows, kinds, ids, starts, which = (np.concatenate(x) for x in (key, windows, kinds, ids, starts, which))
        phrase, first = _distinct(texts)
        by_key = np.argsort(key[first], kind="stable")
        place = np.empty(len(first), np.int64)
        place[by_key] = np.arange(len(first))
        phrase, first = place[phrase], first[by_key]
        uses = np.bincount(phrase, 1 + (kinds == MANY), len(first)).astype(np.int64)
        occur = phrase[which]  # the parse: the phrase of each occurrence
        _, key_at, sharing = np.unique(key[first], return_inverse=True, return_counts=True)
        meets = np.flatnonzero(sharing[key_at] > 1)
        span_from, span_to, span_of = [], [], []
        whole_ones = np.flatnonzero(uses > 1)
        span_of.append(whole_ones)
        span_from.append(np.zeros(len(whole_ones), np.int64))
        span_to.append(windows[first[whole_ones]] + span - 1)
        if len(meets):
            n = windows[first[meets]]
            hit = _met_again([texts[k] for k in first[meets]], n, key[first[meets]], span)
            hit &= np.repeat(uses[meets] == 1, n)
            owner, place = np.repeat(np.arange(len(meets)), n), _ranges(np.zeros(len(n), np.int64), n)
            at = np.flatnonzero(hit)
            if len(at):
                new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
                head, tail = at[new], at[np.concatenate([new[1:], [True]])]
                span_of.append(meets[owner[head]])
                span_from.append(place[head])
                span_to.append(place[tail] + span)
        span_of, span_from, span_to = np.concatenate(span_of), np.concatenate(span_from), np.concatenate(span_to)
        order = np.argsort(span_of, kind="stable")
        span_of, span_from, span_to = span_of[order], span_from[order], span_to[order]
        count = np.bincount(span_of, minlength=len(first))
        base = np.cumsum(count) - count
        pick = _ranges(base[occur], count[occur])
        each = np.repeat(np.arange(len(occur)), count[occur])
        found = np.stack([starts[each] + span_from[pick], starts[each] + span_to[pick]], 1)
        return _by_id(np.concatenate([ids[each], *known]), np.concatenate([found, *spans]), 2)

    return run


def _union(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint (from, to) rows that cover the same bytes; touching ones merge."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([new[1:], [True]])]], 1)


def _widened(spans: np.ndarray, text: bytes) -> np.ndarray:
    """The spans with the whole of every character that they split."""
    inside = np.append((np.frombuffer(text, np.uint8) & 0xC0) == 0x80, False)
    while len(some := np.flatnonzero(inside[spans[:, 0]] & (spans[:, 0] > 0))):
        spans[some, 0] -= 1
    while len(some := np.flatnonzero(inside[spans[:, 1]])):
        spans[some, 1] += 1
    return _union(spans)


def _cut(names: list[str], whole_characters: bool):
    def run(batches):
        for batch in batches:
            texts, found, copied = (batch.column(c).to_pylist() for c in ("__bytes", "__spans", "__copied"))
            kept, spans = [], []
            for text, data, copy in zip(texts, found, copied, strict=True):
                text = text or b""
                cuts = np.array([[0, len(text)]]) if copy else _union(np.frombuffer(b"".join(data or ()), np.int64).reshape(-1, 2))
                cuts = _widened(cuts, text) if whole_characters and len(cuts) else cuts
                parts, at = [], 0
                for a, b in cuts.tolist():
                    parts.append(text[at:a])
                    at = b
                kept.append(b"".join([*parts, text[at:]]))
                spans.append([{"from": a, "to": b} for a, b in cuts.tolist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))], names=[*names, "kept", "removed"])

    return run


def _wanted(lines: DataFrame, shards: int, span: int) -> tuple[DataFrame, np.ndarray]:
    """(uid, wanted): for each text the ordinals of its phrases whose trigger occurs elsewhere too; and the hot triggers."""
    sent = lines.select("__uid", "__bytes").mapInArrow(_send_triggers(shards, span), TRIGGERS)
    found = staged(sent.groupBy("shard").applyInArrow(_repeated_triggers(HOT), "uid bigint, data binary"), "repeats-triggers")
    hot = [np.frombuffer(r["data"], np.uint64) for r in found.where("uid is null").select("data").collect()]  # one in HOT occurrences at most
    return found.where("uid is not null").groupBy("uid").agg(F.collect_list("data").alias("wanted")), np.concatenate([np.zeros(0, np.uint64), *hot])


def _spans(lines: DataFrame, wanted: DataFrame, hot: np.ndarray, shards: int, span: int) -> DataFrame:
    """(__uid, __spans): for each text its repeated byte ranges, packed."""
    release(lines.sparkSession)
    asked = lines.join(wanted.withColumnRenamed("uid", "__uid"), "__uid").select("__uid", "__bytes", "wanted")
    phrases = asked.mapInArrow(_send_phrases(shards, span, hot), PHRASES)
    met = phrases.groupBy("shard").applyInArrow(_repeated_windows(span), "uid bigint, data binary")
    return staged(met.groupBy(F.col("uid").alias("__uid")).agg(F.collect_list("data").alias("__spans")), "repeats-spans")


def remove_repeats(docs: DataFrame, text: str = "text", span: int = 200, whole_characters: bool = False) -> DataFrame:
    """``docs`` with ``kept`` (binary) and ``removed`` (array of byte ranges) instead of ``text``.

    A byte goes if a string of ``span`` bytes that covers it also starts anywhere else, in the same text or another; strings are
    judged on the input and never cross texts. With ``whole_characters`` a character that a range splits goes whole. A null text is
    empty and loses nothing; repeated rows repeat each other's text; other columns pass through, but for ones named kept or removed,
    which are replaced; an empty table gives no rows. Of equal texts one is parsed, as all of them go whole. Rows are known by a 64-bit
    hash of id and text, equal texts by two hashes (64 and 32 bits) and their size; phrases and windows are compared by their bytes.
    ``span`` is at least 32.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rest = [c for c in docs.columns if c not in (text, "kept", "removed")]
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(*rest, raw.alias("__bytes"), F.xxhash64(raw).alias("__h"), F.hash(raw).alias("__h2"))
    rows = rows.withColumn("__uid", F.xxhash64(*[c for c in rest if c == "doc_id"], F.col("__h"), F.lit(span)))
    lines = rows.where(F.octet_length("__bytes") >= span)
    same = ["__h", "__h2", "__size"]
    sized = lines.withColumn("__size", F.octet_length("__bytes"))
    equal = staged(sized.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("__uid").alias("lead")), "repeats-texts")
    copies = staged(equal.where("n > 1").select(*same, "lead"), "repeats-copies")
    shards = max(2 * width(spark), (equal.agg(F.sum(F.col("__size").cast("bigint"))).first()[0] or 0) // SHARD_BYTES)
    single = sized.join(hinted(copies, 2_000_000), same, "left").where("lead is null or lead = __uid").select("__uid", "__bytes")
    spans = _spans(single, *_wanted(single, shards, span), shards, span)
    release(spark)
    marked = rows.withColumn("__size", F.octet_length("__bytes")).join(hinted(copies.select(*same, F.lit(True).alias("__copied")), 2_000_000), same, "left").join(spans, "__uid", "left")
    marked = marked.withColumn("__copied", F.coalesce("__copied", F.lit(False)))
    schema = docs.select(*rest).withColumn("kept", F.lit(b"")).withColumn("removed", F.array(F.struct(F.lit(0).cast("bigint").alias("from"), F.lit(0).cast("bigint").alias("to")))).schema
    for f in (schema["kept"], schema["removed"]):
        f.nullable = True
    return marked.mapInArrow(_cut(rest, whole_characters), schema)
