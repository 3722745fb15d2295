import hashlib
import random
from collections import Counter

import pytest

from millrace.llm import repeats


def brute(texts, span):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        spans, i = [], 0
        while i < len(t):
            if gone[i]:
                j = i
                while j < len(t) and gone[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out.append((bytes(c for c, g in zip(t, gone) if not g), spans))
    return out


def check(spark, texts, span, parts=4):
    table = spark.createDataFrame([(i, t, "k", i % 3) for i, t in enumerate(texts)], "doc_id long, text string, kept string, removed int").repartition(parts)
    rows = {r.doc_id: r for r in repeats.remove_repeats(table, span=span).collect()}
    assert len(rows) == len(texts)
    for i, (kept, spans) in enumerate(brute(texts, span)):
        assert bytes(rows[i].kept) == kept, i
        assert [(s["from"], s["to"]) for s in rows[i].removed] == spans


def made(seed, span, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    text = lambda size: " ".join(word() for _ in range(size))
    shared = [text(rng.randrange(2, 120)) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = [text(rng.randrange(0, 60)) if rng.random() < 0.6 else rng.choice(shared)[rng.randrange(20) :] for _ in range(rng.randrange(1, 6))]
        out.append(rng.choice(["", " "]).join(parts))
    return out + rng.choices(out, k=6)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    check(spark, made(seed, 200), 200)


def test_periodic_null_empty_and_edges(spark):
    rng = random.Random(9)
    noise = "".join(rng.choice("abcdefghijklmnop") for _ in range(399))
    check(spark, [None, "", "=" * 1000, "x" * 199, "y" * 200, "z" * 201, "ab" * 150, "=" * 205 + "q", noise, noise[:200] + "!", noise[:199] + "?", noise[150:349] + "$", "é" * 150, ("0123456789" * 7 + "\n") * 9], 200)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    texts = made(5, 200, 30)
    got = repeats.Phrases([t.encode() for t in texts], 200)
    assert got.windows.sum() == sum(max(0, len(t.encode()) - 199) for t in texts)
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(9000))
    check(spark, [long, long[3000:3400] + "tail", *texts], 200)


def test_repeated_rows_and_empty_table(spark):
    t = "".join(chr(97 + i * 7 % 26) for i in range(50)) * 2 + "".join(random.Random(1).choices("abcdefgh", k=300))
    table = spark.createDataFrame([(1, t), (1, t), (None, t + "x"), (None, "short")], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, bytes(r.kept)) for r in repeats.remove_repeats(table).collect())
    assert rows == [(0, b"short"), (0, b"x"), (1, b""), (1, b"")]
    assert repeats.remove_repeats(table.limit(0)).count() == 0


@pytest.mark.parametrize("span", [32, 64, 100, 200])
def test_suffix_ranks_are_the_order_of_the_bytes(span):
    import numpy as np

    rng = random.Random(span)
    block = bytes(rng.choices(b"ab", k=300))
    raw = block + bytes(rng.choices(b"abc", k=400)) + block[20:280] + b"\xff" * 230 + b"\x00" * 230
    at = np.array(rng.sample(range(len(raw) - span + 1), 500))
    strings = [raw[k : k + span] for k in at.tolist()]
    order = {x: k for k, x in enumerate(sorted(set(strings)))}
    assert repeats.suffix_ranks(np.frombuffer(raw, np.uint8), at, span).tolist() == [order[x] for x in strings]


def test_equal_hashes_of_unequal_bytes_remove_nothing(spark, monkeypatch):
    """All windows share one trigger value, so everything meets in one shard and only bytes tell windows apart."""
    import numpy as np

    texts = made(8, 200, 12)
    plain = repeats.Phrases._parse

    def parse(self, batch):
        out = plain(self, batch)
        return [*out[:3], np.zeros_like(out[3]), out[4]]

    monkeypatch.setattr(repeats.Phrases, "_parse", parse)
    rows = [(i, t) for i, t in enumerate(texts)]
    lines = [t.encode() for _, t in rows if len(t.encode()) >= 200]
    p = repeats.Phrases(lines, 200)
    parts = [lines[r][x : x + n + 199] for r, x, n in zip(p.row.tolist(), p.start.tolist(), p.windows.tolist())]
    which, first = repeats._distinct(parts)
    hit = repeats._met_again([parts[k] for k in first], p.windows[first], p.trigger[first], 200)
    windows = [parts[k][x : x + 200] for k in first for x in range(p.windows[k])]
    seen = Counter(windows)
    assert hit.tolist() == [seen[w] > 1 for w in windows]


def test_whole_characters_go(spark):
    shared = "".join(random.Random(2).choices("abcdefgh", k=300))
    table = spark.createDataFrame([(1, "é" + shared + "é a\ufffdb"), (2, "ê" + shared + "ê b"), (3, "x" + shared)], "doc_id long, text string")
    out = {r.doc_id: bytes(r.kept).decode() for r in repeats.remove_repeats(table, whole_characters=True).collect()}
    assert out == {1: "é a\ufffdb", 2: "ê b", 3: "x"}


@pytest.mark.parametrize("block", [300, 2_000_000])
def test_hot_triggers_are_cut_in_two_and_lose_nothing(spark, monkeypatch, block):
    """A common line with ever other text around it, a common passage, and blocks of one text or of all."""
    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    line, passage, head, tail = noise(60), noise(260), noise(90), noise(90)
    texts = [noise(rng.randrange(50, 300)) + line + noise(rng.randrange(50, 300)) for _ in range(20)]
    texts += [noise(40) + head + line + noise(120) for _ in range(4)] + [noise(120) + line + tail + noise(40) for _ in range(4)]
    texts += [head * 2 + line + tail, noise(9) + head * 2 + line + noise(60), noise(70) + line + tail * 2, noise(3) + line + tail * 2 + noise(4)]
    texts += [noise(30) + passage + noise(30) for _ in range(12)] + [passage + noise(20) + passage]
    check(spark, texts, 200)
