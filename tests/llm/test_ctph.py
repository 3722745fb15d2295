import hashlib
import random

from millrace.llm import ctph


def brute(docs):
    docs = sorted(docs, key=lambda d: -d[0])
    for k, (i, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(text) // 2
        yield i, text, text[: len(text) - half] + after[:half], after


def plain_fingerprint(data):
    """The fingerprint by the definition, a byte at a time."""
    if not data:
        return "0::"
    mask, mix, root = (1 << 64) - 1, 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
    levels = []
    for i in range(len(data) - 1):
        window = sum(data[i - j] << 8 * j for j in range(7) if i >= j)
        head = (window * mix & mask) >> 40
        levels.append((head & -head).bit_length() - 1 if head else 32)
    level = next(k for k in range(2, 40) if sum(x >= k for x in levels) <= 63)

    def signature(least):
        out, chunk, power = "", 0, 1
        for i, byte in enumerate(data):
            chunk, power = chunk + (byte + 1) * power & mask, power * root & mask
            if i == len(data) - 1 or levels[i] >= least:
                code = (chunk * mix & mask) >> 52
                letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
                out += letters[code >> 6] + letters[code & 63]
                chunk, power = 0, 1
        return out

    return f"{level}:{signature(level)}:{signature(level + 1)}"


def plain_likeness(one, other):
    if one == other:
        return 1.0
    (k, *a), (m, *b) = one.split(":"), other.split(":")
    best = 0.0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if int(k) + i == int(m) + j and x and y:
                x2, y2 = ([z[n : n + 2] for n in range(0, len(z), 2)] for z in (x, y))
                row = list(range(len(y2) + 1))
                for p, c in enumerate(x2):
                    last, row = row, [p + 1]
                    for q, d in enumerate(y2):
                        row.append(last[q] if c == d else 1 + min(last[q + 1], row[q]))
                best = max(best, 1 - row[-1] / (len(x2) + len(y2)))
    return best


def test_fingerprints_by_their_definition():
    rng = random.Random(11)
    texts = [b"", b"x", b"z" * 400, bytes(range(256)) * 8] + [bytes(rng.choices(b"abcdefgh \n", k=n)) for n in (2, 7, 8, 100, 900, 5000)]
    texts += [texts[-1][:2500] + texts[-2] + texts[-1][2600:], texts[-1][:1200], "é€😀".encode() * 90]
    prints = [ctph.fingerprint(t) for t in texts]
    assert prints == [plain_fingerprint(t) for t in texts]
    for one in prints:
        for other in prints:
            assert abs(ctph.likeness(one, other) - plain_likeness(one, other)) < 1e-12


def test_equals_brute_force_over_ranges(spark):
    rng = random.Random(3)
    texts = [None, "", "é", "a" * 5000] + ["".join(rng.choice("abcdefgh ijk\n") for _ in range(rng.randrange(2000))) for _ in range(120)]
    docs = [(7 * i - 50, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, next_id string")
    rows = {r.doc_id: r for r in ctph.compare_edited(table).collect()}
    assert len(rows) == len(docs)
    for i, text, edited, after in brute(docs):
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints = [plain_fingerprint(x.encode()) for x in (text, edited, after)]
        assert [r.fingerprint, r.edited_fingerprint] == prints[:2]
        assert abs(r.near_edited - plain_likeness(prints[0], prints[1])) < 1e-12 and abs(r.near_next - plain_likeness(prints[0], prints[2])) < 1e-12


def test_likeness():
    rng = random.Random(5)
    for n in (300, 3000, 30000):
        a, b = ("".join(rng.choice("abcdefghij klm") for _ in range(n)) for _ in range(2))
        one, two = ctph.fingerprint(a.encode()), ctph.fingerprint((a[: n // 2] + b[n // 2 :]).encode())
        assert 0.25 < ctph.likeness(one, two) < 0.8
        assert ctph.likeness(one, ctph.fingerprint(b.encode())) < 0.15
        assert ctph.likeness(one, one) == 1
        assert len(one) < 300
    assert len(ctph.fingerprint(b"z" * 100_000)) < 300
    assert ctph.likeness(None, "0::") == 0
    assert ctph._common(list("abcbdab"), list("bdcaba")) == 4


def test_lone_repeated_null_and_empty(spark):
    schema = "doc_id long, text string"
    [r] = ctph.compare_edited(spark.createDataFrame([(4, "abcd")], schema)).collect()
    assert r.next_id == 4 and r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    rows = ctph.compare_edited(spark.createDataFrame([(4, "ab"), (4, "ab"), (None, "cd"), (5, None)], schema)).collect()
    assert len(rows) == 4 and {r.next_id for r in rows if r.doc_id is None} == {5}
    assert ctph.compare_edited(spark.createDataFrame([], schema)).count() == 0
    out = ctph.add_fingerprint(spark.createDataFrame([(1, None, 2), (1, None, 2)], "doc_id long, text string, fingerprint int")).collect()
    assert [x.fingerprint for x in out] == ["0::", "0::"]
