import random
import re

import pyarrow as pa

from millrace.llm import shingle_join


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    comp = {i: i for i, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                comp[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(seed, n=220):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 30, 120, 400, 1500]))] for _ in range(40)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 10])):
            if rng.random() < min(1, len(words) / 60):
                words[rng.randrange(len(words))] = word()
        if rng.random() < 0.4:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(words).title() if i % 2 else " ".join(words)))
    return rows


def got(spark, rows):
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int").repartition(5)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.near_duplicate_groups(table).collect())


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(spark, rows) == brute(rows)


def test_every_linked_pair_shares_a_key():
    rows = corpus(3, 300)
    r, codes = shingle_join.shingles(pa.array([t for _, t in rows]))
    import numpy as np

    sizes = np.bincount(r, minlength=len(rows))
    row, key = shingle_join.part_keys(r, codes, sizes)
    keys = [set(key[row == k].tolist()) for k in range(len(rows))]
    sets = [set(codes[r == k].tolist()) for k in range(len(rows))]
    sketches = shingle_join.parity_sketches(r, codes, sizes)
    for a in range(len(rows)):
        for b in range(a):
            assert shingle_join.sketch_distance(sketches[a], sketches[b]) <= len(sets[a] ^ sets[b])
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                assert keys[a] & keys[b]
                assert shingle_join.may_link(len(sets[a]), len(sets[b]), sketches[a], sketches[b])


def test_null_empty_repeated_and_long(spark):
    long = " ".join(str(i) for i in range(60_000))
    table = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (5, long + " x"), (None, "a b"), (None, None), (6, "A b"), (7, "a B")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.near_duplicate_groups(table).collect()), key=str)
    assert out == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 59996, 4), (4, 59996, 4), (5, 59997, 4), (None, 1, None), (None, 0, None), (6, 1, 6), (7, 1, 6)], key=str)
    assert shingle_join.near_duplicate_groups(table.limit(0)).count() == 0


def test_copies_send_parts_once_and_lose_no_link(spark):
    rows = corpus(4, 80)
    text = " ".join(f"w{k}" for k in range(200))
    near = text.replace("w100 ", "other ")
    rows += [(10_000 - k, text) for k in range(60)] + [(20_000, near), (5, near + " end"), (20_001, text.upper())]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in shingle_join._leads(table).where("leads").where(f"text = '{text}'").collect()] == [9_941]
    assert got(spark, rows) == brute(rows)


def mirrored(rounds):
    """Two words that polynomial hashes modulo a power of two can't tell apart."""
    a, b = "a", "b"
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


def test_words_that_differ_only_in_order_stay_apart(spark):
    rows = []
    for k, rounds in enumerate((10, 11)):
        rows += [(2 * k, mirrored(rounds)[0]), (2 * k + 1, mirrored(rounds)[1])]
    assert got(spark, rows) == brute(rows) == [(i, 1, i) for i in range(4)]


def test_pairs_are_verified_on_words_whatever_the_hashes(monkeypatch):
    import numpy as np

    from millrace.llm import textnum

    rows = corpus(6, 40)
    texts = [t for _, t in rows] + ["", "a", "a b", "a b c d e", "A B C D E", "a b c d"]
    pairs = [(x, y) for x in texts for y in texts[::3]]
    want = [(len(a := shingle_set(x)), len(b := shingle_set(y)), len(a & b)) for x, y in pairs]
    run = lambda: list(zip(*(n.tolist() for n in shingle_join.shared_shingles(*(pa.array([p[k] for p in pairs]) for k in (0, 1))))))
    assert run() == want
    monkeypatch.setattr(textnum.Buffer, "hashes", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    assert run() == want


def test_long_candidate_groups_are_rows_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "CHUNK", 3)
    rows = corpus(7, 120)
    assert got(spark, rows) == brute(rows)
