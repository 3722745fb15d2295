import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import length_buckets


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 200), rng.randrange(1, 11)))
        counts = [rng.randrange(1, 50) for _ in lengths]
        for k in (1, 2, 3, 4):
            got = length_buckets.optimal_bounds(np.array(lengths), np.array(counts), k)
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
            assert len(got) <= k and got[-1] == lengths[-1] and padding(lengths, counts, got) == best


def test_every_row_is_packed_once_within_the_budget(spark):
    rng = random.Random(3)
    rows = [(i, "w " * min(4000, int(rng.paretovariate(0.8) * 3)), 9) for i in range(800)]
    rows += [(None, None, 1), (5, "", 1), (5, "", 1), (900, "w " * 30_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    out = length_buckets.pack(docs, buckets=6, budget=5000).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out) == sorted((i or -1, len((t or "").split()) + 1) for i, t, _ in rows)
    batches = {}
    for r in out:
        assert 0 <= r.padding == r.pad_to - r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for rs in batches.values():
        assert len({r.pad_to for r in rs}) == 1
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert len(rs) == 1 or len(rs) * rs[0].pad_to <= 5000
    full = {}
    for (bucket, batch), rs in batches.items():
        full.setdefault(bucket, {})[batch] = len(rs)
    for sizes in full.values():
        assert sorted(sizes) == list(range(len(sizes))) and len({sizes[k] for k in range(len(sizes) - 1)}) <= 1
    assert length_buckets.pack(docs.limit(0)).count() == 0


def test_bounds_of_long_texts_are_optimal(spark):
    rng = random.Random(5)
    sizes = [rng.choice([8_193, 8_195, 9_001, 9_003, 12_345, 12_351, 20_000]) for _ in range(40)] + [3, 8_192]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n long")
    lengths = sorted(set(sizes))
    counts = [sizes.count(x) for x in lengths]
    for k in (1, 3, 5):
        out = length_buckets.pack(docs, F.col("n"), buckets=k).collect()
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], k - 1))
        assert sum(r.padding for r in out) == best
        assert {r.pad_to for r in out} <= set(sizes)


def test_the_blocks_of_rows_do_not_change_the_batches(spark, monkeypatch):
    monkeypatch.setattr(length_buckets, "BLOCK_ROWS", 2)
    docs = spark.createDataFrame([(None if i % 3 else 1, 10) for i in range(500)], "doc_id long, n long")
    out = length_buckets.pack(docs, F.col("n"), budget=100).collect()
    assert sorted((r.batch, r.slot) for r in out) == [(b, s) for b in range(50) for s in range(10)]


def test_batches_hold_the_token_ids(spark):
    rng = random.Random(8)
    rows = [(i, [rng.randrange(1, 50_000) for _ in range(rng.randrange(0, 90))]) for i in range(150)] + [(500, None), (7, [1, 2]), (7, [3])]
    docs = spark.createDataFrame(rows, "doc_id long, token_ids array<int>")
    out = length_buckets.fill_batches(docs, pad=-1, buckets=4, budget=300).collect()
    back = []
    for r in out:
        assert all(len(t) == r.pad_to for t in r.tokens) and (len(r.tokens) == 1 or len(r.tokens) * r.pad_to <= 300)
        assert all(set(t[n:]) <= {-1} for t, n in zip(r.tokens, r.sizes))
        back += [(i, tuple(t[:n])) for i, t, n in zip(r.doc_ids, r.tokens, r.sizes)]
    assert sorted(back) == sorted((i, tuple(t or ())) for i, t in rows)
