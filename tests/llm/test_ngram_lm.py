import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import ngram_lm, queries


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\0end"]


def grams(d):
    return list(zip(["\0start", "\0start", *d[:-2]][: len(d)], ["\0start", *d[:-1]], d))


def brute(rows, train=None, order=3):
    train = [words(t) for i, t in (rows if train is None else train) if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    uni = Counter(w for d in train for w in d)
    third = Counter(g for d in train for g in grams(d))
    pair, big, ctx = Counter(), Counter(), Counter()
    for (b, c, w), n in third.items():
        pair[b, c] += n
        big[c, w] += n
        ctx[c] += n
    n, v = sum(uni.values()), len(uni)
    k = lambda x: (1 + x) ** -ngram_lm.DECAY

    def log_p(b, c, w):
        if order == 3 and third[b, c, w]:
            return math.log10((1 - k(pair[b, c])) * third[b, c, w] / pair[b, c])
        lower = math.log10((1 - k(ctx[c])) * big[c, w] / ctx[c]) if big[c, w] else math.log10(k(ctx[c]) * (uni[w] + 0.5) / (n + 0.5 * (v + 1)))
        return (math.log10(k(pair[b, c])) if order == 3 else 0.0) + lower

    for i, t in rows:
        d = words(t)
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in d)
        yield i, len(d), sum(uni[w] > 0 for w in d), n, base, sum(log_p(*g) for g in grams(d))


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    return [(i, " ".join(rng.choice(["The", "of", rng.choice(vocabulary), rng.choice(vocabulary)]) for _ in range(rng.randrange(0, 120)))) for i in range(n)]


def agree(got, want):
    got, want = (sorted(x, key=lambda r: str(r[:4])) for x in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert g[5] == pytest.approx(w[5], abs=1e-4 * max(1, g[1]))
        assert g[6] == (g[0] is not None and zlib.crc32(str(g[0]).encode()) % 5 == 1)
        assert g[5] < 0


def listed(df):
    return [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) for r in df.collect()]


@pytest.mark.parametrize("seed, shard_tokens, order", [(1, 1_200_000, 3), (2, 60, 3), (3, 60, 2)])
def test_equals_brute_force(spark, seed, shard_tokens, order):
    """With many small shards the frequent words, contexts and pairs are dealt over all of them."""
    rows = corpus(seed) + [(1000, None), (1001, ""), (1002, " \n "), (None, "a b"), (1003, "x " * 20000), (1004, "of The " * 3000)]
    rows += rows[:3] + rows[-2:]
    table = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(4)
    known = ngram_lm.survey(ngram_lm._lines(table), shard_tokens, order)
    assert len(known.words.keys) and len(known.contexts.keys) and (len(known.pairs.keys) > 0) == (order == 3) and len(known.pairs.keys) <= 4 * known.shards
    agree(listed(ngram_lm.score_documents(table, shard_tokens, order=order)), list(brute(rows, order=order)))


@pytest.mark.parametrize("order", [2, 3])
def test_a_kept_model_scores_other_documents(spark, tmp_path, order):
    rows = corpus(3, 120)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    ngram_lm.score_documents(table, 500, f"{tmp_path}/model", order).collect()
    others = [(i + 5000, t) for i, t in corpus(4, 60)] + [(9000, "never seen words"), (9001, None)]
    got = listed(ngram_lm.score_by_model(spark, spark.createDataFrame(others, "doc_id long, text string"), f"{tmp_path}/model"))
    agree(got, list(brute(others, train=rows, order=order)))


def test_documents_that_occur_twice_score_higher(spark):
    """A model of the whole corpus gives a text that stands there twice more than it gives one that stands there once."""
    rng = random.Random(6)
    text = lambda: " ".join(f"v{rng.randrange(400)}" for _ in range(200))
    rows = [(i, text()) for i in range(100)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    out = {r.doc_id: r.score for r in ngram_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    trained = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    once = [out[i] for i in range(20, 100) if trained(i)]
    twice = [out[i] for i in range(20) if trained(i) and trained(200 + i)]
    assert min(twice) > max(once)


def test_trie_finds_exactly_what_it_holds():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    owner = np.sort(rng.integers(0, len(keys), 5000))
    other = rng.integers(0, 2**40, 5000, dtype=np.uint64)
    other[::3] %= np.uint64(50)
    order = np.lexsort((other, owner))
    owner, other = owner[order], other[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])])
    owner, other = owner[new], other[new]
    values = rng.random(len(owner))
    data = ngram_lm.Trie.build(keys, np.zeros(len(keys)), owner, other, values)
    assert len(data) < len(keys) * 9 + len(owner) * 8 + 300_000
    trie = ngram_lm.Trie(data)
    at = trie.successor(owner, other)
    assert (at == np.arange(len(owner))).all()
    assert np.abs(trie.value(at) - values).max() < 1e-4
    held = set(zip(owner.tolist(), other.tolist()))
    probe = [(int(o), int(x)) for o, x in zip(rng.integers(0, len(keys), 2000), rng.integers(0, 60, 2000))]
    found = trie.successor(np.array([p[0] for p in probe]), np.array([p[1] for p in probe], np.uint64))
    assert [f >= 0 for f in found] == [p in held for p in probe]
    assert trie.find_key(np.array([1, keys[7]], np.uint64)).tolist() == [-1, 7]


def test_empty(spark):
    assert ngram_lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n, keys", [(0, 0), (1, 1), (9, 3), (5000, 4000), (20_000, 7)])
def test_elias_fano_widths(n, keys):
    rng = np.random.default_rng(n)
    key = np.unique(rng.integers(0, 2**64, keys, dtype=np.uint64))
    pairs = np.unique(np.stack([rng.integers(0, max(1, len(key)), n).astype(np.uint64), rng.integers(0, 2**40, n, dtype=np.uint64)], 1), axis=0)
    trie = ngram_lm.Trie(ngram_lm.Trie.build(key, np.arange(len(key)), pairs[:, 0].astype(np.int64), pairs[:, 1], np.zeros(len(pairs))))
    assert trie.find_key(key).tolist() == list(range(len(key)))
    assert (trie.find_key(rng.integers(0, 2**64, 50, dtype=np.uint64)) == -1).all()
    assert trie.successor(pairs[:, 0].astype(np.int64), pairs[:, 1]).tolist() == list(range(len(pairs)))
    assert not n or (trie.successor(pairs[:, 0].astype(np.int64), pairs[:, 1] ^ np.uint64(1)) == -1).mean() > 0.99


def test_the_query_takes_trigrams(spark, tmp_path):
    rows = corpus(5, 80) + [(500, None), (None, "of The of"), (501, "of The " * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    agree(listed(queries.op6_ngram_lm(spark, str(tmp_path))), list(brute(rows)))


def test_equal_blocks_and_ids_of_another_type(spark):
    """Partitions that hold the same rows are blocks of their own; ids keep their type."""
    rows = [(str(i), t) for i, t in corpus(7, 40)]
    table = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    agree(listed(ngram_lm.score_documents(table.union(table))), list(brute(rows + rows)))
