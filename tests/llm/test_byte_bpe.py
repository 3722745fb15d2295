import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import byte_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.load_ranks(PATH)
TEXTS = [None, "", " ", "a", "The quick brown fox's  tail\n\n jumps\t12345 times!", "éèê ça où — “x”  y\x85z\x1c q", "日本語テキスト 🎉🎉 𝒳", "=" * 700 + "ab" * 300, "a\x00b\r\n \r\n", "naïve " * 2000]


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_matches_the_library_and_round_trips(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, token_ids string")
    out = byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "token_ids"]
    rows = out.withColumn("back", byte_bpe.decode(F.col("token_ids"), RANKS)).collect()
    enc = library()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        text = (TEXTS + TEXTS)[r.doc_id] or ""
        assert r.token_ids == enc.encode_ordinary(text), text[:40]
        assert bytes(r.back).decode() == text


def test_empty_table(spark):
    assert byte_bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).count() == 0


def test_higher_order_fold_equals_the_numpy_fold(spark):
    words = ["", "a", " the", " unbelievably", "éèê", "xxxxxxxxxxxxxxxx", " Zusammenhang", "$$$***"]
    fold = byte_bpe.RankLiterals(RANKS)
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", fold.encode(F.col("w").cast("binary")).alias("ids")).collect()
    enc = library()
    table = byte_bpe.RankTable(RANKS)
    for r in rows:
        ids, _ = table.encode([r.w.encode()])
        assert r.ids == ids.tolist() == enc.encode_ordinary(r.w)


def test_expressions_alone_give_the_same(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    enc = library()
    for r in byte_bpe.encode_by_expressions(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert r.token_ids == enc.encode_ordinary(TEXTS[r.doc_id] or "")


def test_query_on_the_small_table(spark, sf_dir):
    from millrace.llm.queries import op7_byte_bpe

    enc = library()
    rows = {r.doc_id: r for r in op7_byte_bpe(spark, sf_dir).collect()}
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for d in texts:
        ids = enc.encode_ordinary(d.text or "")
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_long_matches_equal_the_library_and_take_no_square_of_their_length():
    import random
    import time

    rng = random.Random(1)
    table, enc = byte_bpe.RankTable(RANKS), library()
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3000))
    for word in (letters, "a" * 1000, "=" * 777, "na" * 500 + "x", "é" * 400, letters[: byte_bpe.LONG + 1]):
        data = word.encode()
        ids, _ = table.encode([data])
        assert ids.tolist() == enc._core_bpe.encode_single_piece(data)
        assert table.fold_long(data).tolist() == ids.tolist()
    million = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)).encode()
    start = time.time()
    ids = table.fold_long(million)
    assert time.time() - start < 60
    pieces = {rank: token for token, rank in RANKS.items()}
    assert b"".join(pieces[i] for i in ids.tolist()) == million
