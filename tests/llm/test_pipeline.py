import hashlib
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], COLUMNS)


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for _, stage in corpus_pipeline.STAGES[:3]:
        before = table
        table = stage(spark, before, sf_dir)
        assert table.columns == before.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        table = spark.createDataFrame(table.collect(), COLUMNS)
        if stage is corpus_pipeline.drop_toxic:
            kept = {r.doc_id for r in table.collect()}
            clean = [i for i, t in labels.items() if not t]
            assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_near_duplicates_keep_one_of_each_group(spark, sf_dir):
    base = " ".join(f"w{i * i % 977}" for i in range(300))
    rows = [(5, base), (2, base + " more"), (9, base), (7, "quite another text of some words"), (8, None), (10, None), (11, "")]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == [2, 7, 8, 10, 11]


def test_repeated_rows_and_null_ids_keep_one_text_of_each_group(spark, sf_dir):
    text = lambda k: " ".join(f"{k}{i * i % 977}" for i in range(300))
    rows = [(1, text("a")), (1, text("a")), (None, text("b")), (4, text("b")), (None, text("c")), (None, text("c")), (None, text("d") + " more"), (-3, text("d"))]
    rows += [(5, text("e")), (5, text("f")), (6, text("f") + " more"), (7, text("g")), (7, text("g") + " more"), (8, None), (8, None), (9, "?" * 300), (10, "?" * 300)]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), sf_dir)
    kept = spark.createDataFrame(kept.collect(), COLUMNS)
    found = {(r.doc_id, (r.text or "")[:1]) for r in kept.collect()}
    assert found == {(1, "a"), (4, "b"), (None, "c"), (-3, "d"), (5, "e"), (5, "f"), (7, "g"), (8, ""), (9, "?")}
    assert kept.count() == 9
    assert all(len(r.text) >= 300 for r in corpus_pipeline.drop_repeats(spark, kept, sf_dir).collect() if r.doc_id not in (8, 9))


def test_repeats_go_and_texts_stay_valid(spark, sf_dir):
    shared = "".join(hashlib.sha256(str(i).encode()).hexdigest()[:9] + " " for i in range(40))
    rows = [(1, "é" + shared + "é al\ufffdpha"), (2, "ê" + shared + "ê beta"), (3, "gamma"), (4, None)]
    kept = {r.doc_id: r for r in corpus_pipeline.drop_repeats(spark, docs(spark, rows), sf_dir).collect()}
    # é and ê share their first byte in UTF-8 behind the passage, so the cut takes it and the rest of the character follows
    assert {i: r.text for i, r in kept.items()} == {1: "é al\ufffdpha", 2: "ê beta", 3: "gamma", 4: ""}
    assert all(r.n_chars == len(r.text) for r in kept.values())


def test_run_packs_what_the_stages_keep(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        table = spark.createDataFrame(stage(spark, table, sf_dir).collect(), COLUMNS)
    want = sorted((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) + 1) for r in table.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in packed) == want


def test_empty_documents(spark, sf_dir):
    table = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, sf_dir)
    assert table.count() == 0
