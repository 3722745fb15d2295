import math
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import toxicity


def made(spark, n=600, seed=1):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(200)]
    rows = []
    for i in range(n):
        words = [rng.choice(base) for _ in range(rng.randrange(5, 80))]
        toxic = i % 8 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vilewort", "schlimmest" + rng.choice(base), "Nasty,"]))
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_held_out_accuracy(spark):
    rows = made(spark)
    train = rows.where("doc_id % 5 <> 0")
    model = toxicity.fit(rows, train.select("doc_id", "label"))
    out = toxicity.add_score(rows.where("doc_id % 5 = 0"), model).toPandas()
    assert ((out.score >= 0.5).astype(int) == out.label).mean() > 0.97
    assert model.accuracies and model.correlations.shape[0] == len(model.accuracies)


def test_edge_rows(spark):
    rows = made(spark, 200)
    model = toxicity.fit(rows, rows.select("doc_id", "label").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, label int")))
    odd = spark.createDataFrame([(1, None, 5.0), (1, None, 5.0), (2, "", 1.0), (3, "vilewort " * 30000, 0.0)], "doc_id long, text string, score double")
    scores = [r.score for r in toxicity.add_score(odd, model).collect()]
    assert len(scores) == 4 and scores[0] == scores[1] == scores[2] and all(0 <= s <= 1 for s in scores) and scores[3] >= 0.5 > scores[0]
    assert toxicity.add_score(odd.limit(0), model).count() == 0


def test_one_class_or_no_labels(spark):
    rows = made(spark, 40)
    for labels in (rows.select("doc_id", F.lit(0).alias("label")), rows.select("doc_id", "label").limit(0)):
        out = toxicity.add_score(rows, toxicity.fit(rows, labels))
        assert out.where("score >= 0.5").count() == 0


def test_query(spark, sf_dir):
    from millrace.llm.queries import op9_toxicity

    out = op9_toxicity(spark, sf_dir)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert out.where((F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)) | (F.col("predicted") != (F.col("score") >= 0.5).cast("int"))).count() == 0


def test_posteriors_come_from_votes_alone():
    """On votes drawn from a known model, the label model finds its accuracies and tells the classes apart; a plain loop agrees."""
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.15
    right = np.array([0.9, 0.8, 0.85, 0.7, 0.95])
    votes = np.where(rng.random((4000, 5)) < np.where(truth[:, None], right, 1 - (1 - right) * 0.4), np.where(truth[:, None], 1, -1), 0).astype(np.int8)
    noise = rng.random(votes.shape) < 0.05
    votes = np.where(noise, -votes, votes)
    q, chance, corr = toxicity.posteriors(votes, 0.15)
    assert ((q >= 0.5) == truth).mean() > 0.97
    assert np.abs(chance[2, 0] - right * 0.95).max() < 0.06 and corr.shape == (5, 5)
    weight = 1 / (1 + np.clip(corr - np.eye(5), 0, None).sum(axis=1))
    for row in range(0, 4000, 97):
        odds = math.log(0.15 / 0.85) + sum(weight[j] * (math.log(chance[v + 1, 0, j]) - math.log(chance[v + 1, 1, j])) for j, v in enumerate(votes[row].tolist()))
        assert abs(1 / (1 + math.exp(-odds)) - q[row]) < 0.02


def test_null_ids_are_not_held_out(spark, tmp_path):
    from millrace.llm.queries import op9_toxicity

    rows = made(spark, 60).withColumn("doc_id", F.expr("nullif(doc_id, 7)"))
    rows.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows.select("doc_id", F.col("label").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    assert [r.held_out for r in op9_toxicity(spark, str(tmp_path)).where("doc_id is null").collect()] == [False]
