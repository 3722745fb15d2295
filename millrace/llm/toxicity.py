"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Words, prefixes and suffixes that labelled training texts of one label use far more often become lexicons, dealt into voters. Labels
   also give the share of toxic texts. They do nothing else.
2. A label model (expectation maximisation over the votes alone, begun from their majority) estimates how accurate each voter is for
   either class and how voters correlate beyond the class; correlated voters share their weight. It gives each text a posterior.
3. A logistic regression on the lexicon features is fitted to the posteriors and scores every text.
Everything is fitted on at most ``fit_rows`` labelled rows; every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_batches
from .textnum import NON_WORD, Buffer, blocks, mix

#: Salts of the feature kinds: whole word, first 3, 4, 5, 6 bytes, last 4 bytes.
KINDS = (("word", 0), ("head", 3), ("head", 4), ("head", 5), ("head", 6), ("tail", 4))


def features(buffer: Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, kind) of every feature of every word."""
    starts, ends, text = buffer.words(NON_WORD)
    out = []
    for kind, (what, n) in enumerate(KINDS):
        some = np.ones(len(starts), bool) if what == "word" else ends - starts > n
        a, b = starts[some], ends[some]
        a, b = (a, a + n) if what == "head" else (b - n, b) if what == "tail" else (a, b)
        out.append((mix(buffer.hashes(a, b) + np.uint64(kind + 1)), text[some], np.full(len(a), kind, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Model:
    """Sorted feature hashes with a weight each, bias and voters."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    accuracies: list[tuple[str, float, float]] = field(default_factory=list)
    correlations: np.ndarray | None = None

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if len(self.keys):
            for a, b in blocks(texts):
                which, row = found(self.keys, Buffer(texts.slice(a, b - a)))
                out[a:b] += np.bincount(row, self.weights[which], b - a)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def found(keys: np.ndarray, buffer: Buffer) -> tuple[np.ndarray, np.ndarray]:
    """Each (feature, text) that occurs, once: feature numbers and text numbers."""
    h, text, _ = features(buffer)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = keys[at] == h
    pairs = np.unique(text[hit].astype(np.int64) * len(keys) + at[hit])
    return pairs % len(keys), pairs // len(keys)


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, label) of at most ``fit_rows`` labelled rows, picked by a hash of the id; several labels of an id count as the greatest."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")


def _counts(rows: DataFrame) -> DataFrame:
    """For each feature, how many toxic and how many other texts have it; counted within blocks before the shuffle."""

    def count(batches):
        for batch in batches:
            texts, label = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in blocks(texts):
                h, row, kind = features(Buffer(texts.slice(a, b - a)))
                order = np.lexsort((row, h))
                h, row, kind = h[order], row[order], kind[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row, kind = h[first], row[first], kind[first]
                keys, at = np.unique(h, return_inverse=True)
                toxic = label[a:b][row] == 1
                kinds = np.zeros(len(keys), np.int8)
                kinds[at] = kind
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kinds), pa.array(np.bincount(at, toxic, len(keys)).astype(np.int64)), pa.array(np.bincount(at, ~toxic, len(keys)).astype(np.int64))], names=["key", "kind", "toxic", "other"])

    return rows.select("text", "label").mapInArrow(count, "key bigint, kind tinyint, toxic bigint, other bigint").groupBy("key", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def posteriors(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The label model: the chance of class 1 for each row of votes (-1, 0 or 1, a column for each voter), P(vote | class) as an array
    [vote + 1, class 1 or 0, voter], and the voters' correlations beyond the class.

    Votes of one class are taken as independent, but that voters who agree beyond it share their weight. ``prior`` is the share of class
    1: the first guess is that share of rows with the greatest sum of votes.
    """
    n, m = votes.shape
    total = votes.sum(axis=1)
    ahead = total > np.quantile(total, 1 - prior)
    q, weight, corr = np.where(ahead if ahead.any() else total > 0, 0.9, 0.1), np.ones(m), np.eye(m)
    cast = [(votes == v).astype(np.float64) for v in (-1, 0, 1)]
    for k in range(rounds):
        share = np.stack([q, 1 - q])
        chance = np.stack([(share @ hit + 0.5) / (share.sum(axis=1)[:, None] + 1.5) for hit in cast])
        if k % 5 == 0:  # what voters share beyond the class
            mean = chance[2] - chance[0]
            rest = votes - (q[:, None] * mean[0] + (1 - q)[:, None] * mean[1])
            scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            corr = (rest.T @ rest) / n / np.outer(scale, scale)
            weight = 1 / (1 + np.clip(corr - np.eye(m), 0, None).sum(axis=1))
        each = sum(np.log(chance[i]) * weight @ hit.T for i, hit in enumerate(cast))
        q = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + each[0] - each[1], -30, 30)))
    return q, chance, corr


def _logistic(rows: np.ndarray, cols: np.ndarray, n: int, d: int, target: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Gradient descent with momentum, weak quadratic penalty; classes weigh alike in the mean."""
    share = min(0.5, max(0.02, target.mean()))
    weigh = target / (2 * share) + (1 - target) / (2 * (1 - share))
    w, b, vw, vb = np.zeros(d), 0.0, np.zeros(d), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], n) + b, -30, 30)))
        g = weigh * (p - target) / n
        vw = 0.9 * vw - 2.0 * (np.bincount(cols, g[rows], d) + 1e-5 * w)
        vb = 0.9 * vb - 0.2 * g.sum()
        w, b = w + vw, b + vb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 10_000, least: float = 24.0, strong: float = 3.5, sure: float = 4.5, voters: int = 8) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1); without labels of both classes scores are near 0 or 1.

    Every feature of the fitting rows that tells the labels apart is kept: their number is bounded by ``fit_rows`` alone.
    """
    text_batches(docs.sparkSession)
    rows = staged(training_rows(docs, labels, fit_rows), "toxicity-rows")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, other = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    if not toxic or not other:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 8.0 if toxic else -8.0)
    t, o = (F.col("toxic") + 0.5) / (toxic + 1.0), (F.col("other") + 0.5) / (other + 1.0)
    # twice the log likelihood ratio of a feature's own share of toxic texts to the share overall: chance alone stays below ``least``
    n, share = F.col("toxic") + F.col("other"), toxic / (toxic + other)
    part = lambda c, p: F.when(c > 0, c * F.log(c / (n * p))).otherwise(0.0)
    ranked = _counts(rows).withColumn("odds", F.log(t / o)).withColumn("worth", 2 * (part(F.col("toxic"), share) + part(F.col("other"), 1 - share)))
    ranked = ranked.where((F.col("worth") >= least) & (F.abs("odds") >= 1.0))
    table = ranked.select("key", "kind", "odds").toPandas()
    table = table.assign(key=table["key"].to_numpy(np.int64).view(np.uint64)).sort_values("key").reset_index(drop=True)
    keys, odds, kind = table["key"].to_numpy(), table["odds"].to_numpy(), table["kind"].to_numpy()
    if not len(keys):
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(toxic / other)))

    def hits(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                which, row = found(keys, Buffer(batch.column(1).slice(a, b - a)))
                lists = np.split(which.astype(np.int32), np.cumsum(np.bincount(row, minlength=b - a))[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "hits"])

    seen = rows.mapInArrow(hits, "doc_id bigint, hits array<int>").toPandas().sort_values("doc_id", kind="stable")
    n = len(seen)
    row = np.repeat(np.arange(n), seen["hits"].map(len).to_numpy())
    col = np.concatenate(seen["hits"].to_numpy()).astype(np.int64) if n else np.zeros(0, np.int64)
    deal = (mix(keys) % np.uint64(voters)).astype(np.int64)
    votes, names = [], []
    for what, among in (("lexicon", kind == 0), ("pattern", kind > 0)):
        for k in range(voters):
            mine = among & (deal == k) & (odds > strong)
            if mine.any():
                votes.append((np.bincount(row, mine[col], n) > 0).astype(np.int8))
                names.append(f"{what} {k}")
    for k in range(3):
        mine = (odds > strong) & (deal % 3 == k)
        votes.append(-(np.bincount(row, mine[col], n) == 0).astype(np.int8))
        names.append(f"absence {k}")
    balance = np.bincount(row, odds[col], n)
    votes.append(np.where(balance > sure, 1, np.where(balance < 0, -1, 0)).astype(np.int8))
    names.append("balance")
    q, chance, corr = posteriors(np.stack(votes, 1), toxic / (toxic + other))
    w, b = _logistic(row, col, n, len(keys), q)
    return Model(keys, w, b, [(name, float(chance[2, 0, j]), float(chance[2, 1, j])) for j, name in enumerate(names)], corr)


def add_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each whole text (null: empty); other columns, rows and repeats stay as they are."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(out)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column(batch.schema.get_field_index(text))))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0.0)).schema)
