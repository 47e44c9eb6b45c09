"""Quality by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of quality 1, the unlabelled text is any row that may be learned from; labels of quality 0 are
never read. The class prior is estimated from these two: a first classifier, fitted on one half of them and asked about the other
and the other way round, ranks both, and above any score the unlabelled text holds at least the prior's part of what the positives
hold there; the least such ratio over scores that many positives reach is the estimate. The classifier is linear over standardised features of the
whole text (shares of kinds of characters, repetition of words and word pairs, lengths) with their squares and pairwise
products. It minimises prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]) with the logistic loss: when the
estimated negative part falls below zero, a step goes back along it instead of fitting it further.

Training reads a bounded sample, ``positives`` and ``unlabelled`` rows with the smallest hash of the id. Scoring reads
whole texts in tasks. Defined cases: null and empty texts have the features of an empty text and get a score; null
labels aren't learned; without positives every score is 0; an empty table gives no rows; repeated rows score alike;
columns other than doc_id and text are never read in a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowmill.llm.shingles import mixed, texts, words

KINDS = 12
_KIND = np.full(256, 11, np.int64)  # other signs
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 3, 4
_KIND[128:] = 5
_KIND[[ord(c) for c in ".,;:"]] = 6
_KIND[ord("!")], _KIND[ord("|")] = 7, 8
_KIND[[ord(c) for c in "'\"()?-"]] = 9
_KIND[[ord(c) for c in "#$%&*@^~<>{}[]=+_\\/"]] = 10


def features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text."""
    kinds = np.zeros((len(column), KINDS))
    for first, data, offsets in texts(column):
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(offsets))
        kinds[first : first + n] = np.bincount(row * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS)
    shape = np.zeros((len(column), 5))
    for k, h in words(column):
        n = len(h)
        if n:
            pairs = mixed(h[:-1] * np.uint64(31) + h[1:])
            shape[k] = n, len(np.unique(h)), (h[1:] == h[:-1]).sum(), len(np.unique(pairs)), n - 1
    size, count = np.maximum(kinds.sum(1), 1), np.maximum(shape[:, 0], 1)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 5], 1)
    return np.column_stack(
        [
            kinds[:, 1] / letters,
            kinds[:, 2] / size,
            kinds[:, 5] / size,
            kinds[:, 6] / count,
            np.log1p(20 * kinds[:, 7] / count),
            np.log1p(20 * kinds[:, 8] / count),
            kinds[:, 9] / count,
            np.log1p(20 * kinds[:, 10] / count),
            kinds[:, 11] / size,
            np.log1p(kinds[:, 4]) - 0.5 * np.log1p(count),
            np.log1p(count),
            np.log((shape[:, 1] + 1) / (count + 1)) / (1 + np.log1p(count)),
            np.log1p(20 * shape[:, 2] / count),
            (shape[:, 3] + 1) / (shape[:, 4] + 1),
            size / count,
        ]
    )


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -4, 4)
        i, j = np.triu_indices(x.shape[1])
        return np.concatenate([x, x[:, i] * x[:, j] / 4, np.ones((len(x), 1))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 600, ridge: float = 1e-4) -> Classifier:
    both = np.concatenate([positive, unlabelled])
    out = Classifier(both.mean(0), both.std(0) + 1e-6, np.zeros(0))
    p, u = out.expand(positive), out.expand(unlabelled)
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        gp, gu = p @ w, u @ w
        plus = -prior * (sigmoid(-gp) @ p) / len(p)  # gradient of prior * E_P[l(g)]
        minus = (sigmoid(gu) @ u) / len(u) - prior * (sigmoid(gp) @ p) / len(p)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        grad = (plus + minus if negative >= 0 else -minus) + ridge * np.r_[w[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.05 * min(1.0, 2 - 2 * t / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    out.weights = w
    return out


#: the estimate of the prior looks at scores that this share of the positives reaches at least and at most
REACHED = (0.2, 0.9)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of the unlabelled rows that could be like the positives."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    ratios = []
    for k in (0, 1):
        first = fit(positive[k::2], unlabelled[k::2], 0.5, rounds=200)
        p, u = (np.sort(first.score(x[1 - k :: 2])) for x in (positive, unlabelled))
        cuts = np.quantile(p, np.linspace(1 - REACHED[1], 1 - REACHED[0], 36), method="lower")
        above = lambda x: 1 - np.searchsorted(x, cuts) / len(x)  # noqa: B023, E731
        ratios.append(np.min(above(u) / above(p)))
    return float(np.clip(np.mean(ratios), 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = 6000, unlabelled: int = 12000) -> Classifier | None:
    """``positives`` and ``unlabelled`` bound what is collected: 15 numbers for each row; rows that repeat an id count once."""
    known = labels.where(learn & (F.col("quality") == 1)).select("doc_id").distinct()
    by_hash = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = by_hash(known, positives).withColumn("y", F.lit(1))
    picked = picked.unionByName(by_hash(docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id"), unlabelled).distinct().withColumn("y", F.lit(0)))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(batch.column(1))), pa.list_(pa.float64()))], ["y", "x"])

    once = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = once.select("y", "text").mapInArrow(run, "y int, x array<double>").toPandas()
    if not (rows["y"] == 1).any() or not (rows["y"] == 0).any():
        return None
    x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy()
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    # rows are in the order of their features here: taken in turns, both halves are alike
    return fit(x[y == 1], x[y == 0], estimated_prior(x[y == 1], x[y == 0]))


def scored(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """(doc_id, score) of every row's whole text."""
    spread = docs.sparkSession.sparkContext.broadcast(classifier)  # a few KB

    def run(batches):
        now = spread.value
        for batch in batches:
            score = now.score(features(batch.column(1))) if now else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")


def crc_mod(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32(doc_id) mod 3 is 1 are held out."""
    out = scored(docs, train(docs, labels, crc_mod(3) != 1))
    return out.select("doc_id", (crc_mod(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
