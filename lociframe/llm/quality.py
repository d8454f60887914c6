"""Quality by logistic regression on hashed word n-grams, trained with follow the regularised leader.

Words are runs of letters or of other marks, case kept; n-grams are words and pairs. Each
coordinate's weight is the closed-form minimiser of the FTRL-proximal objective with L1 and
L2 terms (McMahan et al., 2013). Scores are sparse dot products.

Defined cases: null text counts as empty and gets the score of the bias; without labelled
rows every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm import features as ft


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the training sample: the labelled rows with the smallest hashes of doc_id."""

    rows: int = 12000
    epochs: int = 3
    alpha: float = 0.2
    beta: float = 1.0
    l1: float = 0.3
    l2: float = 0.5
    seed: int = 11
    hashing: ft.Hashing = ft.Hashing(bits=18, runs=True, bigrams=True, lower=False)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    hashing: ft.Hashing


def ftrl(rows: ft.Rows, y: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """One pass an epoch over the rows, a coordinate-wise proximal step for each."""
    size = 1 << s.hashing.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    bounds, index, values = rows
    rng = np.random.default_rng(s.seed)

    def weight(at: np.ndarray) -> np.ndarray:
        out = np.where(np.abs(z[at]) > s.l1, -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2), 0)
        if at[-1] == size:  # no penalty on the bias
            out[-1] = -z[size] / ((s.beta + np.sqrt(n[size])) / s.alpha)
        return out

    for _ in range(s.epochs):
        for i in rng.permutation(len(y)):
            at = np.append(index[bounds[i] : bounds[i + 1]], size)
            x = np.append(values[bounds[i] : bounds[i + 1]], 1.0)
            w = weight(at)
            g = (ft.sigmoid(w @ x) - y[i]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    w = weight(np.arange(size + 1))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks; pass only rows that may be learned from."""
    said = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # at most s.rows ids, so the broadcast is bounded
    chosen = said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.rows)
    # of rows that share a doc_id one is taken
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got, rows = ft.gather(texts, s.hashing, ("doc_id", "quality"))
    if not len(got["doc_id"]):
        return Model(np.zeros(1 << s.hashing.bits), 0.0, s.hashing)
    weights, bias = ftrl(rows, got["quality"].astype(np.float64), s)
    return Model(weights, bias, s.hashing)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without ``text``, with ``score``: how likely each whole text is of good quality."""
    return ft.score(docs, model.hashing, model.weights, model.bias)
