"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on hashed words and word beginnings is trained from confirmed toxic
texts and unlabelled texts. With class prior p the risk is p R+(toxic) plus
max(0, R-(unlabelled) - p R-(toxic)): the unlabelled texts' negative risk is corrected for
the toxic texts among them, and where a minibatch would drive that term below zero, the
step is taken back instead (Kiryo et al., 2017).

The unlabelled texts of the training come from all documents, with a label or without, which
is not looked at. The class prior is the share of toxic ones among the labelled documents,
between 0.0001 and 0.9. The sample is bounded in rows and in bytes a text.

Defined cases: null text counts as empty and gets the score of the bias; without toxic
labels the prior is 0 and every score is that of a bias of -4 (0.018); with labels of which
no text is there every score is the class prior; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm import features as ft


@dataclass(frozen=True)
class Settings:
    """``positives`` and ``unlabelled`` bound the training sample: the toxic labels and the documents with the smallest hashes of doc_id.

    ``longest`` bounds a text of the sample in bytes; longer ones are scored, but not learned from.

    A feature that occurs in fewer than ``least_texts`` of the training texts, or in fewer than
    a hundredth of them where that is less, keeps the weight 0.
    """

    positives: int = 4000
    unlabelled: int = 12000
    longest: int = 32_768
    epochs: int = 30
    batch: int = 512
    rate: float = 0.3
    l2: float = 1e-4
    least_texts: int = 10
    seed: int = 7
    hashing: ft.Hashing = ft.Hashing(bits=18, prefixes=(5, 6, 7))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float
    hashing: ft.Hashing


def nn_pu(toxic: ft.Rows, unlabelled: ft.Rows, prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by AdaGrad over minibatches."""
    size = 1 << s.hashing.bits
    rng = np.random.default_rng(s.seed)
    weights, squares = np.zeros(size + 1), np.full(size + 1, 1e-3)
    weights[-1] = np.log(prior / (1 - prior))
    n_toxic, n_free = len(toxic[0]) - 1, len(unlabelled[0]) - 1
    texts = ft.texts_with(toxic[1], size) + ft.texts_with(unlabelled[1], size)
    free = np.append(texts >= min(s.least_texts, (n_toxic + n_free) / 100), True)
    for _ in range(s.epochs):
        for at in np.array_split(rng.permutation(n_free), max(1, n_free // s.batch)):
            a = ft.take(toxic, rng.choice(n_toxic, min(n_toxic, s.batch // 4), replace=False))
            u = ft.take(unlabelled, at)
            za, zu = (ft.dot(x, weights[:-1]) + weights[-1] for x in (a, u))
            pa, pu = ft.sigmoid(za), ft.sigmoid(zu)
            if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, za).mean() >= 0:
                ga, gu = prior * (pa - 1) / len(za) - prior * pa / len(za), pu / len(zu)
            else:
                ga, gu = prior * pa / len(za), -pu / len(zu)
            step = sum(np.bincount(x[1], np.repeat(g, np.diff(x[0])) * x[2], minlength=size + 1) for x, g in ((a, ga), (u, gu)))
            step[:-1] += s.l2 * weights[:-1]
            step[-1] = ga.sum() + gu.sum()
            step *= free
            squares += step * step
            weights -= s.rate * step / np.sqrt(squares)
    return weights[:-1], float(weights[-1])


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from ``docs`` (doc_id, text) of which ``labels`` (doc_id, toxic) confirms some as toxic.

    Pass only rows that may be learned from. The prior is the share of toxic among the
    labelled rows. A doc_id in several label rows counts as toxic where one says so. Rows
    without doc_id are not learned from, and of those that share one, one is.
    """
    docs = docs.select("doc_id", "text").where((F.col("doc_id").isNotNull()) & (F.coalesce(F.octet_length("text"), F.lit(0)) <= s.longest))
    said = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = said.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return Model(np.zeros(1 << s.hashing.bits), -4.0, 0.0, s.hashing)
    prior = min(max(n_toxic / n, 1e-4), 0.9)
    pick = lambda df, k: df.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(k)
    chosen = pick(said.where("toxic = 1"), s.positives).withColumn("kind", F.lit(1))
    chosen = chosen.unionByName(pick(docs, s.unlabelled).distinct().withColumn("kind", F.lit(0)))
    # at most positives + unlabelled ids, so the broadcast is bounded; of rows that share a doc_id one is taken
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "kind").agg(F.min("text").alias("text"))
    got, rows = ft.gather(texts, s.hashing, ("doc_id", "kind"))
    toxic, free = (ft.take(rows, np.flatnonzero(got["kind"] == k)) for k in (1, 0))
    if len(toxic[0]) < 2 or len(free[0]) < 2:
        return Model(np.zeros(1 << s.hashing.bits), float(np.log(prior / (1 - prior))), prior, s.hashing)
    weights, bias = nn_pu(toxic, free, prior, s)
    return Model(weights, bias, prior, s.hashing)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without ``text``, with ``score``: how likely each whole text is toxic."""
    return ft.score(docs, model.hashing, model.weights, model.bias)
