"""Quality classifier: naive Bayes support vectors.

Each hashed n-gram indicator is scaled by its class log-count ratio; a linear hinge-loss model on the scaled indicators
is fitted by dual coordinate descent and made a probability on the part of the sample kept apart for that.

The fit sees at most PER_CLASS labelled documents of each class (parameter per_class), each whole, as at most 32 kB of
features; scoring reads every document where it lies, without a shuffle.  A null text is empty; empty texts get the score
of the bias features alone; repeated rows each get a row; labels other than 0 and 1, null labels and labels without a
document are ignored; with labels of fewer than two classes every score is the share of class 1 (0.5 without labels); where
the part for the calibration or the other one would have one class, the calibration sees the training rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm.common import table
from strandlab.llm.ngrams import DIM, PER_CLASS, Indicators, class_weights, held_out, indicators, labelled_sample, platt, sample_indicators, sampled_texts, score_texts, split_apart


#: Gap between primal and dual objective at which the fit's descent ends, as a share of the primal one.
GAP = 1e-2


def log_count_ratios(x, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """ln of the smoothed share of class 1's documents with a feature over that of class 0's."""
    n = [np.full(DIM, alpha), np.full(DIM, alpha)]
    for v, k in zip(x, y, strict=True):
        n[k][v] += 1
    total = [max(1, int(np.sum(y == k))) + 2 * alpha for k in (0, 1)]
    return np.log(n[1] / total[1]) - np.log(n[0] / total[0])


def dual_coordinate_descent(x, value: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 400, seed: int = 7, gap: float = 1e-6) -> np.ndarray:
    """Weights w of min |w|^2 / 2 + sum cost_i * max(0, 1 - s_i w.x_i) with s = +-1; x_i has value[j] / sqrt(n_i) at its
    features j.  Each step solves the dual in one row's multiplier, which stays between 0 and the row's cost; it ends when
    the duality gap is small, or after so many epochs."""
    sign, dual, square = np.where(y == 1, 1.0, -1.0), np.zeros(len(y)), value * value
    q = np.zeros(DIM)  # w times value: all that margins need
    scale = np.array([1 / math.sqrt(max(1, len(v))) for v in x])
    norm = np.array([max(float(square[v].sum()) * s * s, 1e-12) for v, s in zip(x, scale, strict=True)])
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for i in rng.permutation(len(y)):
            v = x[i]
            gradient = sign[i] * float(q[v].sum()) * scale[i] - 1
            new = min(max(0.0, dual[i] - gradient / norm[i]), cost[i])
            if new != dual[i]:
                q[v] += (new - dual[i]) * sign[i] * scale[i] * square[v]
                dual[i] = new
        if epoch % 5 == 4:
            half = 0.5 * float(np.sum(np.divide(q * q, square, out=np.zeros(DIM), where=square > 0)))
            loss = sum(c * max(0.0, 1 - s * float(q[v].sum()) * k) for v, s, c, k in zip(x, sign, cost, scale, strict=True))
            if 2 * half + loss - float(dual.sum()) <= gap * (half + loss):
                break
    return np.divide(q, value, out=np.zeros(DIM), where=value != 0)


def fit_nbsvm(x, y: np.ndarray, counts: dict[int, int]):
    """score(text) -> probability of class 1."""
    if len(set(y.tolist())) < 2:
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        return lambda text: share
    weight = class_weights(y, counts)
    apart = split_apart(y)
    train = ~apart
    pick = lambda keep: x[np.flatnonzero(keep)] if isinstance(x, Indicators) else [v for v, k in zip(x, keep, strict=True) if k]
    ratio = log_count_ratios(pick(train), y[train])
    n = {k: max(1, int(np.sum(y[train] == k))) for k in (0, 1)}
    cost = np.where(y[train] == 1, 0.5 * train.sum() / n[1], 0.5 * train.sum() / n[0])
    w = dual_coordinate_descent(pick(train), ratio, y[train], cost, gap=GAP)
    final = (w * ratio).astype(np.float32)
    use = apart if apart.any() else train
    margin = np.array([final[v].sum() / math.sqrt(max(1, len(v))) for v in pick(use)], dtype=np.float64)
    a, b = platt(margin, y[use], weight[use])

    def score(text: str) -> float:
        v = indicators(text)
        z = a * float(final[v].sum()) / math.sqrt(max(1, len(v))) + b
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    return score


def classify(docs: DataFrame, labels: DataFrame, label: str, train_on: Column, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, score (probability of label 1) of every document; train_on: which labelled rows a fit may see."""
    sample, counts = labelled_sample(labels, label, train_on, per_class)
    x, y = sample_indicators(sampled_texts(docs, sample))
    score = fit_nbsvm(x, y, counts)
    return score_texts(docs, lambda texts: list(map(score, texts)))


def quality(spark, sf_dir: str) -> DataFrame:
    """op4: quality of every document; rows of fold 1 of 3 are held out from the fit."""
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", ~held_out(3, 1))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
