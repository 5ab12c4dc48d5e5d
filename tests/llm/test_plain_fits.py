"""Fitted models against plain versions, at the settings in use."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from strandlab.llm import ngrams as G
from strandlab.llm import quality as Q
from strandlab.llm import rules as R

SF = "/root/testdata/sf0.01"


def sample(n=60, seed=1):
    """Rows of features that overlap between the classes, as the fits see them."""
    r = np.random.default_rng(seed)
    y = np.array([int(r.random() < 0.4) for _ in range(n)])
    x = [np.unique(np.concatenate([[0], r.choice(40, 8), 20 * k + r.choice(25, 6)])).astype(np.uint32) for k in y]
    return x, y


def test_packed_features_come_back():
    r = np.random.default_rng(3)
    for n in (1, 5, 8191, 8192, 100_000):
        v = np.sort(r.choice(G.DIM, n, replace=False)).astype(np.uint32)
        raw = G.packed(v)
        assert len(raw) <= G.DIM // 8 and np.array_equal(G.unpacked(raw), v)


def test_all_labelled_rows_are_used(spark):
    """No row of the sample is left out, however long the texts."""
    from pyspark.sql import functions as F

    long_ = " ".join(f"w{i * i % 99991}x{i}" for i in range(60_000))
    docs = spark.createDataFrame([(i, long_ + str(i)) for i in range(12)] + [(100 + i, f"short {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(12), *range(100, 130)]], "doc_id long, quality int")
    picked, _ = G.labelled_sample(labels, "quality", F.lit(True), 4000)
    x, y = G.sample_indicators(G.sampled_texts(docs, picked))
    assert len(x) == len(y) == 42 and sorted(len(v) for v in x)[-12] > 8192


def test_descent_ends_near_the_optimum_of_real_rows(spark):
    """Duality gap at the settings in use."""
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    picked, _ = G.labelled_sample(labels, "quality", F.lit(True))
    x, y = G.sample_indicators(G.sampled_texts(docs, picked))
    ratio = Q.log_count_ratios(x, y)
    cost = np.full(len(y), 0.5)
    w = Q.dual_coordinate_descent(x, ratio, y, cost, gap=Q.GAP)
    best = Q.dual_coordinate_descent(x, ratio, y, cost, epochs=3000, gap=1e-5)
    s = np.where(y == 1, 1.0, -1.0)

    def loss(w):
        return w @ w / 2 + sum(c * max(0.0, 1 - k * float(w[v] @ ratio[v]) / math.sqrt(len(v))) for v, k, c in zip(x, s, cost, strict=True))

    assert loss(best) <= loss(w) <= loss(best) * (1 + 1.1 * Q.GAP)


def plain_sigmoid(margin, y, weight):
    """Platt's fit by many small steps on the same objective."""
    scale = float(np.std(margin)) or 1.0
    m, t = margin / scale, np.where(y == 1, 0.995, 0.005)
    a, b = 1.0, 0.0
    for _ in range(200_000):
        p = 1 / (1 + np.exp(-(a * m + b)))
        ga, gb = np.sum(weight * (p - t) * m) + 1e-3 * a, np.sum(weight * (p - t)) + 1e-3 * b
        a, b = a - 0.02 * ga, b - 0.02 * gb
        if abs(ga) + abs(gb) < 1e-6:
            break
    return a / scale, b


def plain_scores(w, x, y, use, weight, texts):
    margin = lambda v: sum(w.get(int(j), 0.0) for j in v) / math.sqrt(max(1, len(v)))
    a, b = plain_sigmoid(np.array([margin(x[i]) for i in use]), y[use], weight[use])
    return [1 / (1 + math.exp(-(a * margin(G.indicators(t)) + b))) for t in texts]


TEXTS = ["", "one two", "Some words, again some words!", "zz top 12"]


def test_quality_fit_equals_a_plain_one(monkeypatch):
    """Ratios, hinge loss and calibration with dictionaries and loops, on features of short texts."""
    monkeypatch.setattr(Q, "GAP", 1e-7)
    descent = Q.dual_coordinate_descent
    monkeypatch.setattr(Q, "dual_coordinate_descent", lambda *a, gap: descent(*a, epochs=4000, gap=gap))
    r = random.Random(4)
    words = "one two some words again zz top 12 and more".split()
    texts = [" ".join(r.choices(words[: 7 if k % 2 else 10], k=6)) + "!" * (k % 2) for k in range(40)]
    y = np.array([k % 2 if k % 7 else 1 - k % 2 for k in range(40)])
    x, counts = [G.indicators(t) for t in texts], {0: 30, 1: 50}
    got = Q.fit_nbsvm(x, y, counts)
    apart = [i for i in range(40) if i % 5 == 4]
    train = [i for i in range(40) if i % 5 != 4]
    n1, n0 = sum(y[i] for i in train), sum(1 - y[i] for i in train)
    c1, c0 = Counter(int(j) for i in train if y[i] for j in x[i]), Counter(int(j) for i in train if not y[i] for j in x[i])
    ratio = {j: math.log((1 + c1[j]) / (n1 + 2)) - math.log((1 + c0[j]) / (n0 + 2)) for j in c1 | c0}
    rest = math.log(1 / (n1 + 2)) - math.log(1 / (n0 + 2))
    rows = {i: {int(j): ratio[int(j)] / math.sqrt(len(x[i])) for j in x[i]} for i in train}
    dot = lambda p, q: sum(v * q[j] for j, v in p.items() if j in q)
    sign, most = {i: 1 if y[i] else -1 for i in train}, {i: 0.5 * len(train) / (n1 if y[i] else n0) for i in train}
    gram = {(i, k): dot(rows[i], rows[k]) for i in train for k in train}
    dual = dict.fromkeys(train, 0.0)
    for _ in range(3000):
        for i in train:
            gradient = sign[i] * sum(dual[k] * sign[k] * gram[i, k] for k in train) - 1
            dual[i] = min(max(0.0, dual[i] - gradient / gram[i, i]), most[i])
    w = {}
    for i in train:
        for j, v in rows[i].items():
            w[j] = w.get(j, 0.0) + dual[i] * sign[i] * v
    final = {j: v * ratio.get(j, rest) for j, v in w.items()}
    want = plain_scores(final, x, y, np.array(apart), G.class_weights(y, counts), TEXTS)
    assert [got(t) for t in TEXTS] == pytest.approx(want, abs=2e-3)


def test_rules_fit_equals_a_plain_one():
    """The logistic regression with a dictionary of weights, in the same order of rows, and its calibration."""
    x, y = sample()
    counts = {0: 40, 1: 20}
    got = R.fit_logistic(x, y, counts)
    train, apart = [i for i in range(60) if i % 5 != 4], [i for i in range(60) if i % 5 == 4]
    n = Counter(int(y[i]) for i in train)
    w, square = {}, {}
    rng = np.random.default_rng(11)
    for _ in range(8):
        for i in rng.permutation(np.array(train)):
            scale = 1 / math.sqrt(len(x[i]))
            p = 1 / (1 + math.exp(-sum(w.get(int(j), 0.0) for j in x[i]) * scale))
            for j in map(int, x[i]):
                g = (p - y[i]) * 0.5 * len(train) / n[int(y[i])] * scale + 1e-5 * w.get(j, 0.0)
                square[j] = square.get(j, 1e-6) + g * g
                w[j] = w.get(j, 0.0) - 0.1 * g / math.sqrt(square[j])
    want = plain_scores(w, x, y, np.array(apart), G.class_weights(y, counts), TEXTS)
    assert [got(t) for t in TEXTS] == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("lonely", [4, 3])
def test_one_class_in_a_part(lonely):
    """The only row of class 1 falls into the part for the calibration, or into the training part."""
    x = [G.indicators("good words here" if i == lonely else f"bad stuff {i}") for i in range(10)]
    y = np.array([int(i == lonely) for i in range(10)])
    assert not G.split_apart(y).any()
    counts = {0: 9, 1: 1}
    for fit in (Q.fit_nbsvm, R.fit_logistic):
        score = fit(x, y, counts)
        assert score("good words here") > 5 * score("bad stuff 3")


def test_lexicon_equals_a_plain_count(spark):
    from strandlab.llm import toxicity as T

    r = random.Random(8)
    texts = [(i % 2, " ".join(r.choices("grumf zork zorkling zorked nice day people sun rain".split()[: 9 if i % 2 else 9][4 * (1 - i % 2) :], k=8)) + ".Ünder") for i in range(60)]
    got = T.learn_lexicon(spark.createDataFrame(texts, "y int, text string"), 4)
    count = {0: Counter(), 1: Counter()}
    for y, t in texts:
        words = {w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split() if len(w) >= 3}
        count[y].update(words | {w[:n] + "*" for w in words for n in T.PREFIXES if len(w) >= n})
    n1, n0 = 31, 31
    want = {k: math.log((t + 0.5) / n1) - math.log((count[0][k] + 0.5) / n0) for k, t in count[1].items() if t >= 4}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 2.5}, abs=1e-6)


def test_insults_are_no_words_of_other_languages():
    from strandlab.llm import toxicity as T

    d = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    f = T.Features({})
    for lang, rows in d[d.toxic == 0].groupby("lang"):
        assert np.mean([f(t)[6] for t in rows.text[:300]]) < 0.05, lang
