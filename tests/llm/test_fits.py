"""Classifiers, license votes and token rollups against plain versions."""

import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from test_brute_force import SF, auc, docs

from strandlab.llm.queries import QUERIES


def test_isotonic_equals_the_minimax_fit():
    """Weighted isotonic regression by its min-max formula, with the pseudo rows that each block counts."""
    from strandlab.llm.toxicity import isotonic

    r = np.random.default_rng(2)
    for _ in range(40):
        n = int(r.integers(1, 14))
        score, y, w = r.integers(0, 6, n).astype(float), r.integers(0, 2, n), r.uniform(0.2, 3, n)
        at, p = isotonic(score, y, w)
        s = np.unique(score)
        mass = np.array([w[score == v].sum() for v in s])
        hit = np.array([(w * y)[score == v].sum() for v in s])
        mean = lambda a, b: hit[a : b + 1].sum() / mass[a : b + 1].sum()
        fit = np.array([max(min(mean(a, b) for b in range(i, len(s))) for a in range(i + 1)) for i in range(len(s))])
        block = [np.flatnonzero(np.isclose(fit, v)) for v in fit]
        want = np.array([(hit[b].sum() + 0.1) / (mass[b].sum() + 0.2) for b in block])
        assert np.interp(s, at, p) == pytest.approx(np.maximum.accumulate(want))


def test_boosting_takes_the_best_cut():
    from strandlab.llm.toxicity import Boosted

    r = np.random.default_rng(3)
    x = r.normal(size=(80, 3))
    y = (x[:, 1] + 0.3 * r.normal(size=80) > 0.2).astype(int)
    w = r.uniform(0.5, 2, 80)
    m = Boosted(x, y, w, rounds=1, depth=1, rate=1.0, bins=200)
    share = np.average(y, weights=w)
    g, h = w * (y - share), w * share * (1 - share)
    gain = {}
    for j in range(3):
        for c in m.edges[j]:
            left = x[:, j] <= c
            if h[left].sum() >= 0.5 and h[~left].sum() >= 0.5:
                gain[j, c] = sum(g[k].sum() ** 2 / (h[k].sum() + 1) for k in (left, ~left))
    j, c = max(gain, key=gain.get)
    left = x[:, j] <= c
    want = np.log(share / (1 - share)) + np.where(left, g[left].sum() / (h[left].sum() + 1), g[~left].sum() / (h[~left].sum() + 1))
    assert m.margin(x) == pytest.approx(want)
    deep = Boosted(x, y, w)
    loss = lambda f: -np.sum(w * np.where(y == 1, -np.log1p(np.exp(-f)), -np.log1p(np.exp(f))))
    assert loss(deep.margin(x)) < loss(m.margin(x)) and auc(deep.margin(x), y) > 0.97


def test_toxic_features():
    from strandlab.llm.toxicity import Features

    f = Features({"grumf": 3.0, "zork*": 4.0})
    v = f("You are a GRUMF, z0rkling!! Nice day, idiot.")
    hits, share, weight, _, heaviest, distinct, insult, _, near = v[:9]
    assert (hits, weight, heaviest, distinct, insult) == (3, 7.0, 4.0, 3, 1) and near >= 1
    assert share == pytest.approx(3 / 9) and v[11] == pytest.approx(7 / 44)
    assert f("")[0] == 0 and len(f("")) == len(v)


def test_labels_of_toxicity_are_used_once(spark, monkeypatch):
    """Lexicon, trees and calibration see different rows."""
    from strandlab.llm import toxicity as T

    seen, calls = [], []
    learn, fit = T.learn_lexicon, T.fit_toxicity
    monkeypatch.setattr(T, "learn_lexicon", lambda texts, *a: seen.append({r["h"] for r in texts.collect()}) or learn(texts, *a))
    monkeypatch.setattr(T, "fit_toxicity", lambda f, x, y, apart, c: calls.append((len(y), int(apart.sum()))) or fit(f, x, y, apart, c))
    QUERIES["op5_toxicity"](spark, SF)
    both, second, first = seen  # of both folds, then of the fold that a fold's features must not come from
    n, apart = calls[0]
    assert not (first & second) and first | second == both and len(both) == n - apart and apart > 0


@pytest.mark.parametrize("name", ["op4_quality_classifier", "op5_toxicity"])
def test_probabilities_are_calibrated(spark, name):
    label = "quality" if name.startswith("op4") else "toxic"
    got = QUERIES[name](spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    got = got[got.held_out]
    assert got.score.between(0, 1).all() and abs(got.score.mean() - got[label].mean()) < 0.08
    assert ((got.score - got[label]) ** 2).mean() < 0.08


def test_quality_verdict(spark):
    """Out of sample: the model of half of the labels on the other half."""
    from pyspark.sql import functions as F

    from strandlab.llm.rules import apply_rules, train_rules

    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    p = train_rules(d, labels.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0))
    got = apply_rules(d.select("doc_id", "text"), p).selectExpr("row.doc_id AS doc_id", "base_failed", "probability", "kept").toPandas()
    assert (got.kept == (~got.base_failed & (got.probability >= 0.5))).all()
    held = got.merge(labels.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 1).toPandas(), on="doc_id")
    assert auc(held.probability, held.quality) > 0.95 and abs(held.probability.mean() - held.quality.mean()) < 0.1
    assert held[(held.quality == 1) & ~held.base_failed].kept.mean() > 0.9


def test_ratios_and_weights():
    from strandlab.llm.quality import log_count_ratios

    x = [np.array([0, 1], dtype=np.uint32), np.array([1], dtype=np.uint32), np.array([1, 2], dtype=np.uint32)]
    r = log_count_ratios(x, np.array([1, 1, 0]))
    assert r[:4] == pytest.approx(np.log([(2 / 4) / (1 / 3), (3 / 4) / (2 / 3), (1 / 4) / (2 / 3), (1 / 4) / (1 / 3)]))


def test_sample_is_bounded(spark):
    from strandlab.llm.ngrams import indicators, labelled_sample, sample_features, sampled_texts
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i % 50, f"word{i} text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    sample, _ = labelled_sample(labels, "quality", F.lit(True), 20)
    texts = sampled_texts(d, sample)
    assert texts.count() == 40  # one row a doc_id
    x, y, h = sample_features(texts, indicators, np.uint32)
    few, _, h2 = sample_features(texts, indicators, np.uint32, most=sum(v.nbytes for v in x[:7]))
    assert len(x) == 40 and len(few) == 7 and h2.tolist() == sorted(h.tolist())[:7]


def license_votes(text: str):
    """Labels and best coverage, by a plain count of votes."""
    from strandlab.llm.licenses import COVERAGE, GAP, GRAM, TEMPLATES

    cut = lambda x: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x)) if w]
    w, labels, best = cut(text), set(), 0.0
    for label, notice in TEMPLATES:
        t = cut(notice)
        votes = defaultdict(list)
        for j in range(len(t) - GRAM + 1):
            for i in range(len(w) - GRAM + 1):
                if w[i : i + GRAM] == t[j : j + GRAM]:
                    votes[i - j].append((i, j))
        total, runs = len(t) - GRAM + 1, []
        for diagonal in sorted(votes):
            if runs and diagonal - runs[-1][0] <= GAP:
                runs[-1] = (diagonal, runs[-1][1] + votes[diagonal])
            else:
                runs.append((diagonal, votes[diagonal]))
        for _, v in runs:
            first, last = min(i for i, _ in v), max(i for i, _ in v)
            cover = len({j for _, j in v}) / total if last - first + 1 <= total * 1.5 + GAP else 0.0
            best = max(best, cover)
            if cover >= COVERAGE:
                labels.add(label)
    return labels, best


def test_license_votes(spark):
    from strandlab.llm.licenses import TEMPLATES, scan_licenses

    r = random.Random(6)
    text = docs("/root/testdata/sf0.001").text.tolist()[:60]
    for _ in range(120):
        w = r.choice(TEMPLATES)[1].split()
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], ["other"], [w[k], "more"]])
            w = w or ["x"]
        text.append(" ".join([*("some words before".split() * r.randrange(3)), *w, *("and after".split() * r.randrange(3)), *(r.choice(TEMPLATES)[1].split() if r.random() < 0.3 else [])]))
    text += ["İSTANBUL MIT LİCENSE", "MİT license MIT License", "\u212a" * 5, "This wor\u212a is licensed under the GNU General Public License, version 3", "ÄÖ MIT LICENSE Ñ"]
    got = scan_licenses(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).collect()
    for x in got:
        labels, best = license_votes(text[x["doc_id"]])
        base = set(filter(None, x["base_labels"].split(",")))
        assert set(filter(None, x["labels"].split(","))) == base | labels
        assert x["score"] == pytest.approx(1.0 if x["n_base"] else best)


def test_commits_of_two_writers(spark, tmp_path):
    from strandlab.llm import tokencounts as T

    path = f"file://{tmp_path}/r"
    rows = lambda *x: spark.createDataFrame(x, "source string, lang string, tokenizer string, tokens long, sign int")
    one, two = T.Rollup(spark, path), T.Rollup(spark, path)
    batch = rows(("s", "en", "v", 5, 1))
    two.has = lambda name: False  # looked before the other wrote
    assert one.commit("a/b c", batch) and not two.commit("a/b c", batch) and one.has("a/b c") and not one.has("a")
    assert [r["n_tokens"] for r in one.totals().collect()] == [5]
    one.compact()
    one.commit("second", rows(("s", "en", "v", 2, 1), ("s", "en", "v", 2, -1)))
    one.compact()
    assert not one.commit("a/b c", batch) and not one.commit("second", batch) and [r["n_tokens"] for r in one.totals().collect()] == [5]
    assert len(list((tmp_path / "r").glob("snapshot=*"))) == 3 or len([p for p in (tmp_path / "r").iterdir() if p.name.startswith("snapshot=")]) == 2
