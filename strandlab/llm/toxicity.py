"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of a fixed insult list and of a lexicon learned from the training labels (words and word beginnings
that occur almost only in toxic documents), second person near such words, capitals, punctuation, symbols and
obfuscated spellings.  The trees are fitted on histograms, the calibration by pooling adjacent violators.

No label is used twice: the sample is cut by a hash into two folds and a part for calibration.  The trees see each fold's
texts through a lexicon learned from the other fold; the calibration part and all documents are seen through a lexicon
learned from both folds.

The fit sees at most PER_CLASS labelled documents of each class; lexicons are counted in Spark over that sample and hold
at most LEXICON entries.  Scoring reads every document where it lies, without a shuffle.  A null text is empty; repeated
rows each get a row; unusable labels are ignored; with labels of one class every score is its share.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm.common import table, text_of
from strandlab.llm.ngrams import PER_CLASS, class_weights, held_out, labelled_sample, sample_features, sampled_texts, score_texts

#: Common English insults that are no words of the corpus's other languages, and pronouns of the second person in the corpus's languages.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic scum trash garbage worthless disgusting clown fool imbecile dimwit vermin filth creep jerk retard bastard bitch asshole fuck fucking shit damn hate kill".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters that stand for letters in obfuscated spellings.
LEET = str.maketrans("013457@$!", "oieastasi")

LEXICON = 3000
PREFIXES = (4, 5, 6)
LEAST_DOCS = 6
NEAR = 6
#: Of APART parts of the sample, FOLD belong to each fold and the others to the calibration.
APART, FOLD = 10, 4
_TOKEN = re.compile(r"[^\W_]+(?:[@$!*.'’_-]+[^\W_]+)*|[!?]+")
_UPPER = bytes([*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])
_ODD = re.compile(r"[^\W\d_](?:[@$!*0-9._-])+[^\W\d_]")


def learn_lexicon(texts: DataFrame, least: int = LEAST_DOCS) -> dict[str, float]:
    """word, or beginning + "*" -> log odds, of at most LEXICON tokens that mark toxic texts (y, text) of the sample."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))

    def starts(n: int) -> Column:
        return F.transform(F.filter("words", lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    rows = texts.select("y", words.alias("words"))
    tokens = rows.select("y", F.explode(F.array_distinct(F.concat("words", *map(starts, PREFIXES)))).alias("token"))
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    n1, n0 = total.get(1, 0) + 1, total.get(0, 0) + 1
    odds = F.log((F.col("t") + 0.5) / n1) - F.log((F.col("c") + 0.5) / n0)
    counted = tokens.groupBy("token").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).where(F.col("t") >= least).withColumn("odds", odds).where("odds > 2.5")
    best = counted.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "token").limit(LEXICON)
    return {r["token"]: round(float(r["odds"]), 6) for r in best.collect()}


class _Marks(dict):
    """token -> 0, -1 for a run of ! or ?, or the number of what is known of the token."""

    def __init__(self, weigh):
        super().__init__()
        self.weigh, self.known = weigh, [(0.0, 0, 0, 0)]

    def __missing__(self, token: str) -> int:
        if token[0] in "!?":
            number = -1
        else:
            v = self.weigh(token)
            number = len(self.known) if any(v) else 0
            if number:
                self.known.append(v)
        self[token] = number
        return number


class Features:
    """text -> dense features."""

    def __init__(self, lexicon: dict[str, float]):
        self.words = {k: v for k, v in lexicon.items() if not k.endswith("*")}
        self.starts = {k[:-1]: v for k, v in lexicon.items() if k.endswith("*")}
        self.marks = _Marks(self._weigh)

    def __reduce__(self):
        return Features, ({**self.words, **{k + "*": v for k, v in self.starts.items()}},)

    def _weigh(self, token: str) -> tuple[float, int, int, int]:
        """log odds, insult, second person, obfuscated."""
        plain = re.sub(r"[^a-z]", "", token.translate(LEET)) if not token.isalpha() else token
        weight = max([0.0, self.words.get(token, 0.0), self.words.get(plain, 0.0), *(self.starts.get(plain[:n], 0.0) for n in PREFIXES if len(plain) >= n)])
        return weight, int(token in INSULTS or plain in INSULTS), int(token in SECOND_PERSON), int(bool(_ODD.search(token)))

    def __call__(self, text: str) -> np.ndarray:
        tokens = _TOKEN.findall(text.lower())
        if len(self.marks) > 300_000:  # emptied between texts only: numbers stay valid within one
            self.marks.clear()
            del self.marks.known[1:]
        code = np.fromiter(map(self.marks.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        marked = np.flatnonzero(code > 0).tolist()
        hits = insult = odd = people = near = 0
        weight = heaviest = 0.0
        distinct = set()
        person_at = hit_at = -NEAR - 1
        known = self.marks.known
        for i in marked:
            v = known[code[i]]
            odd += v[3]
            insult += v[1]
            if v[0] or v[1]:
                hits += 1
                weight += v[0]
                heaviest = max(heaviest, v[0])
                distinct.add(tokens[i])
                near += i - person_at <= NEAR
                hit_at = i
            if v[2]:
                people += 1
                near += i - hit_at <= NEAR
                person_at = i
        n, chars, latin = max(1, len(tokens)), max(1, len(text)), text.encode("latin-1", "replace")
        count = lambda kinds: len(latin) - len(latin.translate(None, kinds))
        shout = int((code == -1).sum())
        return np.array([hits, hits / n, weight, weight / n, heaviest, len(distinct), insult, insult / n, near, near / n, people / n, count(_UPPER) / chars, shout / n, count(b".,;:!") / chars, count(b"#*$%&|<>@") / chars, odd / n, math.log1p(n)], dtype=np.float64)


class Boosted:
    """Trees of fixed depth on quantile bins, logistic loss, Newton leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        share = float(np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6))
        self.start, self.depth, self.trees = math.log(share / (1 - share)), depth, []
        f = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p)
            node, cut = np.zeros(len(y), dtype=np.int64), []
            for level in range(depth):
                k = 1 << level
                column, edge = np.zeros(k, dtype=np.int64), np.full(k, 1 << 30)
                best = np.full(k, 1e-9)
                for j in range(x.shape[1]):
                    m = len(self.edges[j]) + 1
                    at = node * m + b[:, j]
                    gl, hl = (np.bincount(at, weights=v, minlength=k * m).reshape(k, m).cumsum(axis=1) for v in (g, h))
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(k), top]
                    better = value > best
                    best[better], column[better], edge[better] = value[better], j, top[better]
                cut.append((column, edge))
                node = 2 * node + (b[np.arange(len(y)), column[node]] > edge[node])
            total = [np.bincount(node, weights=v, minlength=1 << depth) for v in (g, h)]
            leaf = rate * total[0] / (total[1] + 1)
            self.trees.append((cut, leaf))
            f += leaf[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        f, rows = np.full(len(x), self.start), np.arange(len(x))
        for cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for column, edge in cut:
                node = 2 * node + (b[rows, column[node]] > edge[node])
            f += leaf[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the weighted monotone fit; each block also counts a fifth of a row, half of it of
    class 1, so that no probability is exactly 0 or 1.  Equal scores are one point before anything is pooled."""
    kinds, at = np.unique(score, return_inverse=True)
    mass, hit = np.bincount(at, weights=weight), np.bincount(at, weights=weight * y)
    blocks: list[list[float]] = []  # weight, weighted y, lowest and highest score
    for s, m, t in zip(kinds.tolist(), mass.tolist(), hit.tolist(), strict=True):
        blocks.append([m, t, s, s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = b[0] + last[0], b[1] + last[1], last[3]
    p = [(b[1] + 0.1) / (b[0] + 0.2) for b in blocks]
    knots = [x for b in blocks for x in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    value = [q for b, q in zip(blocks, p, strict=True) for _ in ((0, 1) if b[3] > b[2] else (0,))]
    return np.array(knots), np.maximum.accumulate(np.array(value))


def fit_toxicity(features: Features, x: np.ndarray, y: np.ndarray, apart: np.ndarray, counts: dict[int, int]):
    """score(texts) -> probabilities of class 1; apart: the rows for the calibration."""
    if len(set(y.tolist())) < 2:
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        return lambda texts: [share] * len(texts)
    weight = class_weights(y, counts)
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.zeros(len(y), dtype=bool)
    train = ~apart
    trees = Boosted(x[train], y[train], weight[train])
    use = apart if apart.any() else train
    at, p = isotonic(trees.margin(x[use]), y[use], weight[use])

    def score(texts: list[str]) -> np.ndarray:
        return np.interp(trees.margin(np.stack([features(t) for t in texts])), at, p) if texts else np.zeros(0)

    return score


def toxic_scores(docs: DataFrame, labels: DataFrame, label: str, train_on, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, score (probability of label 1) of every document."""
    sample, counts = labelled_sample(labels, label, train_on, per_class)
    texts = sampled_texts(docs, sample).withColumn("part", F.pmod("h", F.lit(APART)))
    fold = {0: F.col("part") < FOLD, 1: F.col("part").between(FOLD, 2 * FOLD - 1)}
    rest = F.col("part") >= 2 * FOLD
    final = Features(learn_lexicon(texts.where(~rest)))
    found = [(0, *sample_features(texts.where(fold[k]), Features(learn_lexicon(texts.where(fold[1 - k]), LEAST_DOCS // 2)), np.float64)) for k in fold]
    found.append((1, *sample_features(texts.where(rest), final, np.float64)))
    x = [v for _, rows, _, _ in found for v in rows]
    y, h = (np.concatenate([f[i] for f in found]) for i in (2, 3))
    apart = np.concatenate([np.full(len(f[2]), bool(f[0])) for f in found])
    order = np.lexsort((h, apart))
    width = len(final(""))
    return score_texts(docs, fit_toxicity(final, np.array(x, dtype=np.float64).reshape(-1, width)[order], y[order], apart[order], counts))


def toxicity(spark, sf_dir: str) -> DataFrame:
    """op5: toxicity of every document; rows of fold 0 of 5 are held out from the fit."""
    scored = toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", ~held_out(5, 0))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
