"""Infinite (HDP) hidden Markov models by beam sampling, one or a bag of them.

An iteration counts transitions and emissions in Spark, resamples the models on the driver (at most MOST states each, so
at most MOST squared numbers), ships them to the tasks and resamples every sequence's labels there.  Randomness is a
function of (seed, iteration, model, sequence), so results don't depend on the partitioning.  Labels are written to the
shared folder after each iteration; labels, weights, base weights and concentrations of an iteration are all that a later
run needs to go on (sources.models.checkpoint).

Competitive training: after every INNER iterations each sequence is scored under all finite models; its weight in a
model's counts is 1 + models x the model's share of its (tempered) posterior.

The working table is long: model, seq_id, codes, labels, weight.  States: 0 start, 1 end, 2 .. labelled; the last entry of
every row is the mass of states that don't exist yet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions.sequences import uniform
from strandlab.operators import information as I
from strandlab.operators.markov import Model, forward, from_counts, posterior_path
from strandlab.session import for_python, written

#: Limits, priors of the concentrations (shape, scale) and of emissions.
MOST = 1000
ALPHA_PRIOR, GAMMA_PRIOR = (6.0, 1 / 15), (16.0, 1 / 4)
EMISSION_PRIOR = 0.3
HYPER_STEPS = 20
#: Terms of a table count that are drawn one by one; the sum of the further ones, of small probabilities, is a Poisson draw.
EXACT_TERMS = 10_000
#: Numbers of a batch of sequences that are resampled at once, letters times states.
HELD = 4_000_000
#: Iterations between two updates of the sequences' weights.
INNER = 10
START, END = 0, 1


@dataclass
class State:
    """What the sampler knows between iterations, but for the labels."""

    beta: np.ndarray
    alpha: float
    gamma: float
    iteration: int = 0


def initial_labels(seqs: DataFrame, states: int, seed: int) -> DataFrame:
    """seq_id, codes, labels: labels drawn uniformly from 2 .. states - 1 by a hash of seed, sequence and position."""
    draw = F.transform("codes", lambda c, i: (2 + F.floor(uniform(seed, F.col("seq_id"), i) * (states - 2))).cast("int"))
    return seqs.select("seq_id", "codes", draw.alias("labels"))


def emission_labels(seqs: DataFrame, states: int, letters: int, alpha: float, seed: int) -> DataFrame:
    """The same, with each label drawn by how well a random state emits the letter: Dirichlet(alpha) emissions."""
    e = np.random.default_rng(seed).dirichlet(np.full(letters, alpha), states - 2)
    share = np.cumsum(e / e.sum(axis=0, keepdims=True), axis=0).T  # letters x states, cumulated
    table = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in share))
    draw = F.transform("codes", lambda c, i: (2 + F.least(F.size(F.filter(F.get(table, c), lambda v: v <= uniform(seed, F.col("seq_id"), i))), F.lit(states - 3))).cast("int"))
    return seqs.select("seq_id", "codes", draw.alias("labels"))


def model_labels(seqs: DataFrame, states: int, letters: int, alpha: float, seed: int) -> DataFrame:
    """The same, by the decoded path of a random model with Dirichlet(alpha) transitions and emissions."""
    for_python(seqs.sparkSession)
    rng = np.random.default_rng(seed)
    k = states - 2
    model = Model(rng.dirichlet(np.full(k, alpha), k), rng.dirichlet(np.full(letters, alpha), k), np.full(letters, 1 / letters))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c in pdf["codes"]:
                x = np.asarray(c, dtype=np.int64)
                best = model.emission[:, x].argmax(axis=0) if len(x) else x
                path = posterior_path(model, x) if len(x) else x
                out.append((2 + np.where(path >= 5, path - 5, best)).tolist())  # flanks: the likeliest state
            yield pd.DataFrame({"seq_id": pdf["seq_id"], "codes": pdf["codes"], "labels": out})

    return seqs.mapInPandas(run, "seq_id long, codes array<int>, labels array<int>")


def guess_model(states: int, letters: int, alpha: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions and emissions of a guess: Dirichlet rows of mass alpha a state, and of alpha + 1 to alpha + 11 a letter,
    so that later states prefer their letters less."""
    rng, k = np.random.default_rng(seed), states - 2
    emission = np.array([rng.dirichlet(np.full(letters, alpha + 1 + 10 * i / k)) for i in range(k)])
    return rng.dirichlet(np.full(k, alpha), k), emission


def guessed_labels(seqs: DataFrame, states: int, letters: int, alpha: float, seed: int) -> DataFrame:
    """The same, drawn letter by letter from a guessed model: the first by how well states emit it, each next one by the
    transition from the label before and by its emission; a sequence has a generator of its own."""
    for_python(seqs.sparkSession)
    transition, emission = guess_model(states, letters, alpha, seed)
    first = np.cumsum(emission, axis=0).T  # letter x state
    after = np.cumsum(transition[:, None, :] * emission.T[None, :, :], axis=2)  # state x letter x state

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, c in zip(pdf["seq_id"], pdf["codes"], strict=True):
                draws, labels, row = generator(seed, 0, 0, i).random(len(c)), [], None
                for x, u in zip(c, draws, strict=True):
                    row = first[x] if row is None else after[at, x]  # noqa: F821
                    at = min(int(np.searchsorted(row, u * row[-1], side="right")), len(row) - 1)
                    labels.append(at + 2)
                out.append(labels)
            yield pd.DataFrame({"seq_id": pdf["seq_id"], "codes": pdf["codes"], "labels": out})

    return seqs.select("seq_id", "codes").mapInPandas(run, "seq_id long, codes array<int>, labels array<int>")


def initial_states(mean_length: float, seed: int) -> int:
    """About the root of the mean length, between 10 and 998."""
    return int(np.clip(round(np.random.default_rng(seed).normal(round(mean_length**0.5), 1)), 10, MOST - 2))


def counted(labels: DataFrame, letters: int, states: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weighted transition (with start and end) and emission counts of each model; sums are taken in Spark."""
    arrows = F.transform(F.arrays_zip(F.concat(F.array(F.lit(START)), "labels").alias("f"), F.concat("labels", F.array(F.lit(END))).alias("t")), lambda x: F.struct(F.lit(0).alias("kind"), x["f"].cast("int").alias("a"), x["t"].cast("int").alias("b")))
    spots = F.transform(F.arrays_zip(F.col("labels").alias("s"), F.col("codes").alias("c")), lambda x: F.struct(F.lit(1).alias("kind"), x["s"].cast("int").alias("a"), x["c"].cast("int").alias("b")))
    rows = labels.where(F.size("labels") > 0).select("model", "weight", F.explode(F.concat(arrows, spots)).alias("x"))
    rows = rows.groupBy("model", "x.kind", "x.a", "x.b", "weight").agg(F.count("*").alias("n")).groupBy("model", "kind", "a", "b").agg(F.sum(F.round(F.col("weight") * F.col("n"), 6).cast("decimal(38,6)")).cast("double").alias("n"))  # the same sum in any order
    out = [(np.zeros((k, k)), np.zeros((k, letters))) for k in states]
    for m, kind, a, b, n in rows.toPandas().itertuples(index=False):
        out[m][kind][a, b] = n
    return out


def table_count(n: int, mass: float, rng: np.random.Generator) -> int:
    """How many of n customers open a table: one draw of probability mass / (mass + c) for each c below n."""
    few = min(n, EXACT_TERMS)
    tables = int((rng.random(few) < mass / (mass + np.arange(few))).sum())
    if n > few:
        tables += int(rng.poisson(mass * math.log((mass + n) / (mass + few))))
    return max(1, tables)


def sample_hyper(t: np.ndarray, s: State, rng: np.random.Generator) -> State:
    """Table counts, base weights beta and the two concentrations, by auxiliary variables."""
    k = t.shape[1]
    tables = np.zeros_like(t)
    for (i, j), n in np.ndenumerate(t):
        if n:
            tables[i, j] = table_count(max(1, round(n)), s.alpha * s.beta[j], rng)
    m = tables.sum(axis=0)
    beta = np.append(rng.gamma(np.maximum(m, 1e-9)), rng.gamma(s.gamma))
    beta[START] = 0
    beta /= beta.sum()
    alpha, gamma, total, used = s.alpha, s.gamma, tables.sum(), int((m > 0).sum())
    rows = t.sum(axis=1)
    rows = rows[rows > 0]
    for _ in range(HYPER_STEPS):
        w = rng.beta(alpha + 1, rows)
        p = (rng.random(len(rows)) < rows / (rows + alpha)).sum()
        alpha = rng.gamma(ALPHA_PRIOR[0] + total - p) / (1 / ALPHA_PRIOR[1] - np.log(w).sum())
        mu = rng.beta(gamma + 1, max(total, 1))
        share = 1 / (1 + total * (1 / GAMMA_PRIOR[1] - np.log(mu)) / (GAMMA_PRIOR[0] + used - 1))
        gamma = rng.gamma(GAMMA_PRIOR[0] + used - (rng.random() > share)) / (1 / GAMMA_PRIOR[1] - np.log(mu))
    return State(beta, float(alpha), float(gamma), s.iteration)


def sample_model(t: np.ndarray, e: np.ndarray, s: State, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Transition rows (last column: new states) and emissions."""
    k = len(t)
    trans = np.zeros((k, k + 1))
    for i in range(k):
        if i != END:
            g = rng.gamma(np.append(t[i], 0) + s.beta * s.alpha + 1e-12)
            g[START] = 0
            trans[i] = g / g.sum()
    g = rng.gamma(e + EMISSION_PRIOR)
    emit = g / g.sum(axis=1, keepdims=True)
    emit[:2] = 0
    return trans, emit


def expand(trans: np.ndarray, emit: np.ndarray, s: State, background: np.ndarray, least: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, State]:
    """Break sticks off the new mass until no transition to it exceeds the smallest slice, or MOST states exist."""
    beta = s.beta
    while trans[:, -1].max() >= least and len(trans) < MOST:
        cut = rng.beta(1, s.gamma)
        rest = beta[-1]
        beta = np.append(beta[:-1], [cut * rest, (1 - cut) * rest])
        a, b = max(s.alpha * cut * rest, 1e-6), max(s.alpha * (1 - cut) * rest, 1e-6)
        part = np.array([float(rng.random() < a / (a + b)) if min(a, b) < 0.01 else rng.beta(a, b) for _ in range(len(trans))])
        trans = np.column_stack([trans[:, :-1], trans[:, -1] * part, trans[:, -1] * (1 - part)])
        row = rng.gamma(beta * s.alpha + 1e-12)
        row[START] = 0
        trans = np.vstack([trans, row / row.sum()])
        letters = rng.gamma(background + 1e-9)
        emit = np.vstack([emit, letters / letters.sum()])
    return trans, emit, State(beta, s.alpha, s.gamma, s.iteration)


def generator(seed: int, iteration: int, model: int, seq_id: int, *more: int) -> np.random.Generator:
    return np.random.default_rng([seed, iteration, model, int(seq_id) & 0xFFFFFFFFFFFFFFFF, *more])


def slices(trans: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """u[i] uniform below the transition into position i; the last is for the step to the end."""
    path = np.concatenate([[START], labels, [END]])
    return rng.random(len(path) - 1) * trans[path[:-1], path[1:]]


def falling(trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions between states that exist, by falling probability: minus the probability, from, to."""
    t = trans[:, : len(trans)]
    a, b = np.nonzero(t)
    order = np.argsort(-t[a, b], kind="stable")
    return -t[a, b][order], a[order], b[order]


def resample(trans: np.ndarray, emit: np.ndarray, codes: np.ndarray, u: np.ndarray, rng: np.random.Generator, sorted_: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray | None:
    """New labels: forward over transitions above the slices, then sampling backwards; None without a path.

    A step touches only the transitions above its slice, a prefix of the falling ones."""
    n, k = len(codes), len(trans)
    t = trans[:, :k]
    low, source, target = sorted_ or falling(trans)
    above = np.searchsorted(low, -u)
    f = np.zeros((n, k))
    f[0] = (t[START] > u[0]) * emit[:, codes[0]]
    for i in range(n):
        if i:
            m = above[i]
            f[i] = np.bincount(target[:m], weights=f[i - 1][source[:m]], minlength=k) * emit[:, codes[i]]
        total = f[i].sum()
        if not total:
            return None
        f[i] /= total
    out = np.zeros(n, dtype=np.int64)
    p = f[-1] * (t[:, END] > u[n])
    for i in range(n - 1, -1, -1):
        total = p.sum()
        if not total:
            return None
        out[i] = min(int(np.searchsorted(np.cumsum(p), rng.random() * total)), k - 1)
        if i:
            p = f[i - 1] * (t[:, out[i]] > u[i])
    return out


def resample_many(trans: np.ndarray, emit: np.ndarray, codes: list[np.ndarray], u: list[np.ndarray], draws: list[np.ndarray], sorted_: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray | None]:
    """resample() of several sequences (none empty) at once, a place of all of them at a time, with the same sums in the
    same order; draws: each sequence's uniform numbers, as many as letters."""
    k = len(trans)
    t = np.ascontiguousarray(trans[:, :k])
    into, likely = np.ascontiguousarray(t.T), np.ascontiguousarray(emit.T)
    low, source, target = sorted_
    order = np.argsort([-len(c) for c in codes], kind="stable")  # those that reach a place come first
    size = np.array([len(codes[j]) for j in order])
    b, n = len(order), int(size[0])
    x, slice_, draw = np.zeros((b, n), dtype=np.int64), np.ones((b, n + 1)), np.zeros((b, n))
    for row, j in enumerate(order):
        m = size[row]
        x[row, :m], slice_[row, : m + 1], draw[row, :m] = codes[j], u[j], draws[j][::-1]
    above = np.searchsorted(low, -slice_)
    reach = b - np.searchsorted(size[::-1], np.arange(n), side="right")
    f, lost = np.zeros((n, b, k)), np.zeros(b, dtype=bool)
    for i in range(n):
        a = int(reach[i])
        if i:
            m = above[:a, i]
            row = np.repeat(np.arange(a), m)
            at = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
            now = np.bincount(row * k + target[at], weights=f[i - 1].ravel()[row * k + source[at]], minlength=a * k).reshape(a, k) * likely[x[:a, i]]
        else:
            now = (t[START] > slice_[:a, :1]) * likely[x[:a, 0]]
        total = now.sum(axis=1)
        lost[:a] |= total == 0
        f[i, :a] = now / np.where(total == 0, 1.0, total)[:, None]
    out = np.full((b, n + 1), END, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        a = int(reach[i])
        p = f[i, :a] * (into[out[:a, i + 1]] > slice_[:a, i + 1, None])
        total = p.sum(axis=1)
        lost[:a] |= total == 0
        out[:a, i] = np.minimum((np.cumsum(p, axis=1) < (draw[:a, i] * total)[:, None]).sum(axis=1), k - 1)
    got: list[np.ndarray | None] = [None] * b
    for row, j in enumerate(order):
        if not lost[row]:
            got[j] = out[row, : size[row]]
    return got


def together(sizes: list[int], states: int) -> Iterator[list[int]]:
    """Places of the sequences that are resampled at once, of like lengths, as many as HELD numbers allow."""
    held: list[int] = []
    longest = 0
    for j in sorted(range(len(sizes)), key=lambda j: -sizes[j]):
        longest = longest or sizes[j]
        if held and (len(held) + 1) * longest * states > HELD:
            yield held
            held, longest = [], sizes[j]
        held.append(j)
    if held:
        yield held


def _draws(attempt: int, kind: int) -> tuple[int, ...]:
    """What tells a sequence's generators apart: slices (kind 0) and labels (1) of each attempt at an iteration."""
    return (2 * attempt + kind,) if attempt or kind else ()


def _smallest_slices(labels: DataFrame, trans: list[np.ndarray], seed: int, iteration: int, attempt: int = 0) -> list[float]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = [1.0] * len(trans)
        for pdf in batches:
            for m, i, l in zip(pdf["model"], pdf["seq_id"], pdf["labels"], strict=True):
                if len(l):
                    low[m] = min(low[m], float(slices(trans[m], np.asarray(l, dtype=np.int64), generator(seed, iteration, m, i, *_draws(attempt, 0))).min()))
        yield pd.DataFrame({"model": range(len(trans)), "u": low})

    found = labels.select("model", "seq_id", "labels").mapInPandas(run, "model int, u double").groupBy("model").agg(F.min("u").alias("u")).collect()  # one row a model
    least = {r["model"]: r["u"] for r in found}
    return [float(least.get(m, 1.0) or 1.0) for m in range(len(trans))]


#: Attempts at an iteration in which some sequence has no path.
ATTEMPTS = 10
COLUMNS = "model int, seq_id long, codes array<int>, labels array<int>, weight double"


def _resampled(labels: DataFrame, trans: list[np.ndarray], emit: list[np.ndarray], seed: int, iteration: int, attempt: int = 0) -> DataFrame:
    """labels drawn anew, with lost: whether the sequence has no path above its slices, and so its old labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = [falling(t) for t in trans]
        for pdf in batches:
            model, ids = pdf["model"].to_numpy(), pdf["seq_id"].to_numpy()
            new = [np.asarray(x, dtype=np.int64) for x in pdf["labels"]]
            codes, lost = [np.asarray(x, dtype=np.int64) for x in pdf["codes"]], np.zeros(len(pdf), dtype=bool)
            for m in np.unique(model):
                rows = [j for j in np.flatnonzero(model == m).tolist() if len(new[j])]
                for some in together([len(new[j]) for j in rows], len(trans[m])):
                    own = [rows[j] for j in some]
                    u = [slices(trans[m], new[j], generator(seed, iteration, m, ids[j], *_draws(attempt, 0))) for j in own]
                    r = [generator(seed, iteration, m, ids[j], *_draws(attempt, 1)).random(len(new[j])) for j in own]
                    for j, got in zip(own, resample_many(trans[m], emit[m], [codes[j] for j in own], u, r, order[m]), strict=True):
                        lost[j] = got is None
                        new[j] = new[j] if got is None else got
            yield pd.DataFrame({"model": model, "seq_id": ids, "codes": pdf["codes"], "labels": [x.astype(np.int32) for x in new], "weight": pdf["weight"], "lost": lost})

    return labels.select("model", "seq_id", "codes", "labels", "weight").mapInPandas(run, COLUMNS + ", lost boolean")


def relabelled(labels: DataFrame, states: list[State | None]) -> tuple[DataFrame, list[int], list[State | None]]:
    """Labels of each model numbered densely from 2; the base weight of states that nobody uses goes to the new mass."""
    found: list[list[int]] = [[] for _ in states]
    for r in labels.select("model", F.explode("labels").alias("l")).distinct().collect():  # at most MOST a model
        found[r["model"]].append(r["l"])
    found = [sorted(x) for x in found]
    wide = 1 << 12
    place = {m * wide + old: i + 2 for m, used in enumerate(found) for i, old in enumerate(used)}
    if any(k % wide != v for k, v in place.items()):
        lookup = F.create_map(*(F.lit(x) for kv in place.items() for x in kv))
        labels = labels.withColumn("labels", F.transform("labels", lambda l: lookup[F.col("model") * wide + l]))
    out = []
    for used, s in zip(found, states, strict=True):
        if s is not None:
            kept = [START, END, *used]
            s = State(np.append(s.beta[kept], max(1 - s.beta[kept].sum(), 1e-9)), s.alpha, s.gamma, s.iteration)
        out.append(s)
    return labels, [len(x) + 2 for x in found], out


def weighted(labels: DataFrame, models: list[Model], outer: int) -> DataFrame:
    """labels with the weights of outer iteration outer: each row is scored under its own model, then the rows of a
    sequence (one a model) are compared."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            score = np.zeros(len(pdf))
            for m, rows in pdf.groupby("model").groups.items():
                got = forward(models[m], [np.asarray(c, dtype=np.int64) for c in pdf.loc[rows, "codes"]])
                score[rows] = np.where(np.isfinite(got), got, 0.0)
            yield pdf.assign(score=score)

    scored = labels.drop("weight").select("model", "seq_id", "codes", "labels").mapInPandas(run, "model int, seq_id long, codes array<int>, labels array<int>, score double")
    out = I.competitive_weights(scored, "seq_id", "score", len(models), I.temperature(outer))
    return out.select("model", "seq_id", "codes", "labels", F.round("weight", 6).alias("weight"))


@dataclass
class Bag:
    """A training run: the long table of labels, and the sampler's state of each model."""

    labels: DataFrame
    states: list[State | None]
    seed: int
    letters: int
    iteration: int = 0
    competitive: bool = False
    inner: int = INNER
    #: Times that a sequence kept its labels because no attempt at an iteration had a path for all.
    lost: int = 0

    def finite(self) -> list[Model]:
        """The finite models of the present labels."""
        labels, k, _ = relabelled(self.labels, self.states)
        models = []
        for t, e in counted(labels, self.letters, k):
            models.append(from_counts(t[2:, 2:], e[2:], np.maximum(e.sum(axis=0), 1e-9) / max(e.sum(), 1e-9), EMISSION_PRIOR))
        return models

    def run(self, iterations: int) -> Bag:
        """So many further iterations."""
        for _ in range(iterations):
            self._iterate()
        return self

    def _iterate(self) -> None:
        it = self.iteration
        labels, k, states = relabelled(self.labels, self.states)
        trans, emit, now = [], [], []
        for m, (t, e) in enumerate(counted(labels, self.letters, k)):
            rng = np.random.default_rng([self.seed, it, m])
            s = states[m] or State(np.append(np.r_[0.0, np.ones(k[m] - 1)], 1.0) / k[m], 1.0, 4.0)
            s = sample_hyper(t, s, rng)
            a, b = sample_model(t, e, s, rng)
            trans.append(a)
            emit.append(b)
            now.append((s, e.sum(axis=0) / max(e.sum(), 1), rng))
        for attempt in range(ATTEMPTS):
            # slices and new states are drawn again while a sequence has no path above its slices
            least = _smallest_slices(labels, trans, self.seed, it, attempt)
            wide, likely, grown = [], [], []
            for m, (s, background, rng) in enumerate(now):
                rng = np.random.default_rng([self.seed, it, m, attempt]) if attempt else rng
                a, b, s = expand(trans[m], emit[m], s, background, least[m], rng)
                s.iteration = it + 1
                wide.append(a)
                likely.append(b)
                grown.append(s)
            new = written(_resampled(labels, wide, likely, self.seed, it, attempt), f"labels{it}")
            lost = new.where("lost").count()
            if not lost:
                break
        self.lost += lost
        self.labels, self.states, self.iteration = new.drop("lost"), grown, it + 1
        if self.competitive and len(now) > 1 and self.iteration % self.inner == 0:
            self.labels = written(dealt(weighted(self.labels, self.finite(), self.iteration // self.inner - 1)), f"weights{it}")


def dealt(rows: DataFrame) -> DataFrame:
    """rows over all cores: labels take few bytes, and so would come in few files, but much work."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def start(seqs: DataFrame, letters: int, seed: int = 3, states: int | None = None, models: int = 1, competitive: bool = False, inner: int = INNER) -> Bag:
    """A run on a table (seq_id long, codes array<int>) before its first iteration; each model starts from its own labels."""
    for_python(seqs.sparkSession)
    if states is None:
        states = initial_states(float(seqs.agg(F.avg(F.size("codes"))).first()[0] or 0), seed)
    one = lambda m: initial_labels(seqs, states, seed + m).select(F.lit(m).alias("model"), "seq_id", "codes", "labels", F.lit(1.0).alias("weight"))
    rows = one(0)
    for m in range(1, models):
        rows = rows.unionByName(one(m))
    return Bag(written(dealt(rows), "labels"), [None] * models, seed, letters, competitive=competitive, inner=inner)


def best(bag: Bag) -> int:
    """The model of the smallest BIC over the summed log-odds of all sequences, each under each model."""
    models = bag.finite()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [np.asarray(c, dtype=np.int64) for c in pdf["codes"]]
            for m, rows in pdf.reset_index(drop=True).groupby("model").groups.items():
                got = forward(models[m], [x[i] for i in rows])
                yield pd.DataFrame({"model": [m], "score": [float(got[np.isfinite(got)].sum())], "letters": [sum(len(x[i]) for i in rows)]})

    rows = bag.labels.select("model", "codes").mapInPandas(run, "model int, score double, letters long").groupBy("model").agg(F.sum("score").alias("score"), F.sum("letters").alias("letters")).collect()  # one row a model
    free = lambda m: m.states * (m.states - 1) + m.states * (m.emission.shape[1] - 1)
    return min((-2 * r["score"] + free(models[r["model"]]) * math.log(max(r["letters"], 1)), r["model"]) for r in rows)[1]


def train(seqs: DataFrame, letters: int, iterations: int, seed: int = 3, states: int | None = None) -> tuple[DataFrame, State, Model]:
    """Labels, sampler state and finite model of one model after so many iterations."""
    bag = start(seqs, letters, seed, states).run(iterations)
    model = bag.finite()[0]
    labels, _, states_ = relabelled(bag.labels, bag.states)
    return labels.select("seq_id", "codes", "labels"), states_[0], model
