"""Finite hidden Markov models: preparation, forward, backward, posterior decoding, calibration, scoring of tables.

A model is a small driver-side value (at most 1000 states) that is shipped with the task; sequences stay distributed.
Between the flanking states N (before), J (between passes) and C (after), a sequence passes the model one or more times
(multi-hit) or once (uni-hit).  The forward pass of a small model is a product of one small matrix a letter, taken in
pairs (half as many matrices at every level), so that a long sequence costs no Python step a letter.  For larger models
the sequences of a batch are sorted by length and processed in groups of bounded size: a step is one product of a
(sequences x states) with the transition matrix.  Both work in probabilities that are rescaled as they go.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.session import for_python

#: Tail mass, number and length of the sequences that a model is calibrated with.
TAIL, CALIBRATION_N, CALIBRATION_LENGTH = 0.04, 1000, 100
N, B, E, C, J = range(5)
#: Most states of a model whose forward pass is a product of matrices, and letters of such a product at a time.
SMALL_MODEL, PRODUCT = 12, 1 << 13
#: Letters from which a sequence is long enough for that.
LONG = 512
#: Letters of a group of sequences that are processed together, padding included.
GROUP = 4_000_000


def bias_transitions(spark, letters: int) -> DataFrame:
    """from_state, to_state, p of the two-state composition model."""
    rows = [(0, 0, 400 / 401), (0, 1, 1 / 401), (1, 1, letters / (letters + 1)), (1, 0, 1 / (letters + 1))]
    return spark.createDataFrame(rows, "from_state int, to_state int, p double")


@dataclass
class Model:
    """Transition and emission probabilities, background, and what calibration adds."""

    transition: np.ndarray
    emission: np.ndarray
    background: np.ndarray
    tau: float = float("nan")

    @property
    def states(self) -> int:
        return len(self.transition)

    @property
    def entropy(self) -> float:
        """Mean relative entropy of the states' emissions, in bits."""
        p, q = self.emission, self.background[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return float(np.where(p > 0, p * np.log2(p / q), 0).sum(axis=1).mean())

    @property
    def slope(self) -> float:
        """Of the exponential tail."""
        return math.log(2) + 1.44 / (self.states * max(self.entropy, 1e-9))

    @property
    def odds(self) -> np.ndarray:
        return self.emission / self.background[None, :]

    def tables(self, spark) -> dict[str, DataFrame]:
        """The model as tables: parameters, transitions, emissions."""
        t = [(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(self.transition) if v > 0]
        e = [(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(self.emission)]
        b = [(int(i), float(v)) for i, v in enumerate(self.background)]
        return {
            "fhmm_param": spark.createDataFrame([(self.states, self.emission.shape[1], self.entropy, self.slope, float(self.tau))], "k int, letters int, h double, lambda double, tau double"),
            "fhmm_transition": spark.createDataFrame(t, "from_state int, to_state int, t double"),
            "fhmm_emission": spark.createDataFrame(e, "state int, code int, p double"),
            "fhmm_background": spark.createDataFrame(b, "code int, p double"),
        }

    def save(self, spark, path: str) -> None:
        for name, rows in self.tables(spark).items():
            rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str) -> Model:
        read = lambda n: spark.read.parquet(f"{path}/{n}").toPandas()  # noqa: E731  states squared rows
        p = read("fhmm_param").iloc[0]
        m = Model(np.zeros((int(p.k), int(p.k))), np.zeros((int(p.k), int(p.letters))), np.zeros(int(p.letters)), float(p.tau))
        for r in read("fhmm_transition").itertuples():
            m.transition[r.from_state, r.to_state] = r.t
        for r in read("fhmm_emission").itertuples():
            m.emission[r.state, r.code] = r.p
        for r in read("fhmm_background").itertuples():
            m.background[r.code] = r.p
        return m


def bias_of(model: Model) -> Model:
    """The two-state model of a sequence that only has the model's composition."""
    letters = model.emission.shape[1]
    t = np.array([[400 / 401, 1 / 401], [1 / (letters + 1), letters / (letters + 1)]])
    mean = model.emission.mean(axis=0)
    return Model(t, np.vstack([model.background, mean / mean.sum()]), model.background)


def flanks(length, multi: bool):
    """Probability to stay in a flanking state, and to pass the model again."""
    length = np.asarray(length, dtype=float)
    return length / (length + (3 if multi else 2)), 0.5 if multi else 0.0


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(s) for s in seqs], dtype=np.int64)
    x = np.zeros((len(seqs), int(length.max(initial=0))), dtype=np.int16)
    for row, s in zip(x, seqs, strict=True):
        row[: len(s)] = s
    return x, length


def letter_matrices(model: Model, stay: float, again: float) -> np.ndarray:
    """For each letter, the step of the row vector (states, N, J, C) that emits it."""
    k, odds = model.states, model.odds
    enter = (1 - stay) * 2 / (k * (k + 1))
    out = np.zeros((odds.shape[1], k + 3, k + 3))
    out[:, :k, :k] = model.transition[None] * odds.T[:, None, :]
    out[:, k : k + 2, :k] = (enter * odds.T)[:, None, :]
    out[:, :k, k + 1], out[:, :k, k + 2] = again, 1 - again
    for flank in range(k, k + 3):
        out[:, flank, flank] = stay
    return out


def _scaled(m: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = m.max(axis=(1, 2))
    top = np.where(top > 0, top, 1.0)
    return m / top[:, None, None], log + np.log(top)


def forward_product(model: Model, x: np.ndarray, multi: bool = True) -> float:
    """Log-odds (nats) of one sequence, by products of letter matrices."""
    n, k = len(x), model.states
    if not n:
        return -math.inf
    stay, again = (float(v) for v in flanks(n, multi))
    one, codes = letter_matrices(model, stay, again), np.asarray(x, dtype=np.int64)
    parts = [(one, codes)]
    if len(one) <= 4 and n >= 2 * len(one) ** 4:  # all words of four letters are multiplied once
        word = one
        for _ in range(2):
            word = np.matmul(word[:, None], word[None, :]).reshape(-1, k + 3, k + 3)
        whole = n // 4 * 4
        parts = [(word, codes[:whole].reshape(-1, 4) @ (len(one) ** np.arange(3, -1, -1))), (one, codes[whole:])]
    v, scale = np.zeros(k + 3), 0.0
    v[k] = 1
    for kinds, c in parts:
        for at in range(0, len(c), PRODUCT):
            m = kinds[c[at : at + PRODUCT]]
            log = np.zeros(len(m))
            while len(m) > 1:
                even = len(m) // 2 * 2
                p, q = _scaled(np.matmul(m[0:even:2], m[1:even:2]), log[0:even:2] + log[1:even:2])
                m, log = (np.concatenate([p, m[even:]]), np.concatenate([q, log[even:]])) if even < len(m) else (p, q)
            v = v @ m[0]
            total = v.sum()
            v, scale = v / total, scale + float(log[0]) + math.log(total)
    last = (v[:k].sum() + v[k + 2]) * (1 - stay)
    return math.log(last) + scale if last > 0 else -math.inf


def forward(model: Model, seqs: list[np.ndarray], multi: bool = True) -> np.ndarray:
    """Log-odds (nats, against the background's letters) of every sequence; minus infinity for empty ones."""
    out = np.full(len(seqs), -np.inf)
    long_ = [i for i, s in enumerate(seqs) if model.states <= SMALL_MODEL and len(s) >= LONG]
    for i in long_:
        out[i] = forward_product(model, seqs[i], multi)
    rest = np.array(sorted(set(range(len(seqs))) - set(long_), key=lambda i: (-len(seqs[i]), i)), dtype=np.int64)
    while len(rest):
        m = max(1, GROUP // max(1, len(seqs[rest[0]])))
        out[rest[:m]] = _forward_steps(model, [seqs[i] for i in rest[:m]], multi)
        rest = rest[m:]
    return out


def _forward_steps(model: Model, seqs: list[np.ndarray], multi: bool) -> np.ndarray:
    """The same for sequences that are sorted by length, the longest first."""
    x, length = _padded(seqs)
    stay, again = flanks(length, multi)
    stay = np.where(length > 0, stay, 0.5)
    odds, enter = model.odds, 2 / (model.states * (model.states + 1))
    m = len(seqs)
    state, scale, score = np.zeros((m, model.states)), np.zeros(m), np.full(m, -np.inf)
    n, b, e, c, j = np.ones(m), 1 - stay, np.zeros(m), np.zeros(m), np.zeros(m)
    live = m
    for i in range(x.shape[1]):
        while live and length[live - 1] <= i:
            live -= 1
        s = slice(0, live)
        new = (state[s] @ model.transition + (b[s] * enter)[:, None]) * odds[:, x[s, i]].T
        j[s], c[s] = j[s] * stay[s] + e[s] * again, c[s] * stay[s] + e[s] * (1 - again)
        n[s] *= stay[s]
        e[s] = new.sum(axis=1)
        b[s] = (n[s] + j[s]) * (1 - stay[s])
        total = e[s] + n[s] + c[s] + j[s]
        state[s] = new / total[:, None]
        for v in (n, b, e, c, j):
            v[s] /= total
        scale[s] += np.log(total)
        done = np.flatnonzero(length[s] == i + 1)
        with np.errstate(divide="ignore"):
            score[done] = np.log((c[done] + e[done]) * (1 - stay[done])) + scale[done]
    return score


def null_score(length) -> np.ndarray:
    """Of a sequence of that length without the model."""
    length = np.asarray(length, dtype=float)
    stay = length / (length + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(length > 0, length * np.log(stay), 0) + np.log(1 - stay)


def matrices(model: Model, x: np.ndarray, multi: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Forward and backward values of one sequence in logarithms: states and the five flanking states, and both totals."""
    n = len(x)
    stay, again = (float(v) for v in flanks(n, multi))
    with np.errstate(divide="ignore"):
        lt, lo = np.log(model.transition), np.log(model.odds)
        keep, leave, repeat, stop = np.log(stay), np.log(1 - stay), np.log(again), np.log(1 - again)
    enter = math.log(2 / (model.states * (model.states + 1)))
    f, g = np.full((n + 1, model.states), -np.inf), np.full((n + 1, 5), -np.inf)
    g[0, N], g[0, B] = 0, leave
    for i in range(1, n + 1):
        f[i] = np.logaddexp(np.logaddexp.reduce(f[i - 1][:, None] + lt, axis=0), g[i - 1, B] + enter) + lo[:, x[i - 1]]
        g[i, E] = np.logaddexp.reduce(f[i])
        g[i, J] = np.logaddexp(g[i - 1, J] + keep, g[i - 1, E] + repeat)
        g[i, C] = np.logaddexp(g[i - 1, C] + keep, g[i - 1, E] + stop)
        g[i, N] = g[i - 1, N] + keep
        g[i, B] = np.logaddexp(g[i, N], g[i, J]) + leave
    total = float(np.logaddexp(g[n, C], g[n, E]) + leave)
    # h, w: log probability of what follows, given the state at i (its own letter not counted)
    h, w = np.full((n + 1, model.states), -np.inf), np.full((n + 1, 5), -np.inf)
    w[n, C] = w[n, E] = leave
    h[n] = w[n, E]
    for i in range(n - 1, -1, -1):
        step = h[i + 1] + lo[:, x[i]]
        w[i, B] = np.logaddexp.reduce(step) + enter
        w[i, J] = np.logaddexp(w[i + 1, J] + keep, w[i, B] + leave)
        w[i, C] = w[i + 1, C] + keep
        w[i, E] = np.logaddexp(w[i + 1, J] + repeat, w[i + 1, C] + stop)
        w[i, N] = np.logaddexp(w[i + 1, N] + keep, w[i, B] + leave)
        h[i] = np.logaddexp(w[i, E], np.logaddexp.reduce(lt + step[None, :], axis=1))
    return f, g, h, w, total, float(w[0, N])


#: Numbers of a group's forward and backward tables at most (or those of one sequence).
CELLS = 4_000_000


def batch_matrices(model: Model, seqs: list[np.ndarray], multi: bool = True) -> Iterator[tuple[int, tuple]]:
    """(number, matrices()) of every sequence: groups of about equal lengths go step by step together, in scaled numbers,
    by matrix products.  What is smaller than the largest value of its place by a factor of 1e-300 counts as zero."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    at, k = 0, model.states
    while at < len(order):
        longest = len(seqs[order[at]])
        some = order[at : at + max(1, min(256, CELLS // ((longest + 1) * (k + 5) * 2)))]
        at += len(some)
        yield from zip(some, _group_matrices(model, [seqs[i] for i in some], longest, multi), strict=True)


def _group_matrices(model: Model, seqs: list[np.ndarray], longest: int, multi: bool) -> list[tuple]:
    b, k = len(seqs), model.states
    size = np.array([len(x) for x in seqs])
    letters, back = np.zeros((longest, b), dtype=np.int64), np.zeros((longest, b), dtype=np.int64)
    for i, x in enumerate(seqs):
        letters[: len(x), i], back[: len(x), i] = x, x[::-1]
    keep, again = (np.broadcast_to(np.asarray(v, dtype=float), b) for v in flanks(size, multi))
    leave, stop, enter, odds = 1 - keep, 1 - again, 2 / (k * (k + 1)), model.odds.T
    f, g, lf = np.zeros((longest + 1, b, k)), np.zeros((longest + 1, b, 5)), np.zeros((longest + 1, b))
    h, w, lh = np.zeros((longest + 1, b, k)), np.zeros((longest + 1, b, 5)), np.zeros((longest + 1, b))
    g[0, :, N], g[0, :, B] = 1, leave
    w[0, :, C] = w[0, :, E] = leave
    h[0] = leave[:, None]
    for i in range(1, longest + 1):
        p, q = f[i - 1], g[i - 1]
        f[i] = (p @ model.transition + (q[:, B] * enter)[:, None]) * odds[letters[i - 1]]
        g[i, :, E] = f[i].sum(axis=1)
        g[i, :, J] = q[:, J] * keep + q[:, E] * again
        g[i, :, C] = q[:, C] * keep + q[:, E] * stop
        g[i, :, N] = q[:, N] * keep
        g[i, :, B] = (g[i, :, N] + g[i, :, J]) * leave
        step, v = h[i - 1] * odds[back[i - 1]], w[i - 1]
        w[i, :, B] = step.sum(axis=1) * enter
        w[i, :, J] = v[:, J] * keep + w[i, :, B] * leave
        w[i, :, C] = v[:, C] * keep
        w[i, :, E] = v[:, J] * again + v[:, C] * stop
        w[i, :, N] = v[:, N] * keep + w[i, :, B] * leave
        h[i] = w[i, :, E][:, None] + step @ model.transition.T
        for x, y, log in ((f, g, lf), (h, w, lh)):
            most = np.maximum(x[i].max(axis=1), y[i].max(axis=1))
            most[most <= 0] = 1
            x[i] /= most[:, None]
            y[i] /= most[:, None]
            log[i] = log[i - 1] + np.log(most)
    out = []
    with np.errstate(divide="ignore"):
        for i, n in enumerate(size.tolist()):
            there, here = np.arange(n + 1), np.arange(n, -1, -1)
            one = [np.log(x[t, i]) + log[t, i][:, None] for x, log, t in ((f, lf, there), (g, lf, there), (h, lh, here), (w, lh, here))]
            out.append((*one, float(np.log((g[n, i, C] + g[n, i, E]) * leave[i]) + lf[n, i]), float(one[3][0, N])))
    return out


def posterior_path(model: Model, x: np.ndarray, multi: bool = True, known: tuple | None = None) -> np.ndarray:
    """The path of maximum expected accuracy: one code a letter, 0 N, 3 C, 4 J, 5 + k for state k; known: matrices()."""
    n, k = len(x), model.states
    if not n:
        return np.zeros(0, dtype=np.int64)
    f, g, h, w, total, _ = known or matrices(model, x, multi)
    stay = float(flanks(n, multi)[0])
    keep = math.log(stay)
    with np.errstate(invalid="ignore"):
        inside = np.exp(f[1:] + h[1:] - total)
        loop = lambda s: np.exp(np.where(np.isfinite(g[:-1, s]) & np.isfinite(w[1:, s]), g[:-1, s] + keep + w[1:, s] - total, -np.inf))
        first = lambda s, share: np.exp(np.where(np.isfinite(g[:-1, E]) & np.isfinite(w[1:, s]), g[:-1, E] + (math.log(share) if share else -np.inf) + w[1:, s] - total, -np.inf))
        again = 0.5 if multi else 0.0
        gain = np.column_stack([loop(N), loop(J) + first(J, again), loop(C) + first(C, 1 - again), inside])
    # columns: N, J, C, then the states; which may follow which
    ok = np.zeros((k + 3, k + 3), dtype=bool)
    ok[0, 0] = ok[1, 1] = ok[2, 2] = True
    ok[0, 3:] = ok[1, 3:] = True
    ok[3:, 2] = True
    ok[3:, 1] = multi
    ok[3:, 3:] = model.transition > 0
    cost = np.where(ok, 0.0, -np.inf)
    best = np.where(np.arange(k + 3) >= 3, gain[0], -np.inf)
    best[0] = gain[0, 0]
    back = np.zeros((n, k + 3), dtype=np.int64)
    for i in range(1, n):
        m = best[:, None] + cost
        back[i] = m.argmax(axis=0)
        best = m.max(axis=0) + gain[i]
    best[[0, 1]] = -np.inf  # ends in C or in the model
    at = int(best.argmax())
    path = [at]
    for i in range(n - 1, 0, -1):
        at = int(back[i, at])
        path.append(at)
    return np.array([{0: N, 1: J, 2: C}.get(s, s + 2) for s in path[::-1]])


def fit_gumbel(x: np.ndarray) -> tuple[float, float]:
    """mu, lambda of the maximum-likelihood Gumbel distribution: the root of the likelihood equation in lambda."""
    x = np.asarray(x, dtype=float)
    low = x.min()
    y = x - low

    def slope(lam: float) -> float:
        e = np.exp(-lam * y)
        return 1 / lam - y.mean() + float((y * e).sum() / e.sum())

    a = b = math.pi / math.sqrt(6 * max(float(x.var()), 1e-12))
    while slope(a) < 0:
        a /= 2
    while slope(b) > 0:
        b *= 2
    for _ in range(200):
        mid = (a + b) / 2
        a, b = (mid, b) if slope(mid) > 0 else (a, mid)
    lam = (a + b) / 2
    return low - math.log(float(np.exp(-lam * y).mean())) / lam, lam


def calibrated(model: Model, seed: int = 42, n: int = CALIBRATION_N, length: int = CALIBRATION_LENGTH) -> Model:
    """The model with tau, the origin of its exponential tail: from a fixed number of short random sequences."""
    rng = np.random.default_rng(seed)
    x = rng.choice(len(model.background), size=(n, length), p=model.background / model.background.sum())
    bits = (forward(model, list(x)) - null_score(length)) / math.log(2)
    mu, lam = fit_gumbel(bits)
    tau = mu - math.log(-math.log(1 - TAIL)) / lam + math.log(TAIL) / model.slope
    return Model(model.transition, model.emission, model.background, tau)


def gumbel_of_lengths(model: Model, lengths: np.ndarray, share: np.ndarray, n: int = 100_000, seed: int = 42) -> tuple[float, float]:
    """mu, lambda of the scores of n random sequences whose lengths are drawn from a histogram."""
    rng = np.random.default_rng(seed)
    p = model.background / model.background.sum()
    scores = []
    for at in range(0, n, 5000):
        size = rng.choice(np.asarray(lengths), min(5000, n - at), p=np.asarray(share) / np.sum(share))
        x = [rng.choice(len(p), int(k), p=p) for k in size]
        scores.append((forward(model, x) - null_score(size)) / math.log(2))
    return fit_gumbel(np.concatenate(scores))


def score_batch(model: Model, bias: Model, seqs: list[np.ndarray], multi: bool = True) -> pd.DataFrame:
    """score, score_bias (bits), p, p_bias of every sequence."""
    length = np.array([len(s) for s in seqs])
    full = forward(model, seqs, multi)
    bits = (full - null_score(length)) / math.log(2)
    corrected = (full - forward(bias, seqs, multi)) / math.log(2)
    tail = lambda s: np.where(s < model.tau, 1.0, np.exp(-model.slope * (np.maximum(s, model.tau) - model.tau)))
    return pd.DataFrame({"score": bits, "score_bias": corrected, "p": tail(bits), "p_bias": tail(corrected)})


def codes_of(seq: str, alphabet: str) -> np.ndarray:
    """Codes of an ASCII sequence."""
    lookup = np.full(256, -1, dtype=np.int64)
    lookup[np.frombuffer(alphabet.encode(), dtype=np.uint8)] = np.arange(len(alphabet))
    return lookup[np.frombuffer(seq.encode("ascii"), dtype=np.uint8)]


#: Letters that are scored together at most; one longer sequence is by itself.
TOGETHER = 1 << 20


def _pieces(pdf: pd.DataFrame, name: str, most: int = TOGETHER) -> Iterator[pd.DataFrame]:
    """A batch in stretches of at most so many letters: an Arrow batch is bounded by rows, whatever their lengths."""
    begin = held = 0
    for i, n in enumerate(pdf[name].map(len).tolist()):
        if held and held + n > most:
            yield pdf.iloc[begin:i]
            begin, held = i, 0
        held += n
    if len(pdf) > begin:
        yield pdf.iloc[begin:]


def score_table(seqs: DataFrame, model: Model, multi: bool = True, alphabet: str | None = None) -> DataFrame:
    """seq_id, score, score_bias, p, p_bias of a table (seq_id, codes), or (seq_id, seq) with an alphabet; one narrow
    pass."""
    for_python(seqs.sparkSession)
    bias = bias_of(model)
    name = "seq" if alphabet else "codes"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (piece for batch in batches for piece in _pieces(batch, name)):
            x = [codes_of(c, alphabet) if alphabet else np.asarray(c, dtype=np.int64) for c in pdf[name]]
            yield pd.concat([pdf[["seq_id"]].reset_index(drop=True), score_batch(model, bias, x, multi)], axis=1)

    rows = seqs.where((F.length(name) if alphabet else F.size(name)) > 0).select("seq_id", name)
    return rows.mapInPandas(run, "seq_id long, score double, score_bias double, p double, p_bias double")


def score_models(seqs: DataFrame, models: dict[str, Model], multi: bool = True) -> DataFrame:
    """seq_id, model, score (bits) of every sequence under every model."""
    for_python(seqs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [np.asarray(c, dtype=np.int64) for c in pdf["codes"]]
            null = null_score([len(s) for s in x])
            for name, m in models.items():
                yield pd.DataFrame({"seq_id": pdf["seq_id"].to_numpy(), "model": name, "score": (forward(m, x, multi) - null) / math.log(2)})

    return seqs.where(F.size("codes") > 0).select("seq_id", "codes").mapInPandas(run, "seq_id long, model string, score double")


def label_table(seqs: DataFrame, model: Model, multi: bool = True) -> DataFrame:
    """seq_id, forward, backward (nats) and path of a table (seq_id, codes)."""
    for_python(seqs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, ids = [np.asarray(c, dtype=np.int64) for c in pdf["codes"]], pdf["seq_id"].tolist()
            rows = [(ids[i], m[4], m[5], posterior_path(model, x[i], multi, m).tolist()) for i, m in batch_matrices(model, x, multi)]
            yield pd.DataFrame(rows, columns=["seq_id", "forward", "backward", "path"])

    return seqs.where(F.size("codes") > 0).select("seq_id", "codes").mapInPandas(run, "seq_id long, forward double, backward double, path array<int>")


def score_modes(seqs: DataFrame, model: Model, multi: bool = True) -> DataFrame:
    """seq_id, forward, backward, null (nats), log_odds, log_odds_bias (bits), p, p_bias of a table (seq_id, codes)."""
    for_python(seqs.sparkSession)
    bias = bias_of(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [np.asarray(c, dtype=np.int64) for c in pdf["codes"]]
            s = score_batch(model, bias, x, multi)
            back = [t for _, t in sorted((i, m[5]) for i, m in batch_matrices(model, x, multi))]
            yield pd.DataFrame({"seq_id": pdf["seq_id"].to_numpy(), "forward": forward(model, x, multi), "backward": back, "null": null_score([len(c) for c in x]), "log_odds": s["score"], "log_odds_bias": s["score_bias"], "p": s["p"], "p_bias": s["p_bias"]})

    kinds = "seq_id long, forward double, backward double, null double, log_odds double, log_odds_bias double, p double, p_bias double"
    return seqs.where(F.size("codes") > 0).select("seq_id", "codes").mapInPandas(run, kinds)


def toy_model() -> Model:
    """Four states, each followed by the next, each with its own letter: finds ACGT."""
    t = np.diag([1.0, 1.0, 1.0], k=1)
    e = np.full((4, 4), 0.01 / 3)
    np.fill_diagonal(e, 0.99)
    return Model(t, e, np.full(4, 0.25))


def from_counts(transitions: np.ndarray, emissions: np.ndarray, background: np.ndarray, prior: float = 0.3, draws: int = 1000, seed: int = 3) -> Model:
    """A finite model from state counts: the mean of posterior draws, renormalised (draws 0: their analytic mean)."""
    rng = np.random.default_rng(seed)

    def mean(counts: np.ndarray, add: float) -> np.ndarray:
        if not draws:
            p = counts + add
        else:
            g = rng.gamma(np.broadcast_to(counts + add, (draws, *counts.shape)) + 1e-12)
            p = (g / np.maximum(g.sum(axis=2, keepdims=True), 1e-300)).mean(axis=0)
        total = p.sum(axis=1, keepdims=True)
        return np.divide(p, total, out=np.zeros_like(p), where=total > 0)

    return Model(mean(transitions, 1e-3), mean(emissions, prior), background)
