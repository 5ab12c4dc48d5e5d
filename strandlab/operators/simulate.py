"""Generators: random, planted and model-emitted sequences, as functions of (seed, sequence) alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions.sequences import DNA, uniform
from strandlab.operators.markov import Model
from strandlab.session import for_python

#: The planted-motif challenge.
CHALLENGE_N, CHALLENGE_LENGTH, MOTIF_LENGTH = 20, 600, 15


def random_sequences(spark, n: int, length: int, alphabet: str, p: list[float] | None = None, seed: int = 1, first: int = 0) -> DataFrame:
    """seq_id, seq: independent letters of the given probabilities (uniform if none)."""
    p = p or [1 / len(alphabet)] * len(alphabet)
    edges = np.cumsum(np.array(p) / sum(p))

    def letter(u):
        out = F.lit(alphabet[-1])
        for c, e in reversed(list(zip(alphabet[:-1], edges[:-1], strict=True))):
            out = F.when(u < float(e), F.lit(c)).otherwise(out)
        return out

    rows = spark.range(first, first + n).withColumnRenamed("id", "seq_id")
    return rows.select("seq_id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: letter(uniform(seed, F.col("seq_id"), i))), "").alias("seq"))


def mutated(motif: str, mismatches: int, key, seed: int):
    """The motif with exactly so many sites changed to another base."""
    order = F.slice(F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(len(motif) - 1)), lambda i: F.struct(uniform(seed, key, i).alias("u"), i.alias("i")))), lambda s: s["i"]), 1, max(1, mismatches))

    def other(c, i):
        at = F.position(c, F.lit(DNA))
        step = 1 + F.floor(uniform(seed + 1, key, i) * 3).cast("int")
        return F.substring(F.lit(DNA), (at - 1 + step) % 4 + 1, F.lit(1))

    chars = F.split(F.lit(motif), "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(F.lit(mismatches > 0) & F.array_contains(order, i), other(c, i)).otherwise(c)), "")


def planted(seqs: DataFrame, motif: str, mismatches: int, window: float, seed: int) -> DataFrame:
    """seq_id, seq, pos, mismatches: one copy of the motif overwrites each sequence inside the middle window."""
    room = F.length("seq") - len(motif)
    start = F.floor(room * (0.5 - window / 2) + uniform(seed, "at", F.col("seq_id")) * room * window).cast("int")
    rows = seqs.withColumn("pos", start).withColumn("copy", mutated(motif, mismatches, F.col("seq_id"), seed))
    return rows.select("seq_id", F.overlay("seq", "copy", F.col("pos") + 1).alias("seq"), "pos", F.lit(mismatches).alias("mismatches"))


def challenge(spark, mismatches: int, window: float, seed: int = 3, n: int = CHALLENGE_N, length: int = CHALLENGE_LENGTH, gap: int = 0) -> DataFrame:
    """The planted-motif challenge: n sequences with one 15-mer each; gap: its halves stand so far apart."""
    rng = np.random.default_rng(seed)
    motif = "".join(rng.choice(list(DNA), MOTIF_LENGTH))
    base = random_sequences(spark, n, length, DNA, seed=seed)
    if not gap:
        return planted(base, motif, mismatches, window, seed)
    half = MOTIF_LENGTH // 2
    first = planted(base, motif[:half] + "N" * gap + motif[half:], 0, window, seed)
    kept = F.overlay("seq", F.substring(F.col("old"), F.col("pos") + 1 + half, F.lit(gap)), F.col("pos") + 1 + half)
    return first.join(base.withColumnRenamed("seq", "old"), "seq_id").select("seq_id", kept.alias("seq"), "pos", "mismatches")


def benchmark(spark, mismatches: int, n_train: int, n_test: int, seed: int = 7) -> DataFrame:
    """split, seq_id, seq: training and test sequences with the motif, and negative ones without."""
    rng = np.random.default_rng(seed)
    motif = "".join(rng.choice(list(DNA), MOTIF_LENGTH))
    base = lambda n, k: random_sequences(spark, n, CHALLENGE_LENGTH, DNA, seed=seed + k, first=k * 10_000_000)
    with_motif = lambda n, k, split: planted(base(n, k), motif, mismatches, 1.0, seed + k).select(F.lit(split).alias("split"), "seq_id", "seq")
    return with_motif(n_train, 0, "train").unionByName(with_motif(n_test, 1, "test")).unionByName(base(n_test, 2).select(F.lit("neg").alias("split"), "seq_id", "seq"))


def composition(spark, mix: float, n: int, length: int = CHALLENGE_LENGTH, seed: int = 9, switch: float = 0.02) -> DataFrame:
    """split, seq_id, seq: positives switch between two compositions, negatives have their average."""
    rich, poor = np.array([0.25 + 0.2 * mix, 0.25 - 0.2 * mix, 0.25 - 0.2 * mix, 0.25 + 0.2 * mix]), np.array([0.25 - 0.2 * mix, 0.25 + 0.2 * mix, 0.25 + 0.2 * mix, 0.25 - 0.2 * mix])
    model = Model(np.array([[1 - switch, switch], [switch, 1 - switch]]), np.vstack([rich, poor]), (rich + poor) / 2)
    pos = emitted(spark, model, n, length, DNA, seed).select(F.lit("test").alias("split"), "seq_id", "seq")
    neg = random_sequences(spark, n, length, DNA, list((rich + poor) / 2), seed + 1, first=10_000_000)
    return pos.unionByName(neg.select(F.lit("neg").alias("split"), "seq_id", "seq"))


def emit(model: Model, length: int, rng: np.random.Generator, start: int | None = None) -> tuple[list[int], list[int]]:
    """States and letters of one sequence of the model; it starts anywhere if no state is given."""
    state = int(rng.integers(model.states)) if start is None else start
    states, letters = [], []
    for _ in range(length):
        states.append(state)
        letters.append(int(rng.choice(model.emission.shape[1], p=model.emission[state] / model.emission[state].sum())))
        row = model.transition[state]
        state = int(rng.choice(model.states, p=row / row.sum())) if row.sum() > 0 else int(rng.integers(model.states))
    return states, letters


def emitted(spark, model: Model, n: int, length: int, alphabet: str, seed: int, start: int | None = None, first: int = 0) -> DataFrame:
    """seq_id, seq, states emitted by a model; k-mers of a state if start is given."""
    for_python(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                states, letters = emit(model, length, np.random.default_rng([seed, int(i)]), start)
                out.append((i, "".join(alphabet[c] for c in letters), states))
            yield pd.DataFrame(out, columns=["seq_id", "seq", "states"])

    return spark.range(first, first + n).mapInPandas(run, "seq_id long, seq string, states array<int>")


def draws(spark, kind: str, many: int, seed: int, /, **parameters) -> DataFrame:
    """id, x: so many draws of a named distribution (gamma, beta, binomial, normal, ...), each a function of (seed, id)."""
    for_python(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "x": [float(getattr(np.random.default_rng([seed, int(i)]), kind)(**parameters)) for i in pdf["id"]]})

    return spark.range(many).mapInPandas(run, "id long, x double")


def uniform_draws(spark, n: int, seed: int, many: int = 0) -> DataFrame:
    """id, x, k: a number in [0, 1) and an integer in [0, many), each a function of (seed, id)."""
    u = uniform(seed, F.col("id"))
    return spark.range(n).select("id", u.alias("x"), F.floor(uniform(seed + 1, F.col("id")) * max(many, 1)).cast("long").alias("k"))


def example_model(kind: str, main: float = 0.9, stay: float = 0.9) -> Model:
    """Models of the example data sets: "concat" runs through A, C, G, T, staying a while in each; "embedded" passes them
    once within background; "two_state" switches between an A/T-rich and a C/G-rich state."""
    own = lambda i: [main if j == i else (1 - main) / 3 for j in range(4)]
    uniform4 = np.full(4, 0.25)
    if kind == "concat":
        t = stay * np.eye(4) + (1 - stay) * np.roll(np.eye(4), 1, axis=1)
        return Model(t, np.array([own(i) for i in range(4)]), uniform4)
    if kind == "embedded":
        t = np.zeros((5, 5))
        t[0, 0], t[0, 1] = 0.98, 0.02
        t[[1, 2, 3, 4], [2, 3, 4, 0]] = 1
        return Model(t, np.vstack([uniform4, [own(i) for i in range(4)]]), uniform4)
    if kind == "two_state":
        t = np.array([[stay, 1 - stay], [1 - stay, stay]])
        return Model(t, np.array([[main / 2, (1 - main) / 2, (1 - main) / 2, main / 2], [(1 - main) / 2, main / 2, main / 2, (1 - main) / 2]]), uniform4)
    raise ValueError(kind)
