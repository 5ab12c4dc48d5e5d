"""Forward and backward tables of groups against those of single sequences in logarithms."""

import numpy as np
import pytest

from strandlab.operators import markov as H


def model(seed, k=5, letters=4):
    r = np.random.default_rng(seed)
    t = r.dirichlet(np.full(k, 0.4), k)
    t[0, 1] = 0.0
    return H.Model(t / t.sum(axis=1, keepdims=True), r.dirichlet(np.full(letters, 0.6), k), r.dirichlet(np.full(letters, 5.0)))


@pytest.mark.parametrize("multi", [True, False])
@pytest.mark.parametrize("cells", [H.CELLS, 900])
def test_groups_equal_single_sequences(monkeypatch, multi, cells):
    monkeypatch.setattr(H, "CELLS", cells)
    m, r = model(1), np.random.default_rng(2)
    seqs = [r.integers(0, 4, n) for n in (1, 7, 7, 30, 2, 61, 400)]
    seen = dict(H.batch_matrices(m, seqs, multi))
    assert sorted(seen) == list(range(len(seqs)))
    for i, x in enumerate(seqs):
        want = H.matrices(m, x, multi)
        for got, one in zip(seen[i][:4], want[:4], strict=True):
            near = one > one.max(axis=1, keepdims=True) - 600
            assert got.shape == one.shape and got[near] == pytest.approx(one[near], abs=1e-8)
        assert seen[i][4:] == pytest.approx(want[4:], abs=1e-8) and seen[i][4] == pytest.approx(seen[i][5], abs=1e-8)
        assert H.posterior_path(m, x, multi, seen[i]).tolist() == H.posterior_path(m, x, multi).tolist()


def test_impossible_letters():
    """A letter that no state emits leaves the flanks alone."""
    m = H.Model(np.full((2, 2), 0.5), np.array([[1.0, 0.0], [1.0, 0.0]]), np.array([0.5, 0.5]))
    x = [np.array([1, 1, 1]), np.array([0, 1, 0, 0])]
    for i, got in H.batch_matrices(m, x):
        assert got[4:] == pytest.approx(H.matrices(m, x[i])[4:])


def test_an_iteration_without_a_path_is_repeated(spark, monkeypatch):
    """Slices are drawn anew as long as a sequence has no path; without one at the end it keeps its labels, counted."""
    from pyspark.sql import functions as F
    from strandlab.operators import infinite as N

    seqs = spark.createDataFrame([(i, [(i + k) % 3 for k in range(12)]) for i in range(6)], "seq_id long, codes array<int>")
    real, seen = N._resampled, []

    def lossy(labels, trans, emit, seed, iteration, attempt=0):
        seen.append(attempt)
        return real(labels, trans, emit, seed, iteration, attempt).withColumn("lost", F.lit(attempt < most))

    monkeypatch.setattr(N, "_resampled", lossy)
    most = 2
    bag = N.start(seqs, 3, states=3).run(1)
    assert seen == [0, 1, 2] and bag.lost == 0 and bag.labels.columns == ["model", "seq_id", "codes", "labels", "weight"]
    most, seen[:] = 99, []
    bag = N.start(seqs, 3, states=3).run(1)
    assert seen == list(range(N.ATTEMPTS)) and bag.lost == 6


def test_guessed_labels_follow_the_guessed_model(spark):
    """The same labels at any partitioning, and the shares that the model's rule gives."""
    from collections import Counter

    from strandlab.operators import infinite as N

    rows = [(i, [(i * 7 + k * k) % 3 for k in range(40)]) for i in range(300)] + [(999, [])]
    df = spark.createDataFrame(rows, "seq_id long, codes array<int>")
    one = {r["seq_id"]: r["labels"] for r in N.guessed_labels(df, 5, 3, 1.0, 3).collect()}
    assert one == {r["seq_id"]: r["labels"] for r in N.guessed_labels(df.repartition(7), 5, 3, 1.0, 3).collect()}
    assert one[999] == [] and all(len(one[i]) == len(c) and set(one[i]) <= {2, 3, 4} for i, c in rows)
    t, e = N.guess_model(5, 3, 1.0, 3)
    steps = Counter((one[i][k - 1] - 2, c[k], one[i][k] - 2) for i, c in rows for k in range(1, len(c)))
    for a in range(3):
        for x in range(3):
            n = np.array([steps[a, x, b] for b in range(3)], dtype=float)
            if n.sum() > 400:
                assert n / n.sum() == pytest.approx(t[a] * e[:, x] / (t[a] @ e[:, x]), abs=0.08)
