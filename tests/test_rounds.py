"""Rounds of common substrings and how far suffixes reach, against plain versions."""

import random

import pytest

from strandlab.operators import motifs as O
from strandlab.operators import rounds as R
from strandlab.operators import suffixes as X


def plain(seqs, shortest, least):
    """(word, n, n_seq, round) of all rounds."""
    gone, out, turn = [[False] * len(x) for x in seqs], set(), 0
    for k in range(max(map(len, seqs), default=0), shortest - 1, -1):
        places = [[(x[i : i + k], i) for i in range(len(x) - k + 1) if not any(g[i : i + k])] for x, g in zip(seqs, gone)]
        n = {w: [v for p in places for v, _ in p].count(w) for w in {v for p in places for v, _ in p}}
        n_seq = {w: sum(any(v == w for v, _ in p) for p in places) for w in n}
        found = {w for w in n if n_seq[w] >= least}
        out |= {(w, n[w], n_seq[w], turn) for w in found}
        turn += bool(found)
        for p, g in zip(places, gone):
            for w, i in p:
                if w in found:
                    g[i : i + k] = [True] * k
    return out


def world(seed, longest):
    """Texts with equal ones, near ones, empty ones and letters beyond ASCII."""
    r = random.Random(seed)
    base = ["".join(r.choices("abé", k=r.randrange(1, longest))) for _ in range(5)]
    near = ["".join(r.choice("ab") if r.random() < 0.1 else c for c in r.choice(base)) for _ in range(12)]
    return [*base, *base, *near, "", "", "a" * longest]


def rounds(spark, seqs, *given):
    rows = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    return {tuple(x) for x in O.rounds_of_common(rows, *given).select("kmer", "n", "n_seq", "round").collect()}


def test_all_lengths_in_one_task(spark):
    seqs = world(1, 30)
    want = plain(seqs, 2, 3)
    assert rounds(spark, seqs, 2, 3) == want and max(x[3] for x in want) > 3
    assert rounds(spark, seqs, 2, 3, 2) == {x for x in want if x[3] < 2}


@pytest.mark.parametrize("letters", [0, 40])
def test_lengths_over_tasks(spark, monkeypatch, letters):
    """Rows of more letters than a task takes: a length a step, with the same words; tables of steps are joined in between."""
    monkeypatch.setattr(R, "LETTERS", letters)
    monkeypatch.setattr(O, "STEPS", 2)
    seqs = world(2, 7)
    want = plain(seqs, 2, 3)
    assert rounds(spark, seqs, 2, 3) == want and max(x[3] for x in want) > 1


def test_rounds_cost_no_jobs_each(spark):
    """Twenty rounds are one step; before, each took some dozens of jobs, whose tasks the driver remembers."""
    r = random.Random(3)
    seqs = ["".join(r.choices("abcdefgh", k=n)) for n in range(12, 32)] * 2
    spark.sparkContext.setJobGroup("rounds", "rounds")
    try:
        assert len({x[3] for x in rounds(spark, seqs, 8, 2)}) == 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) < 60


def test_places_of_a_compressed_text_are_not_broadcast(spark):
    """Texts take few bytes, their places many: Spark would send them to the driver for a broadcast."""
    rows = spark.createDataFrame([(1, 2, "abab", [2, 1, 2, 1], 2)], R.ROW)
    step = R.over_tasks(rows, 2, 1, 1)
    assert "Broadcast" not in step._jdf.queryExecution().executedPlan().toString()
    assert sorted((x["kmer"], x["n"], x["n_seq"]) for x in step.where("kmer IS NOT NULL").collect()) == [("ab", 4, 2)]


@pytest.mark.parametrize(("least", "parts"), [(3, 1), (3, 9), (6, 4), (1, 3), (99, 2)])
def test_reach_across_parts(spark, least, parts):
    r = random.Random(4)
    weights = {i: r.choice([1, 1, 2, 5]) for i in range(9)}
    seqs = {i: "".join(r.choices("ab", k=r.randrange(1, 14))) for i in weights}
    texts = spark.createDataFrame([(i, s, weights[i]) for i, s in seqs.items()], "seq_id long, seq string, w long")
    rows = X.with_before(X.in_order(X.letters(texts)))
    assert rows.count() == sum(map(len, seqs.values()))
    got = {(x["seq_id"], x["pos"]): x["reach"] for x in X.reach(rows, least, parts).collect()}
    has = lambda w: sum(weights[i] for i, s in seqs.items() if w in s)
    assert got == {(i, k): max((n for n in range(1, len(s) - k + 1) if has(s[k : k + n]) >= least), default=0) for i, s in seqs.items() for k in range(len(s))}


def test_ranks_of_long_sequences_are_not_broadcast(spark):
    """Tables of ranks have small files, so Spark would send all their rows to the driver."""
    seqs = spark.createDataFrame([(i, "ab" * 5) for i in range(3)], "seq_id long, seq string")
    order = X.in_order(X.letters(seqs), 2)
    assert order.levels and "Broadcast" not in X.with_before(order)._jdf.queryExecution().executedPlan().toString()
