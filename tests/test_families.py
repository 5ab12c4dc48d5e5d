"""Alignment of large families against the whole-table alignment of small ones."""

import random

import numpy as np
import pytest

from strandlab.operators import alignment as A
from strandlab.operators import families as Q


def cost(p, q, steps):
    pair = np.full((p.shape[1],) * 2, A.MISMATCH)
    np.fill_diagonal(pair, A.MATCH)
    score, i, j, last = 0.0, 0, 0, Q.PAIR
    for s in steps:
        score += p[i] @ pair @ q[j] if s == Q.PAIR else (A.EXTEND if s == last else A.OPEN)
        i, j, last = i + (s != Q.Y), j + (s != Q.X), s
    assert (i, j) == (len(p), len(q))
    return score


@pytest.mark.parametrize("cells", [1, 30, 10**9])
def test_divided_alignment_scores_as_the_whole_one(cells):
    r = np.random.default_rng(1)
    for n, m in ((0, 4), (5, 0), (1, 1), (7, 9), (30, 12), (25, 60), (64, 64)):
        p, q = (r.dirichlet(np.full(4, 0.3), k).reshape(-1, 4) for k in (n, m))
        if n > 20 and m > 20:
            q[3:20] = p[5:22]
        whole, parts = Q.profile_steps(p, q, 10**9), Q.profile_steps(p, q, cells)
        assert cost(p, q, parts) == pytest.approx(cost(p, q, whole))


def test_divided_alignment_is_that_of_the_plain_form():
    r = random.Random(2)
    for _ in range(40):
        x, y = ("".join(r.choices("ACGT", k=r.randrange(1, 25))) for _ in range(2))
        a, b = A.align_profiles([x], [y])
        steps = [Q.PAIR if "-" not in (c, d) else Q.X if d == "-" else Q.Y for c, d in zip(a[0], b[0], strict=True)]
        p, q = (np.eye(4)[["ACGT".index(c) for c in s]] for s in (x, y))
        assert cost(p, q, Q.profile_steps(p, q, 1)) == pytest.approx(cost(p, q, steps))


def test_tree_levels_wait_for_their_parts():
    merges = A.average_linkage(np.array([[0, 1, 8, 8, 9], [1, 0, 8, 8, 9], [8, 8, 0, 2, 9], [8, 8, 2, 0, 9], [9, 9, 9, 9, 0.0]]))
    assert Q.tree_levels(merges, 5) == [[(5, 0, 1), (6, 2, 3)], [(7, 5, 6)], [(8, 4, 7)]]


def test_a_family_is_aligned_as_by_the_plain_form(spark):
    """Sequences of unequal lengths, one of them repeated and one empty; what was planted stands in the same columns."""
    r = random.Random(3)
    core = "".join(r.choices("ACGT", k=60))
    seqs = [(i, core[: r.randrange(40, 60)] if i % 3 else core[:20] + "ACG" * (i % 2) + core[20:]) for i in range(14)] + [(99, core), (99, core), (100, "")]
    got = sorted((x["seq_id"], x["aligned"]) for x in Q.align_family(spark.createDataFrame(seqs, "seq_id long, seq string").repartition(4), "ACGT").collect())
    assert len({len(a) for _, a in got}) == 1 and [(i, a.replace("-", "")) for i, a in got] == sorted(seqs)
    assert np.allclose(Q.family_distances(spark, [s for _, s in sorted(seqs)]), A.tuple_distances([s for _, s in sorted(seqs)]))
    rows = [a for i, a in got if i != 100]
    width = len(rows[0])
    assert width <= 75 and sum(len({a[j] for a in rows} - {"-"}) == 1 for j in range(width)) > 45


def test_small_families(spark):
    kind = "seq_id long, seq string"
    assert Q.align_family(spark.createDataFrame([], kind), "ACGT").collect() == []
    assert [tuple(x) for x in Q.align_family(spark.createDataFrame([(4, "ACG")], kind), "ACGT").collect()] == [(4, "ACG")]
    with pytest.raises(ValueError):
        Q.align_family(spark.createDataFrame([(1, "A"), (2, "C")], kind), "ACGT", most=1)
