"""Pruning and distances over tasks, and greedy bins, against the rules applied one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandlab.operators import context as P
from strandlab.operators import graphs as G


def graph(seed, n=7, share=0.8):
    r = random.Random(seed)
    return [(a, b, round(r.uniform(0.02, 0.9), 6)) for a in range(n) for b in range(n) if r.random() < share or b == (a + 1) % n]


def frame(spark, rows):
    return spark.createDataFrame(rows, "from_state int, to_state int, p double").repartition(3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pruning_over_tasks_equals_the_plain_rule(spark, seed):
    rows = graph(seed)
    assert sorted(G.prune_weakest(frame(spark, rows), 0.6)) == sorted(G.prune(rows, 0.6))
    assert sorted(G.prune_weakest(frame(spark, rows), 0.9, batch=4)) == sorted(G.prune(rows, 0.9))
    assert sorted(G.prune_least(frame(spark, rows), 0.4)) == sorted(G.prune(rows, 0.4, brute=True))


def test_pruning_never_cuts_the_last_path(spark):
    ring = [(a, (a + 1) % 5, 0.5) for a in range(5)] + [(0, 2, 0.1)]
    assert sorted(G.prune_weakest(frame(spark, ring), 1.0)) == sorted(G.prune_least(frame(spark, ring), 1.0)) == ring[:5]


def test_distances_of_all_pairs(spark):
    rows = graph(4, share=0.2) + [(9, 0, 0.3)]
    got = {(r["a"], r["b"]): r["distance"] for r in G.pair_distances(frame(spark, rows)).collect()}
    for a in {x for e in rows for x in e[:2]}:
        d, _ = G.dijkstra([(x, y, -math.log(p)) for x, y, p in rows], a)
        assert all(v == pytest.approx(d.get(b, math.inf)) for (s, b), v in got.items() if s == a)
    assert got[0, 9] == math.inf


def plain_bins(lengths, items, width):
    bins = []
    for length in sorted(set(lengths)):
        n = lengths.count(length)
        if not bins or (bins[-1][2] > items and bins[-1][1] - bins[-1][0] >= width):
            bins.append([length, length, 0])
        bins[-1][1], bins[-1][2] = length, bins[-1][2] + n
    if len(bins) > 1 and bins[-1][2] <= items:
        last = bins.pop()
        bins[-1][1], bins[-1][2] = last[1], bins[-1][2] + last[2]
    return [(i, *b) for i, b in enumerate(bins)]


@pytest.mark.parametrize(("items", "width", "most"), [(5, 2, 60), (1, 0, 20), (3, 10, 90), (500, 2, 50), (0, 1, 12)])
def test_greedy_bins_equal_the_sequential_rule(spark, items, width, most):
    r = random.Random(items)
    lengths = [r.randrange(most) for _ in range(150)]
    df = spark.createDataFrame([(x,) for x in lengths], "len long").repartition(4)
    assert sorted(map(tuple, P.greedy_bins(df, items, width).collect())) == plain_bins(lengths, items, width)


def test_bins_of_nothing(spark):
    assert P.greedy_bins(spark.createDataFrame([], "len long")).collect() == []
    assert [tuple(r) for r in P.greedy_bins(spark.range(3).select(F.lit(7).alias("len"))).collect()] == [(0, 7, 7, 3)]
