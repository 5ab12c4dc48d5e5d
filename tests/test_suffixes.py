"""Suffix index, probes and windows against plain versions."""

import random

import pytest

from strandlab.operators import motifs as O
from strandlab.operators import suffixes as X


def world(seed, n=12, letters=3, most=18):
    r = random.Random(seed)
    seqs = {i: [r.randrange(1, 1 + letters) for _ in range(r.randrange(1, most))] for i in range(n)}
    seqs[n] = list(seqs[0])  # equal sequences
    seqs[n + 1] = [1] * 15
    seqs[n + 2] = [1] * 9 + [40_000]
    return seqs


def labels(spark, seqs):
    rows = [(i, k, s) for i, x in seqs.items() for k, s in enumerate(x)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "seq_id long, pos long, state int").repartition(3)


def order(seqs):
    return sorted(((x[k:], i, k) for i, x in seqs.items() for k in range(len(x))))


@pytest.mark.parametrize("width", [2, 8])
def test_probes_equal_a_search_of_all_suffixes(spark, width):
    seqs = world(1)
    index = X.save_and_load(X.build(labels(spark, seqs), width=width, block=5, parts=4), spark)
    every = order(seqs)
    places = [tuple(r) for r in index.places.orderBy("place").select("seq_id", "pos").collect()]
    assert places == [(i, k) for _, i, k in every]
    r = random.Random(2)
    patterns = [x[k : k + n] for x in seqs.values() for n in (1, 2, 3, 4, 5, 9, 15) for k in [r.randrange(len(x))]]
    patterns += [[r.randrange(0, 5) for _ in range(n)] for n in range(1, 9)] + [[1] * 15, [1] * 16, [0], [9], [1] * 9 + [40_000], [65_535]]
    found = X.probe(index, spark.createDataFrame([(p,) for p in patterns], "pattern array<int>"))
    got = {tuple(x["pattern"]): (x["low"], x["high"]) for x in found.collect()}
    want = {tuple(p): (sum(s[: len(p)] < p for s, _, _ in every), sum(s[: len(p)] <= p for s, _, _ in every)) for p in patterns if p}
    assert got == want
    at = sorted((tuple(x["pattern"]), x["seq_id"], x["pos"]) for x in X.occurrences(index, found).collect())
    assert at == sorted((p, i, k) for p in want for s, i, k in every if s[: len(p)] == list(p))


def test_equal_rows_over_many_blocks_in_any_order_of_bounds(spark):
    """Suffixes that end within a key have equal rows; they fill several blocks, whose bounds come in any order."""
    seqs = {i: [1 + i % 2, 1] for i in range(60)}
    index = X.build(labels(spark, seqs), block=3, parts=2)
    every = order(seqs)
    bounds = index.bounds.toPandas()
    for falling in (True, False):
        index.bounds = spark.createDataFrame(bounds.sort_values("block", ascending=not falling)).coalesce(1)
        for p in ([1], [1, 1], [2], [2, 1], [2, 2]):
            got = X.probe(index, spark.createDataFrame([(p,)], "pattern array<int>")).first()
            assert (got["low"], got["high"]) == (sum(s[: len(p)] < p for s, _, _ in every), sum(s[: len(p)] <= p for s, _, _ in every))


def test_an_empty_index_has_no_places(spark):
    index = X.build(spark.createDataFrame([], "seq_id long, pos long, state int"))
    got = X.probe(index, spark.createDataFrame([([1, 2],)], "pattern array<int>")).collect()
    assert [(r["low"], r["high"]) for r in got] == [(0, 0)]


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("width", [2, 8])
def test_prefixes_with_the_suffix_before(spark, width):
    seqs = world(3)
    every = order(seqs)
    got = [tuple(r) for r in X.with_prefixes(labels(spark, seqs), width).orderBy("place").select("place", "seq_id", "pos", "left", "lcp").collect()]
    want = [(p, i, k, len(s), common(every[p - 1][0], s) if p else 0) for p, (s, i, k) in enumerate(every)]
    assert got == want


def plain_windows(every, least, at):
    """place -> the longest prefix of the suffix that `least` sequences among those up to it share, of suffixes of `at`."""
    kept = [(p, s, i) for p, (s, i, _) in enumerate(every) if len(s) >= at]
    out = {}
    for n, (p, s, _) in enumerate(kept):
        seen, share = set(), 1 << 30
        for q, t, i in reversed(kept[: n + 1]):
            share = min(share, common(s, t)) if q != p else share
            seen.add(i)
            if len(seen) == least:
                out[p] = share
                break
    return out


@pytest.mark.parametrize(("least", "at", "parts"), [(2, 0, 1), (2, 0, 7), (3, 0, 60), (5, 2, 7), (3, 4, 13), (1, 0, 5), (40, 0, 3)])
def test_windows_across_parts(spark, least, at, parts):
    seqs = world(4)
    rows = X.with_prefixes(labels(spark, seqs))
    from pyspark.sql import functions as F

    got = X.windows(X.dealt(rows.withColumn("cap", F.col("left")), parts), least, at).collect()
    assert {r["place"]: r["shared"] for r in got} == plain_windows(order(seqs), least, at)


def test_common_prefixes_are_those_of_the_windows(spark):
    seqs = world(5)
    every = order(seqs)
    want = {}
    for p, w in plain_windows(every, 3, 0).items():
        if w >= 2:
            n, first = want.get(tuple(every[p][0][:w]), (0, p))
            want[tuple(every[p][0][:w])] = (n + 1, min(first, p))
    got = {tuple(r["word"]): (r["n"], r["place"]) for r in X.common_prefixes(labels(spark, seqs), 3, 2).collect()}
    assert got == want and all(len(k) >= 2 for k in got)


def test_longest_common_word_without_marks(spark):
    r = random.Random(6)
    for least in (2, 4):
        seqs = [(i, "".join(r.choices("abc", k=14))) for i in range(8)] + [(8, ""), (9, "aaaaaaaa")]
        marked = [(i, "".join("#" if r.random() < 0.12 else c for c in s)) for i, s in seqs]
        kind = "seq_id long, seq string"
        prefixes = X.with_prefixes(X.letters(spark.createDataFrame(seqs, kind)))
        words = {}
        for i, s in marked:
            for a in range(len(s)):
                for b in range(a + 1, len(s) + 1):
                    if "#" not in s[a:b]:
                        words.setdefault(s[a:b], set()).add(i)
        want = max((len(w) for w, who in words.items() if len(who) >= least), default=0)
        assert X.longest_common(prefixes, spark.createDataFrame(marked, kind), least, 1) == want
    assert O.rounds_of_common(spark.createDataFrame([(1, "ab"), (2, "cd")], kind), 2, 2).collect() == []


@pytest.mark.parametrize("wide", [2, 5])
def test_an_index_of_sequences_longer_than_what_is_sorted_at_once(spark, wide):
    seqs = world(7)
    index = X.build(labels(spark, seqs), width=2, block=5, parts=4, wide=wide)
    every = order(seqs)
    assert [tuple(r) for r in index.places.orderBy("place").select("seq_id", "pos").collect()] == [(i, k) for _, i, k in every]


def test_suffixes_are_sorted_once(spark, monkeypatch):
    """Sequences of at most WIDE labels: no rank is refined, nothing is written but the suffixes and their ranges."""
    monkeypatch.setattr(X, "_refined", None)
    seen = []
    monkeypatch.setattr(X, "written", lambda df, label, w=X.written: (seen.append(label), w(df, label))[1])
    rows = labels(spark, {i: [1 + i % 2, 2, 1] * 30 for i in range(5)})
    got = O.suffix_order(rows.selectExpr("seq_id AS user_id", "pos", "100 * seq_id + pos AS event_id", "state"))
    assert got.count() == 450 and seen == ["suffixes", "ranges"]
