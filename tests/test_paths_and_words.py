"""Packed words, context models by join, label-path motifs, searches with trained models, FASTQ by ranges."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlab.operators import counting as C
from strandlab.operators import familysearch as X
from strandlab.operators import merging as G
from strandlab.operators import motifs as M
from strandlab.operators import paths as W
from strandlab.operators import suffixtree as T
from strandlab.sources import files


def test_words_of_all_lengths_as_integers(spark):
    r = random.Random(1)
    seqs = ["".join(r.choices("abz", k=n)) for n in (0, 1, 2, 11, 12, 13, 40, 40)] + ["a" * 30, None]
    rows = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(3)
    want = Counter()
    for s in filter(None, seqs):
        for k in range(1, 13):
            for i in range(len(s) - k + 1):
                code = 0
                for c in s[i : i + k]:
                    code = code * 32 + "abcdefghijklmnopqrstuvwxyz".index(c)
                want[k, code] += 1
    assert {(x["k"], x["code"]): x["n"] for x in C.packed_counts(rows).collect()} == want
    few = {(x["k"], x["code"]): x["n"] for x in C.packed_counts(rows, 3, "zab").select("k", "code", "n").collect()}
    assert sum(few.values()) == sum(n for (k, _), n in want.items() if k <= 3) and few[1, 0] == want[1, 25]
    plan = C.packed_counts(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        C.packed_counts(rows, 13)


@pytest.mark.parametrize("least", [1, 2.5, 6])
def test_words_with_a_frequent_beginning(spark, least):
    r = random.Random(9)
    seqs = ["".join(r.choices("abd", weights=(6, 3, 1), k=n)) for n in (0, 1, 3, 4, 5, 12, 60, 60)] + ["abdabdabdabd" * 2, None]
    got = {(x["k"], x["code"]): x["n"] for x in T.frequent_words(spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(3), 12, "abd", least).collect()}
    every = Counter(s[i : i + k] for s in filter(None, seqs) for k in range(1, 13) for i in range(len(s) - k + 1))
    code = lambda w: int("".join(f"{'abd'.index(c):05b}" for c in w), 2)
    assert got == {(len(w), code(w)): n for w, n in every.items() if len(w) <= T.SHORT + 1 or every[w[:-1]] > least}


def test_a_deep_model_shuffles_no_words_but_frequent_ones(spark, monkeypatch):
    """Nothing is written a place of the sequences: the table of words is as small as the model."""
    rows = []
    monkeypatch.setattr(T, "written", lambda df, label, w=T.written: (out := w(df, label), rows.append((label, out.count())))[0])
    r = random.Random(4)
    T.grow(spark.createDataFrame([(i, "".join(r.choices("abcdefghijklmnop", k=400))) for i in range(20)], "seq_id long, seq string"))
    assert dict(rows)["words"] < 2 * 8000


def test_scores_by_join_equal_those_of_the_broadcast(spark):
    r = random.Random(2)
    own = [(i, ("abcacbab" * 9)[i % 5 : 40 + i % 7] if i % 3 else "".join(r.choices("abc", k=30))) for i in range(30)]
    tree = T.grow(spark.createDataFrame(own, "seq_id long, seq string"), "abcd")
    assert len(tree.size) > 3
    probe = spark.createDataFrame([*own, (90, ""), (91, "d"), (92, "dddabc"), (93, "abcdabc"), (93, "cab"), (94, None)], "seq_id long, seq string")
    both = [sorted((x["seq_id"], x["len"], round(x["score"], 9)) for x in T.score(probe, tree, most).collect()) for most in (T.BROADCAST_BYTES, 0)]
    assert both[0] == both[1] and len(both[0]) == 35


def test_a_model_of_nothing(spark):
    tree = T.grow(spark.createDataFrame([(1, "")], "seq_id long, seq string"), "abc")
    assert tree.size == [1] and T.score(spark.createDataFrame([(1, "abc")], "seq_id long, seq string"), tree).first()["score"] == 0.0


def planted(spark):
    """Sequences with a long path in most of them, so that discovery has something to find."""
    r = random.Random(3)
    path = [2, 4, 6, 3, 5, 2, 6, 4, 3, 2]
    rows = []
    for i in range(60):
        x = [r.randrange(2, 7) for _ in range(40)]
        if i % 4:
            x[5:5] = path
        rows.append((i, x, [s * 3 % 10 for s in x]))
    return path, rows, spark.createDataFrame(rows, "seq_id long, x array<int>, y array<int>")


def test_discovery_finds_what_was_planted(spark):
    path, rows, states = planted(spark)
    got = {tuple(r["path"]): (r["n"], r["n_seq"]) for r in W.discovered(states).collect()}
    assert tuple(path) in got and all(8 <= len(p) <= 15 for p in got)
    for p, (n, n_seq) in got.items():
        at = [[x[k : k + len(p)] == list(p) for k in range(len(x) - len(p) + 1)].count(True) for _, x, _ in rows]
        assert (sum(at), sum(map(bool, at))) == (n, n_seq) and n >= 60**0.5 and n_seq * n_seq / n >= 8


@pytest.mark.parametrize("most", [W.AUTOMATON, 0])
def test_hits_of_unequal_lengths(spark, most):
    """By the automaton, and by the suffix index beyond its bound."""
    path, rows, states = planted(spark)
    paths = [path, path[2:5], path[4:], [2], [3, 3], [40, 41], path[:9]]
    got = sorted((tuple(r["path"]), r["seq_id"], r["pos"]) for r in W.path_hits(states, spark.createDataFrame([(p,) for p in paths + [path]], "path array<int>"), most).collect())
    assert got == sorted((tuple(p), i, k) for p in paths for i, x, _ in rows for k in range(len(x) - len(p) + 1) if x[k : k + len(p)] == p)
    counts = W.path_matrix(states, W.path_hits(states, spark.createDataFrame([(path,)], "path array<int>")), "y")
    m = W.matrices(counts, 10)[".".join(map(str, path))]
    assert m.sum(axis=1).tolist() == [45.0] * len(path) and [int(v) for v in m.argmax(axis=1)] == [s * 3 % 10 for s in path]


def motifs(n, seed=4):
    """Noisy copies of a few columns, shifted, and unrelated ones."""
    r = np.random.default_rng(seed)
    base = [r.dirichlet(np.full(5, 0.15), 12) for _ in range(2)]
    out = {}
    for i in range(n):
        a = int(r.integers(0, 4))
        p = base[i % 2][a : a + 8] if i < n - 2 else r.dirichlet(np.full(5, 5.0), 9)
        out[f"m{i}"] = np.array([r.multinomial(60, row / row.sum()) for row in p]).astype(float)
    return out


def test_merges_over_tasks_are_the_same_at_any_partitioning(spark, monkeypatch):
    from strandlab.operators import motifs as M

    some = motifs(8)
    one, shifts = W.merge_over_tasks(spark, some, shuffles=1000)
    ranges = type(spark).range
    monkeypatch.setattr(type(spark), "range", lambda self, a, b, s, n: ranges(self, a, b, s, 3))
    two, again = W.merge_over_tasks(spark, some, shuffles=1000)
    assert shifts == again and all(np.array_equal(one[k], two[k]) for k in one)
    assert 2 <= len(one) < 8 and sum(len(v) for v in shifts.values()) == 8
    for name, own in shifts.items():
        total = np.zeros_like(one[name])
        for m, at in own.items():
            total[at : at + len(some[m])] += some[m]
        assert np.array_equal(total, one[name])
    sides = [{int(m[1:]) % 2 for m in own if int(m[1:]) < 6} for own in shifts.values()]
    assert all(len(s) <= 1 for s in sides)  # the two bases stay apart
    p, q = W._shares(some["m0"]), W._shares(some["m2"])
    cost = M.best_offset(p, q, 6)[0]
    plain = sum(M.best_offset(rng.permuted(p[rng.permutation(len(p))], axis=1), q, 6)[0] < cost for k in range(5) for rng in [np.random.default_rng([1, k])] for _ in range(W.DEALT))
    assert W.shuffles_better(spark, p, q, (1,), 500, 10_000) == plain


def test_search_finds_the_family_it_was_trained_on(spark, tmp_path):
    """Training sequences score above random ones of their letters; hits of the database are the family's, and what the
    hit list says of E is P times the database's size."""
    r = random.Random(7)
    word = lambda: r.choice(["acgta", "ttgac", "ggatc", "catgc"])
    own = lambda n: "".join(word() for _ in range(n))
    train = spark.createDataFrame([(i, own(20)) for i in range(60)], "seq_id long, seq string")
    rows = [(i, "".join(r.choices("acgt", k=r.randrange(60, 140)))) for i in range(1500)] + [(5000 + i, own(r.randrange(12, 28))) for i in range(12)]
    database = spark.createDataFrame(rows, "seq_id long, seq string").repartition(4)
    search = X.trained(train, "acgt", depth=4, states=4, iterations=3)
    mean = lambda df: df.agg(F.avg("score")).first()[0]
    assert mean(T.score(train, search.tree)) > mean(T.score(database.where("seq_id < 5000"), search.tree)) + 10
    passed = {x["seq_id"] for x in X.filtered(search, database).collect()}
    assert {5000 + i for i in range(12)} <= passed and len(passed) < 30
    files.write_hits(X.hits(search, database), f"file://{tmp_path}/hits")
    got = spark.read.csv(f"file://{tmp_path}/hits", header=True, inferSchema=True).collect()
    assert {x["Name"] for x in got} == passed
    assert all(x["e"] == pytest.approx(1512 * x["p_score"]) and x["e_bias"] == pytest.approx(1512 * x["p_score_bias"]) for x in got)


def test_refinement_over_tasks_equals_the_plain_one(spark):
    """The same frequencies and share as on one list of sequences, and an objective that never falls."""
    from strandlab.operators import motifs as M

    r = random.Random(11)
    texts = ["".join(r.choices("acgt", k=30)) for _ in range(40)]
    texts = [t[:9] + "acgtta"[: 6 - (i % 5 == 0)] + t[9:] if i % 2 else t for i, t in enumerate(texts)] + ["ac", ""]
    start = np.zeros((6, 4))
    for j, c in enumerate("acgtta"):
        start[j, "acgt".index(c)] = 5
    background = np.array([0.3, 0.2, 0.2, 0.3])
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string").repartition(4)
    p, share, path = M.refine_over_tasks(df, "acgt", start, background, rounds=12)
    codes = [np.array(["acgt".index(c) for c in t]) for t in texts]
    want, plain = M.refine(codes, start, background, rounds=12)
    assert p == pytest.approx(want, abs=1e-9) and share == pytest.approx(plain, abs=1e-12)
    assert all(b >= a - 1e-9 for a, b in zip(path, path[1:], strict=False)) and path[-1] > path[0]
    assert "".join("acgt"[k] for k in p.argmax(axis=1)) == "acgtta"


def test_fastq_over_byte_ranges(spark, tmp_path):
    """Records that are cut by ranges, quality lines that begin like headers, two files, carriage returns."""
    r = random.Random(9)
    want = []
    for f in range(2):
        lines = []
        for i in range(150):
            s = "".join(r.choices("ACGT", k=r.randrange(1, 60)))
            q = r.choice("@+I#") + "".join(r.choices("I@+#5", k=len(s) - 1))
            want.append((f"f{f}r{i} x", s, q))
            lines += [f"@f{f}r{i} x", s, "+", q]
        end = "\r\n" if f else "\n"
        (tmp_path / f"{f}.fq").write_bytes((end.join(lines) + end * (1 + f)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = files.read_fastq(spark, f"file://{tmp_path}/*.fq")
        got = sorted(tuple(x) for x in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(want)


def test_words_and_hits_are_counted_before_they_become_rows(spark):
    r = random.Random(12)
    seqs = [(i, "".join(r.choices("ab", k=n))) for i, n in enumerate((0, 3, 5, 6, 40, 300))] + [(9, None)]
    rows = spark.createDataFrame(seqs, "seq_id long, seq string").repartition(3)
    for k in (1, 5, 12):
        every = [(w, i) for i, s in seqs for w in (s[j : j + k] for j in range(len(s or "") - k + 1))]
        got = {x["w"]: (x["n"], x["n_seq"]) for x in T.word_counts(rows, k, "ab", by_sequence=True).select(T.spelled(F.lit(k), "ab").alias("w"), "n", "n_seq").collect()}
        assert got == {w: (n, len({i for x, i in every if x == w})) for w, n in Counter(w for w, _ in every).items()}
        assert {x["code"]: x["n"] for x in T.word_counts(rows, k, "ab").collect()}.values() and sum(n for n, _ in got.values()) == len(every)
    found = M.hits(rows, spark.createDataFrame([("aa",), ("abab",)], "motif string"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # no row a place of the sequences
    want = sorted((m, i, j, s[j : j + 5]) for i, s in seqs if s for m in ("aa", "abab") for j in range(len(s)) if s.startswith(m, j))
    assert sorted(tuple(x) for x in found.collect()) == want
    one, two = M.window_matrix(found), M.count_matrix(rows, found.drop("window"), 5)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


@pytest.mark.parametrize(("block", "places"), [(1 << 22, 1 << 23), (16, 20), (40, 5)])
def test_a_spectrum_sends_no_row_a_word(spark, monkeypatch, block, places):
    """Equal to counting every word, however ranges and blocks cut the places; what is shuffled is packed blocks."""
    from strandlab.operators import spectrum as Z

    r = random.Random(7)
    seqs = ["".join(r.choices("abz", weights=(6, 3, 1), k=n)) for n in (0, 1, 2, 3, 11, 12, 13, 16, 17, 60, 60)] + ["ab" * 30, "z" * 50, None]
    n = Counter(s[i : i + k] for s in filter(None, seqs) for k in range(1, 13) for i in range(len(s) - k + 1))
    want = {k: (len(x := [m for w, m in n.items() if len(w) == k]), sum(x), max(x), x.count(1), sum(m * m for m in x)) for k in range(1, 13)}
    rows = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(3)
    got = Z.word_spectrum(rows, block=block, places=places)
    assert {x["k"]: tuple(x)[1:] for x in got.collect()} == want
    assert "explode" not in got._jdf.queryExecution().executedPlan().toString().lower()
    with pytest.raises(ValueError):
        Z.word_spectrum(rows, 13)


def test_a_packed_block_is_smaller_than_its_words():
    from strandlab.operators import spectrum as Z

    r = random.Random(8)
    code, n = np.unique(Z.longest_words([bytes(r.choices(b"etaoinshr", k=400)) for _ in range(50)], 12, "abcdefghijklmnopqrstuvwxyz"), return_counts=True)
    held = Z.packed(code, n)
    back = Z.unpacked(len(code), held)
    assert (back[0] == code).all() and (back[1] == n).all() and len(held) < 8 * len(code)


def unequal(n, seed):
    """motifs() of 4 to 9 columns, every fifth one a copy of another."""
    r, some = np.random.default_rng(seed), list(motifs(n, seed).values())
    cut = [m[: int(r.integers(4, len(m) + 1))] for m in some]
    return {f"{i % 7}.{i}": cut[i - 5 if i % 5 == 4 and i > 5 else i].copy() for i in range(n)}


@pytest.mark.parametrize("kept", [1, 2, G.KEPT])
def test_the_chain_of_merges_is_that_of_all_pairs(monkeypatch, kept):
    """With copies, of which many pairs cost the same, and however few nearest ones are kept."""
    monkeypatch.setattr(G, "KEPT", kept)
    some = unequal(40, 3)
    stacks = G.stacked(list(some.values()))
    each = [G.nearest(stacks, [i]) for i in range(len(some))]
    chain = G.Chain(some, *(np.concatenate(x) for x in zip(*each, strict=True)))
    best = lambda a, b: M.best_offset(G.shares(now[a]), G.shares(now[b]), M.overlap_of(len(now[a]), len(now[b])))
    now = dict(some)
    costs = {(a, b): best(a, b)[0] for a in now for b in now if a < b}
    names = dict(enumerate(some))
    while len(now) > 1:
        _, a, b = min((c, *k) for k, c in costs.items())
        offset = best(a, b)[1]
        x, y, new, at = chain.step()
        assert (names[x], names[y], at) == (a, b, offset)
        names[new] = f"{a}+{b}"
        assert chain.sums[new] == zlib.crc32(names[new].encode())
        now[names[new]] = M.merge(now.pop(a), now.pop(b), offset)
        assert np.array_equal(chain.counts[new], now[names[new]])
        costs = {k: c for k, c in costs.items() if a not in k and b not in k}
        costs |= {k: best(*k)[0] for k in (tuple(sorted((o, names[new]))) for o in now if o != names[new])}


def test_a_merge_is_no_job_of_its_own(spark):
    """The merges and members are those of one pair after the other, in a few jobs for all of them."""
    some, shuffles, limit = unequal(48, 8), 200, 2
    spark.sparkContext.setJobGroup("merges", "merges")
    got, shifts = W.merge_over_tasks(spark, some, shuffles=shuffles)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("merges"))
    spark.sparkContext.setJobGroup("others", "others")
    merges = sum(len(v) - 1 for v in shifts.values())
    assert 20 < merges < len(some) - 1 and jobs < merges

    now, moved = dict(some), {m: {m: 0} for m in some}
    while True:
        best = {(a, b): M.best_offset(G.shares(now[a]), G.shares(now[b]), M.overlap_of(len(now[a]), len(now[b]))) for a in now for b in now if a < b}
        (cost, offset), a, b = min((c, *k) for k, c in best.items())
        p, q, better = G.shares(now[a]), G.shares(now[b]), 0
        for k in range(-(-shuffles // W.DEALT)):
            rng = np.random.default_rng([5, zlib.crc32(a.encode()), zlib.crc32(b.encode()), k])
            better += sum(M.best_offset(rng.permuted(p[rng.permutation(len(p))], axis=1), q, M.overlap_of(len(p), len(q)))[0] < cost for _ in range(W.DEALT))
        if better > limit:
            break
        low = min(0, offset)
        now[f"{a}+{b}"] = M.merge(now.pop(a), now.pop(b), offset)
        moved[f"{a}+{b}"] = {m: at - low for m, at in moved.pop(a).items()} | {m: at + offset - low for m, at in moved.pop(b).items()}
    assert list(got) == list(now) and shifts == moved and all(np.array_equal(got[k], now[k]) for k in now)


def test_one_motif_or_none_is_left_as_it_is(spark):
    one = motifs(3)["m0"]
    assert W.merge_over_tasks(spark, {}) == ({}, {})
    now, shifts = W.merge_over_tasks(spark, {"a": one})
    assert list(now) == ["a"] and shifts == {"a": {"a": 0}} and np.array_equal(now["a"], one)


def test_merged_hits_are_shuffled_without_their_names(spark, sf, monkeypatch):
    """A merged name is as long as those of all its members together."""
    from strandlab.plans import motifs as Q

    merged = lambda spark, motifs: (None, {"+".join(motifs): {m: i for i, m in enumerate(motifs)}})
    monkeypatch.setattr(W, "merge_over_tasks", merged)
    df = Q.motif_path_merge(spark, sf)
    assert df.columns == ["merged", "user_id", "pos"] and df.distinct().count() == df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and not re.search(r"hashpartitioning\([^)]*merged", plan)
