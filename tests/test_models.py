"""Properties of the models and operators that SQL can't check."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlab.functions import mathematics as M
from strandlab.functions import sequences as S
from strandlab.operators import alignment as A
from strandlab.operators import context as P
from strandlab.operators import graphs as G
from strandlab.operators import infinite as N
from strandlab.operators import information as I
from strandlab.operators import markov as H
from strandlab.operators import motifs as O
from strandlab.operators import simulate as X
from strandlab.sources import files

TOY = ["0123", "03123", "31230", "00312300", "000031230000", "031230001230"]
CODES = [np.array(list(map(int, s))) for s in TOY]


@pytest.mark.parametrize("multi", [True, False])
def test_forward_equals_backward(multi):
    m = H.toy_model()
    batch = H.forward(m, [*CODES, np.zeros(0, dtype=int)], multi)
    assert batch[-1] == -math.inf
    for x, f in zip(CODES, batch):
        _, _, _, _, a, b = H.matrices(m, x, multi)
        assert a == pytest.approx(b) == pytest.approx(f)


def test_forward_sums_all_paths():
    """Uni-hit total of a short sequence, by listing every path."""
    m, x = H.toy_model(), np.array([0, 1])
    stay, enter = 2 / 4, 2 / 20
    total = 0.0
    for a, b in itertools.combinations(range(3), 2):  # the model takes letters a .. b - 1
        inside = sum(enter * math.prod(m.odds[s, x[i]] for s, i in zip(p, range(a, b))) * math.prod(m.transition[s, t] for s, t in zip(p, p[1:])) for p in itertools.product(range(4), repeat=b - a))
        total += stay**a * (1 - stay) * inside * (stay ** (2 - b - 1) if b < 2 else 1) * (1 - stay)
    assert H.forward(m, [x], False)[0] == pytest.approx(math.log(total))


def test_posterior_path():
    m = H.toy_model()
    assert H.posterior_path(m, CODES[0]).tolist() == [5, 6, 7, 8]
    assert H.posterior_path(m, CODES[4]).tolist() == [0, 0, 0, 0, 0, 6, 7, 8, 3, 3, 3, 3]


def test_gumbel_fit_and_calibration():
    r = np.random.default_rng(1)
    mu, lam = H.fit_gumbel(5 - np.log(-np.log(r.random(50_000))) / 0.7)
    assert mu == pytest.approx(5, abs=0.05) and lam == pytest.approx(0.7, abs=0.02)
    m = H.calibrated(H.toy_model())
    x = list(np.random.default_rng(9).integers(0, 4, (2000, 100)))
    p = H.score_batch(m, H.bias_of(m), x)["p"]
    assert 0.0 <= p.min() and p.max() <= 1.0


def test_model_tables_round_trip(spark, tmp_path):
    m = H.calibrated(H.toy_model())
    m.save(spark, f"file://{tmp_path}/m")
    n = H.Model.load(spark, f"file://{tmp_path}/m")
    assert (m.transition == n.transition).all() and (m.emission == n.emission).all() and m.tau == n.tau


def test_upper_gamma():
    assert M.upper_gamma(0.5, 2.0) == pytest.approx(math.erfc(math.sqrt(2)))
    assert M.upper_gamma(1.0, 3.0) == pytest.approx(math.exp(-3)) and M.upper_gamma(3.0, 0.0) == 1


def test_forward_by_products_equals_forward_by_steps():
    r = np.random.default_rng(3)
    for model in (H.toy_model(), H.bias_of(H.toy_model()), H.Model(r.dirichlet(np.ones(5), 5), r.dirichlet(np.ones(20), 5), np.full(20, 0.05))):
        for multi in (True, False):
            x = [r.integers(0, model.emission.shape[1], n) for n in (0, 1, 2, 40, 511, 512, 513, 2051, 20_000)]
            steps = H._forward_steps(model, x[::-1], multi)[::-1]  # noqa: SLF001
            assert H.forward(model, x, multi)[1:] == pytest.approx(steps[1:], rel=1e-9) and H.forward(model, x, multi)[0] == -math.inf
            assert [H.forward_product(model, s, multi) for s in x[1:]] == pytest.approx(list(steps[1:]), rel=1e-9)


def test_groups_of_sequences_are_bounded(monkeypatch):
    """The score of a sequence doesn't depend on those beside it."""
    r, m = np.random.default_rng(4), H.toy_model()
    x = [r.integers(0, 4, int(n)) for n in r.integers(0, 300, 60)]
    one = H.forward(m, x)
    monkeypatch.setattr(H, "GROUP", 500)
    assert H.forward(m, x).tolist() == one.tolist()


def test_score_modes_agree(spark):
    r, m = np.random.default_rng(5), H.calibrated(H.toy_model())
    x = [r.integers(0, 4, 30).tolist() for _ in range(8)] + [[0, 1, 2, 3] * 5]
    got = H.score_modes(spark.createDataFrame(list(enumerate(x)), "seq_id long, codes array<int>"), m).orderBy("seq_id").toPandas()
    assert got.forward.to_numpy() == pytest.approx(got.backward.to_numpy())
    assert got.log_odds.to_numpy() == pytest.approx((got.forward - got.null).to_numpy() / math.log(2))
    assert got.log_odds.idxmax() == 8 == got.p.idxmin() and got.p.between(0, 1).all() and got.p_bias.between(0, 1).all()


def event_like(spark, n=12, length=30, seed=4):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, r.integers(0, 3, length).tolist()) for i in range(n)], "seq_id long, codes array<int>")


def test_infinite_model_is_reproducible(spark):
    seqs = event_like(spark)
    run = lambda parts: {x["seq_id"]: x["labels"] for x in N.train(seqs.repartition(parts), 3, 3, states=6)[0].collect()}
    one = run(1)
    assert one == run(5) and all(len(v) == 30 and min(v) >= 2 for v in one.values())
    _, s, model = N.train(seqs, 3, 2, states=6)
    assert s.beta.sum() == pytest.approx(1) and model.transition.sum(1) == pytest.approx(np.ones(model.states))


def test_run_goes_on_from_a_checkpoint(spark, tmp_path):
    """Three iterations, a checkpoint and two more are the same as five, weights and all."""
    from strandlab.sources import models

    seqs, path = event_like(spark), f"file://{tmp_path}/run"
    start = lambda: N.start(seqs, 3, states=6, models=2, competitive=True, inner=2)
    whole = start().run(5)
    part = start().run(2)
    models.checkpoint(part, path)
    part.run(1)
    models.checkpoint(part, path)
    again = models.resume(spark, path)
    assert again.iteration == 3 and models.resume(spark, path, 2).iteration == 2
    again.run(2)
    rows = lambda bag: sorted(map(str, bag.labels.collect()))
    assert rows(again) == rows(whole)
    for a, b in zip(again.states, whole.states):
        assert a.beta.tolist() == b.beta.tolist() and (a.alpha, a.gamma, a.iteration) == (b.alpha, b.gamma, b.iteration)


def test_models_compete_for_sequences(spark):
    """Two kinds of sequences: weights differ between the models and are 1 + models x a share."""
    rows = [(i, ([0, 1] * 20) if i % 2 else [2, 2, 3, 3] * 10) for i in range(16)]
    seqs = spark.createDataFrame(rows, "seq_id long, codes array<int>")
    bag = N.start(seqs, 4, states=6, models=2, competitive=True, inner=2).run(4)
    got = bag.labels.select("model", "seq_id", "weight").toPandas()
    total = got.groupby("seq_id").weight.sum()
    assert total.to_numpy() == pytest.approx(np.full(16, 4.0), abs=1e-4) and got.weight.between(1, 3).all() and got.weight.std() > 0
    plain = N.start(seqs, 4, states=6, models=2, inner=2).run(4)
    assert set(plain.labels.select("weight").toPandas().weight) == {1.0}
    models = bag.finite()
    fit = [sum(H.forward(m, [np.array(c) for _, c in rows])) for m in models]
    free = [m.states * (m.states - 1) + m.states * 3 for m in models]
    assert N.best(bag) == int(np.argmin([-2 * f + k * math.log(640) for f, k in zip(fit, free)]))


def test_table_counts():
    """Expected number of tables, term by term, also where the tail is drawn at once."""
    r = np.random.default_rng(6)
    for n, mass in ((50, 0.7), (40_000, 3.0)):
        want = (mass / (mass + np.arange(n))).sum()
        got = np.mean([N.table_count(n, mass, r) for _ in range(400)])
        assert got == pytest.approx(want, rel=0.04)


def test_ids_equal_in_their_low_bits_draw_differently():
    assert N.generator(1, 2, 0, 5).random() != N.generator(1, 2, 0, 5 + (1 << 40)).random()


def test_slices_keep_the_old_path():
    r = np.random.default_rng(5)
    t = r.random((5, 6))
    t[:, 0] = 0
    t /= t.sum(1, keepdims=True)
    e = r.random((5, 3))
    e /= e.sum(1, keepdims=True)
    e[:2] = 0
    labels, codes = r.integers(2, 5, 20), r.integers(0, 3, 20)
    u = N.slices(t, labels, N.generator(1, 2, 0, 3))
    path = [0, *labels, 1]
    assert (u <= [t[a, b] for a, b in zip(path, path[1:])]).all()
    new = N.resample(t, e, codes, u, r)
    full = [0, *new, 1]
    assert (np.array([t[a, b] for a, b in zip(full, full[1:])]) > u).all()


def test_resampling_is_fair():
    """Labels of a short sequence come as often as listing all paths above the slices says."""
    r = np.random.default_rng(7)
    t = np.array([[0, 0.1, 0.5, 0.3, 0.1], [0, 0, 0, 0, 0], [0, 0.3, 0.3, 0.3, 0.1], [0, 0.2, 0.5, 0.2, 0.1]])
    e = np.array([[0, 0], [0, 0], [0.8, 0.2], [0.3, 0.7]])
    codes, u = np.array([0, 1, 1]), np.array([0.2, 0.1, 0.25, 0.1])
    want = {p: math.prod(e[s, c] for s, c in zip(p, codes)) for p in itertools.product((2, 3), repeat=3) if all(t[a, b] > x for a, b, x in zip((0, *p), (*p, 1), u))}
    n = 20_000
    got = {}
    for _ in range(n):
        p = tuple(N.resample(t, e, codes, u, r).tolist())
        got[p] = got.get(p, 0) + 1
    assert set(got) <= set(want)
    for p, w in want.items():
        assert got.get(p, 0) / n == pytest.approx(w / sum(want.values()), abs=0.012)


@pytest.mark.parametrize(("states", "longest"), [(12, 90), (40, 30), (5, 1)])
def test_sequences_resampled_at_once_get_the_same_labels(states, longest, monkeypatch):
    """However many fit together; also those without a path above their slices."""
    r = np.random.default_rng(states)
    t = r.gamma(0.5, size=(states, states + 1)) + 1e-9
    t[:, 0] = t[1] = 0
    t[[0, *range(2, states)]] /= t[[0, *range(2, states)]].sum(1, keepdims=True)
    e = r.dirichlet(np.ones(5), states)
    e[:2] = 0
    size = [int(n) for n in r.integers(1, longest + 1, 80)]
    codes, old = [r.integers(0, 5, n) for n in size], [r.integers(2, states, n) for n in size]
    u = [N.slices(t, x, N.generator(1, 2, 0, i)) for i, x in enumerate(old)]
    u[3] = np.full(len(u[3]), 0.999)
    want = [N.resample(t, e, c, v, N.generator(1, 2, 0, i, 1)) for i, (c, v) in enumerate(zip(codes, u))]
    assert want[3] is None and sum(x is not None for x in want) > 40
    for held in (1, 20_000, 4_000_000):
        monkeypatch.setattr(N, "HELD", held)
        got = {}
        for some in N.together(size, states):
            draws = [N.generator(1, 2, 0, i, 1).random(size[i]) for i in some]
            got |= dict(zip(some, N.resample_many(t, e, [codes[i] for i in some], [u[i] for i in some], draws, N.falling(t))))
        assert sorted(got) == list(range(80))
        assert all((got[i] is None) == (x is None) and (x is None or (got[i] == x).all()) for i, x in enumerate(want))


def test_labels_of_many_sequences_are_dealt_over_all_cores(spark):
    rows = spark.createDataFrame([(i, [i % 3, 1]) for i in range(200)], "seq_id long, codes array<int>").coalesce(1)
    bag = N.start(rows, 3, states=5)
    assert len(bag.labels.inputFiles()) == 2 * spark.sparkContext.defaultParallelism


def test_sequences(spark):
    df = spark.createDataFrame([(1, "ACGTN"), (2, "AC-G.T"), (3, "")], "seq_id long, seq string")
    assert [r[0] for r in df.select(S.complement(S.complement("seq"))).collect()] == ["ACGTN", "AC-G.T", ""]
    assert [r[0] for r in df.select(S.unaligned(S.unaligned("seq"))).collect()] == ["ACGTN", "ACGT", ""]
    got = df.select("seq", S.resolved("seq", "s", F.col("seq_id")).alias("r")).collect()
    assert all(set(r["r"]) <= set("ACGT-.") and len(r["r"]) == len(r["seq"]) for r in got)
    assert df.select(S.kmers("seq", 2)).collect()[0][0] == ["AC", "CG", "GT", "TN"]


def test_files(spark, tmp_path):
    rows = [("a b", "ACGT" * 50, list(range(200))), ("c", "GG", [1, 10])]
    df = spark.createDataFrame(rows, "name string, seq string, labels array<int>")
    files.write_labelled(df, f"file://{tmp_path}/l")
    assert sorted(map(tuple, files.read_labelled(spark, f"file://{tmp_path}/l").collect())) == sorted(rows)
    (tmp_path / "x.fq").write_text("@r1\nACGT\n+\n@III\n@r2\nGG\n+\nII\n")
    assert [tuple(r) for r in files.read_fastq(spark, f"file://{tmp_path}/x.fq").collect()] == [("r1", "ACGT", "@III"), ("r2", "GG", "II")]
    (tmp_path / "x.fa").write_text(">s1\nAC-G\nT\n>s2\nGG\n")
    assert sorted(map(tuple, files.read_fasta(spark, f"file://{tmp_path}/x.fa").collect())) == [("s1", "ACGT"), ("s2", "GG")]


def test_context_model_prefers_its_own(spark):
    from strandlab.operators import suffixtree as T

    r = np.random.default_rng(7)
    own = ["".join("abc"[(i + k) % 3] for i in range(90)) for k in range(20)]
    other = ["".join(r.choice(list("abc"), 90)) for _ in range(20)]
    tree = T.grow(spark.createDataFrame(list(enumerate(own)), "seq_id long, seq string"), "abc", 2)
    assert T.node_table(spark, tree).where("context = '' AND abs(lod) > 1e-12").count() == 0
    both = spark.createDataFrame(list(enumerate(own + other)), "seq_id long, seq string")
    s = {x["seq_id"]: x["score"] for x in T.score(both, tree).collect()}
    assert min(s[i] for i in range(20)) > max(s[i] for i in range(20, 40))


def test_full_depth_contexts(spark):
    """Growth, scores and refits against the rule applied letter by letter, with contexts of more than two letters."""
    from strandlab.operators import suffixtree as T

    r = np.random.default_rng(3)
    texts = ["".join(("abcacbab" * 12)[i : i + 60]) if i % 3 else "".join(r.choice(list("abc"), 50)) for i in range(40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, ""])], "seq_id long, seq string")
    total = {k: sum(max(len(x) - k + 1, 0) for x in texts) for k in range(1, 13)}
    count = {k: {} for k in total}
    for x in texts:
        for k in total:
            for i in range(len(x) - k + 1):
                count[k][x[i : i + k]] = count[k].get(x[i : i + k], 0) + 1
    p_min = max(1e-5, *(2 / t for t in total.values()))
    bg = {c: count[1][c] / total[1] for c in "abc"}
    nodes, todo = {"": bg}, [""]
    while todo:
        s = todo.pop()
        for w in (c + s for c in "abc" if len(s) + 1 < 12):
            p_as = (count[len(w)].get(w, 0) + 1) / (total[len(w)] + 3)
            n = {c: count[len(w) + 1].get(w + c, 0) for c in "abc"}
            ask = {c: (n[c] + 1) / (total[len(w) + 1] + 3) for c in "abc"}
            if p_as > p_min and sum(n.values()) and sum(ask[c] * math.log(ask[c] / (nodes[s][c] * p_as)) for c in "abc") > p_min:
                nodes[w] = {c: 0.99 * n[c] / sum(n.values()) + 0.01 * bg[c] for c in "abc"}
                todo.append(w)
    tree = T.grow(df, "abc")
    got = {(x["context"], x["residue"]): x["p"] for x in T.node_table(spark, tree).collect()}
    assert max(map(len, nodes)) > 2 and set(got) == {(s, c) for s in nodes for c in "abc"}
    assert all(got[s, c] == pytest.approx(nodes[s][c]) for s, c in got)
    want = {}
    for i, x in enumerate([*texts, ""]):
        want[i] = 0.0
        for j, c in enumerate(x):
            k = 0
            while k < j and x[j - k - 1 : j] in nodes:
                k += 1
            want[i] += math.log(nodes[x[j - k : j]][c] / bg[c])
    assert {x["seq_id"]: x["score"] for x in T.score(df, tree).collect()} == pytest.approx(want)


def test_resumed_run_equals_the_whole(spark, sf):
    from strandlab.plans.registry import QUERIES

    rows = lambda name: sorted((r["seq_id"], r["labels"]) for r in QUERIES[name](spark, sf).collect())
    assert rows("ihmm_resume") == rows("ihmm_train")


def test_p_values_of_the_g_test(spark, sf):
    """One degree of freedom: the complementary error function."""
    from strandlab.plans.registry import QUERIES

    t = QUERIES["g_test_p_values"](spark, sf).toPandas()
    assert t.p.to_numpy() == pytest.approx([math.erfc(math.sqrt(g)) for g in t.g], abs=1e-9) and len(t) > 100


def test_decoded_events(spark, sf):
    from strandlab.plans.registry import QUERIES

    t = QUERIES["hmm_backward"](spark, sf).toPandas()
    s = QUERIES["sql_scores"](spark, sf).toPandas().set_index("seq_id")
    assert t.forward.to_numpy() == pytest.approx(t.backward.to_numpy()) and [list(x) for x in t.path] == [list(s.path[i]) for i in t.seq_id]


def test_search_scores_what_the_context_model_passes(spark, sf):
    from strandlab.plans.registry import QUERIES

    ids = lambda name: sorted(r["seq_id"] for r in QUERIES[name](spark, sf).select("seq_id").collect())
    assert ids("hmm_search") == ids("pst_deep_hits")


def test_calibration_refits_until_no_outlier_is_left(spark):
    """One outlier hides the next: more than two refits are needed."""
    from strandlab.operators import suffixtree as T

    r = np.random.default_rng(4)
    rows = [(i, 100 + i % 300, float(r.normal())) for i in range(4000)] + [(5000 + k, 250, 200.0 * 60**k) for k in range(4)]
    scores = spark.createDataFrame(rows, "seq_id long, len int, score double").withColumn("band", F.lit(0))
    assert T.calibrate(scores).first()["n"] == 4000 and P.calibrate(scores, 20.0, 2).first()["n"] > 4000


def test_orders_over_ranges(spark):
    from strandlab.operators import orders

    r = np.random.default_rng(8)
    rows = [(int(i), [None, "a", "b"][int(r.integers(3))], int(r.integers(0, 9))) for i in r.permutation(500)]
    df = spark.createDataFrame(rows, "i long, g string, v int").repartition(7)
    got = {x["i"]: x["place"] for x in orders.ranked(df, ["v", "i"], ["g"]).collect()}
    below = {x["i"]: x["below"] for x in orders.running(df, "v", [F.desc("i")]).collect()}
    for g in (None, "a", "b"):
        assert [got[i] for _, i in sorted((v, i) for i, h, v in rows if h == g)] == list(range(1, 1 + sum(h == g for _, h, _ in rows)))
    assert below == {i: sum(v for j, _, v in rows if j > i) for i, _, _ in rows}


def test_merged_motifs_keep_their_members_places():
    p = np.eye(4)[[0, 1, 2, 3, 0, 1, 2, 3]] * 50.0
    shifts = {}
    merged = O.merge_all({"a": p[2:], "b": p}, shuffles=100, shifts=shifts)
    assert list(merged) == list(shifts) == ["a+b"] and shifts["a+b"]["a"] - shifts["a+b"]["b"] == 2 and min(shifts["a+b"].values()) == 0


def test_best_alignment_of_motifs(spark):
    """Against the cost matrix, offset by offset."""
    r = np.random.default_rng(9)
    m = {k: r.dirichlet(np.full(4, 0.4), 8) for k in "abc"}
    rows = [(k, i, "ACGT"[j], float(v)) for k, p in m.items() for (i, j), v in np.ndenumerate(p)]
    got = {(x["a"], x["b"]): (x["cost"], x["offset"]) for x in O.best_alignments(spark.createDataFrame(rows, "motif string, place int, residue string, p double"), 8).collect()}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        cost, offset = O.best_offset(m[a], m[b], O.overlap_of(8, 8))
        assert got[a, b] == (pytest.approx(cost, abs=1e-8), offset)


def test_motif_of_an_alignment(spark):
    rows = [("x", 1, "AC-T"), ("x", 2, "ACGT"), ("x", 3, "AG-T")]
    got = {(r["place"], r["residue"]): (r["n"], r["p"]) for r in O.motif_of_alignment(spark.createDataFrame(rows, "grp string, seq_id long, aligned string"), "ACGT").collect()}
    bg = {"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3}
    assert got[0, "A"] == (3, pytest.approx((3 + 0.1 * bg["A"]) / 3.1)) and got[1, "C"][0] == 2 and got[2, "G"] == (1, pytest.approx(1.02 / 1.1)) and got[2, "A"][0] == 0


def test_generators(spark):
    from strandlab.operators import simulate as X

    u = X.uniform_draws(spark, 4000, 3, 10).toPandas()
    assert u.x.between(0, 1).all() and u.x.mean() == pytest.approx(0.5, abs=0.02) and sorted(set(u.k)) == list(range(10))
    for kind, parameters, mean in (("gamma", {"shape": 6.0, "scale": 0.5}, 3.0), ("beta", {"a": 2.0, "b": 3.0}, 0.4), ("binomial", {"n": 10, "p": 0.3}, 3.0), ("normal", {"loc": 1.0, "scale": 2.0}, 1.0)):
        x = X.draws(spark, kind, 2000, 1, **parameters).toPandas().x
        assert x.mean() == pytest.approx(mean, rel=0.1, abs=0.02)
    assert X.draws(spark.newSession(), "beta", 5, 1, a=2.0, b=3.0).collect() == X.draws(spark, "beta", 9, 1, a=2.0, b=3.0).where("id < 5").collect()


def test_posterior_mean_of_draws():
    """Draws' mean against the analytic one."""
    r = np.random.default_rng(2)
    t, e = r.integers(0, 40, (4, 4)).astype(float), r.integers(0, 40, (4, 3)).astype(float)
    a, b = (H.from_counts(t, e, np.full(3, 1 / 3), draws=n) for n in (20_000, 0))
    assert a.transition == pytest.approx(b.transition, abs=0.01) and a.emission == pytest.approx(b.emission, abs=0.01)


def test_stream_counts_what_it_scanned(spark, sf, tmp_path):
    """Two files, one a batch: hits of the first are for its records only."""
    from strandlab.operators import suffixtree as T
    from strandlab.plans import context as Q
    from strandlab.plans.sequences import seqs
    from strandlab.streaming import search as R

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for part in (0, 1):
        docs.where(F.col("doc_id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    tree = Q.tree(seqs(spark, sf))
    scored = T.score(seqs(spark, sf), tree).withColumn("band", P.band())
    fit = P.calibrate(scored, Q.OUTLIER, Q.ROUNDS)
    stream = R.stream_of(spark, f"{tmp_path}/docs", docs.schema, files_per_batch=1)
    hits = R.search_stream(stream, tree, fit, 0.5).toPandas()
    whole = T.search(seqs(spark, sf), tree, fit, 0.5).toPandas()
    assert sorted(hits.seq_id) == sorted(whole.seq_id) and set(hits.scanned) == {docs.count() // 2, docs.count()}
    assert hits.groupby("scanned").seq_id.agg(lambda x: x.mod(2).nunique()).eq(1).all()


def test_graphs():
    rows = [(0, 1, 30.0), (0, 2, 9.0), (0, 5, 14.0), (1, 2, 10.0), (1, 3, 15.0), (2, 3, 11.0), (2, 5, 2.0), (3, 4, 6.0), (4, 5, 9.0)]
    d, before = G.dijkstra(rows, 0)
    assert d == {0: 0, 1: 30, 2: 9, 3: 20, 4: 26, 5: 11} and G.path_to(before, 4) == [0, 2, 3, 4]
    full = [(a, b, 0.1 + 0.01 * a + 0.03 * b) for a in range(4) for b in range(4) if a != b]
    for brute in (False, True):
        kept = G.prune(full, 0.5, brute)
        assert len(kept) < len(full) and G.connectivity([(a, b, 1.0) for a, b, _ in kept]) < math.inf


def test_alignment():
    rows = A.align(["ACGTACGT", "ACGACGT", "ACGTACG", "TTTT"])
    assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == ["ACGTACGT", "ACGACGT", "ACGTACG", "TTTT"]
    x, y = A.align_profiles(["ACGT"], ["AGT"])
    assert x == ["ACGT"] and y == ["A-GT"]


def test_motifs():
    p = np.eye(4)[[0, 1, 2, 3, 0, 1, 2, 3]] * 0.97 + 0.0075
    assert O.best_offset(p, p, 6) == (pytest.approx(0, abs=1e-9), 0)
    assert O.best_offset(p, p[1:], 6)[1] == 1
    assert O.merge(np.ones((3, 4)), np.ones((3, 4)), 1).sum(1).tolist() == [4, 8, 8, 4]
    merged = O.merge_all({"a": p * 50, "b": p * 30}, shuffles=100)
    assert list(merged) == ["a+b"]
    assert O.agreement([(0, 5), (1, 7)], [(0, 6), (2, 7)], 1) == 0.5
    assert O.segments(np.array([0, 0, 9, 9, 9, 9, 0, 0.0]), 3, 1.5)


def test_rounds_of_common_substrings(spark):
    """Against brute force: more than twelve motifs, some longer than six letters."""
    r = np.random.default_rng(2)
    rows = [(i, "".join(r.choice(list("abcd"), 14)) + ("dcbaabcdab" if i % 2 else "") + "".join(r.choice(list("abcd"), 6))) for i in range(30)]
    got = {(x["kmer"], x["n"], x["n_seq"], x["round"]) for x in O.rounds_of_common(spark.createDataFrame(rows, "seq_id long, seq string"), 2, 12).collect()}
    now, want, turn = [x for _, x in rows], set(), 0
    for k in range(max(map(len, now)), 1, -1):
        places = [[(x[i : i + k], i) for i in range(len(x) - k + 1) if "#" not in x[i : i + k]] for x in now]
        found = {w: (sum(w == v for p in places for v, _ in p), sum(any(w == v for v, _ in p) for p in places)) for w in {v for p in places for v, _ in p}}
        found = {w: c for w, c in found.items() if c[1] >= 12}
        want |= {(w, *c, turn) for w, c in found.items()}
        turn += bool(found)
        now = ["".join("#" if any(v in found and i <= j < i + k for v, i in p) else c for j, c in enumerate(x)) for x, p in zip(now, places)]
    assert got == want and len(want) > 12 and max(len(x[0]) for x in want) > 6


def test_whole_suffixes_in_order(spark):
    """Against brute force: common prefixes of more than six labels, equal suffixes, prefixes of each other."""
    r = np.random.default_rng(1)
    users = [[2, 3] * 10, [2, 3] * 10, [3, 2] * 6 + [4], [2] * 17, r.integers(2, 5, 30).tolist(), [4]]
    rows = [(u, i, 100 * i + u, s) for u, x in enumerate(users) for i, s in enumerate(x)]
    got = sorted(tuple(x) for x in O.suffix_order(spark.createDataFrame(rows, "user_id long, pos long, event_id long, state int")).select("place", "event_id", "before", "lcp").collect())
    order = sorted((users[u][i:], e) for u, i, e, _ in rows)
    prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = [(k, e, order[k - 1][1] if k else None, prefix(order[k - 1][0], x) if k else 0) for k, (x, e) in enumerate(order)]
    assert got == want and max(x[3] for x in want) > 6


def test_motifs_of_different_initials_merge(spark, monkeypatch):
    from strandlab.plans import motifs as Q

    rows = [(m, i, "abcdefgh"[i], 50) for m in ("abcde", "bcdea") for i in range(8)]
    monkeypatch.setattr(Q, "matrix", lambda spark, d: spark.createDataFrame(rows, "motif string, place int, residue string, n long"))
    assert {r["motif"] for r in Q.motif_merge(spark, "").collect()} == {"abcde+bcdea"}


def test_evaluation_simulates_ten_thousand_sequences(spark, sf):
    from strandlab.plans.registry import QUERIES

    t = QUERIES["hmm_eval_table"](spark, sf).select("place", "p_100", "e_100").toPandas()
    assert sorted(t["place"]) == list(range(1, 10_001)) and t["e_100"].to_numpy() == pytest.approx(t["p_100"].to_numpy() * 10_000)


def test_motif_refinement_finds_the_planted_word():
    r = np.random.default_rng(8)
    word, seqs = np.array([0, 1, 2, 3, 3, 0]), []
    for _ in range(60):
        s = r.integers(0, 4, 40)
        at = r.integers(0, 34)
        s[at : at + 6] = word
        seqs.append(s)
    start = np.full((6, 4), 1.0)
    start[[0, 1, 2], word[:3]] = 8
    p, _ = O.refine(seqs, start, np.full(4, 0.25))
    assert p.argmax(1).tolist() == word.tolist()


def test_simulation(spark):
    rows = X.challenge(spark, 2, 0.4, seed=11, n=30).collect()
    assert len(rows) == 30 and all(len(r["seq"]) == 600 and 0.2 * 585 <= r["pos"] <= 0.8 * 585 for r in rows)
    words = [r["seq"][r["pos"] : r["pos"] + 15] for r in rows]
    votes = "".join(max("ACGT", key=[w[i] for w in words].count) for i in range(15))
    assert all(sum(a != b for a, b in zip(w, votes)) == 2 for w in words)


def test_rand_index_of_equal_labels(spark):
    cells = spark.createDataFrame([(0, 0, 5), (1, 1, 7), (2, 2, 3)], "i int, j int, n long")
    assert I.adjusted_rand(cells, "i", "j", "n").first()[0] == pytest.approx(1)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_long_batches_are_scored_in_stretches():
    import pandas as pd

    lengths = [3, 4, 20, 1, 1, 6, 2]
    pdf = pd.DataFrame({"seq_id": range(7), "seq": ["a" * n for n in lengths]})
    got = list(H._pieces(pdf, "seq", 8))
    assert [p["seq"].map(len).tolist() for p in got] == [[3, 4], [20], [1, 1, 6], [2]]
    assert pd.concat(got).equals(pdf) and list(H._pieces(pdf.iloc[:0], "seq")) == []
