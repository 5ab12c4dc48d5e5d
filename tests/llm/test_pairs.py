"""Line dedup and near duplicates against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from test_brute_force import classes_of, docs


def all_pairs(text: dict[int, str]) -> dict[int, set[int]]:
    """Lines to delete of each document: aligned blocks of 20 words with any earlier document."""
    from strandlab.llm.linededup import common_blocks

    lines = {i: [x.strip() for x in t.split("\n")] for i, t in text.items()}
    where, out = defaultdict(set), {}
    for i, new in sorted(lines.items()):
        out[i] = set()
        for j in {j for x in new if x for j in where[x]}:
            for a, b in common_blocks(lines[j], new):
                if sum(len(x.split()) for x in new[a:b]) >= 20:
                    out[i] |= set(range(a, b))
        for x in new:
            where[x].add(i)
    return out


def removed(spark, text: dict[int, str]) -> dict[int, set[int]]:
    from strandlab.llm.linededup import dedup_lines

    rows = dedup_lines(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()
    assert all(r["n_removed"] == len(r["removed"] or []) for r in rows)
    return {r["doc_id"]: set(r["removed"] or []) for r in rows}


def part(name: str, n: int) -> str:
    return " ".join(f"{name}{i}" for i in range(n))


def test_line_dedup_equals_all_pairs(spark, sf):
    text = dict(zip(docs(sf).doc_id, docs(sf).text))
    assert removed(spark, text) == all_pairs(text)


def test_block_whose_lines_have_other_first_holders(spark):
    a, b = part("a", 12), part("b", 12)
    text = {1: a, 2: b, 3: f"{a}\n{b}", 4: f"{b}\nx\n{a}", 5: f"{a}\n{b}"}
    got = removed(spark, text)
    assert got == all_pairs(text) and got[5] == {0, 1}


@pytest.mark.parametrize("seed", range(4))
def test_moved_and_repeated_passages(spark, seed):
    """Passages in other orders and numbers: first holders alone don't find all, further rounds do."""
    r = random.Random(seed)
    passages = [[part(f"p{k}l{i}x", r.choice([3, 8, 21])) for i in range(r.randrange(1, 6))] for k in range(12)]
    text = {}
    for i in range(150):
        lines = []
        for p in r.choices(passages, k=r.randrange(1, 7)):
            lines += p + [""] * r.randrange(3) + [part(f"own{i}", r.randrange(1, 4))] * r.randrange(2)
        text[i] = "\n".join(lines)
    assert removed(spark, text) == all_pairs(text)


def test_further_holders_are_tried(spark):
    """The first holder has the passages in another order; one of them is found with the second holder only."""
    x, y = part("x", 30), part("y", 30)
    text = {1: f"{y}\nm\n{x}", 2: x, 3: y, 4: f"{x}\nn\n{y}"}
    got = removed(spark, text)
    assert got == all_pairs(text) and got[4] == {0, 2}


def test_near_duplicates_of_the_corpus(spark, sf):
    from strandlab.llm.neardup import jaccard_classes

    text = dict(zip(docs(sf).doc_id, docs(sf).text))
    want, links = classes_of(text)
    got = jaccard_classes(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want and {r["doc_id"]: r["n_links"] for r in got} == links
    assert {r["doc_id"] for r in got if r["keeper"]} == set(want.values())


def test_percolating_component_in_blocks(spark):
    """A chain of texts, each near the next only, and far ones of other sizes, over many blocks."""
    from strandlab.llm import neardup as N

    words = [f"w{i}" for i in range(700)]
    text = {i: " ".join(words[3 * i : 3 * i + 80 + 60 * (i % 2)]) for i in range(180)}
    old = N.BLOCK_TEXTS
    N.BLOCK_TEXTS = 7
    try:
        got = {r["doc_id"]: r for r in N.jaccard_classes(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    finally:
        N.BLOCK_TEXTS = old
    want, links = classes_of(text)
    assert {i: r["class_id"] for i, r in got.items()} == want and {i: r["n_links"] for i, r in got.items()} == links and len(set(want.values())) < 60


def test_descent_ends_at_the_measured_recall():
    from strandlab.llm.neardup import expected_depth, matched_depth

    assert expected_depth(0.8, 20, 8, 0.9995) == 5
    assert matched_depth({8: 10_000}, 0.8, 20, 8) == 8
    assert matched_depth({8: 9_900, 7: 99, 6: 1}, 0.8, 20, 8, 0.99) == 7
    assert matched_depth({8: 9_000, 6: 1_000}, 0.8, 20, 8) == 6
    assert matched_depth({8: 9_000, 3: 1_000}, 0.8, 20, 8) == matched_depth({8: 40}, 0.8, 20, 8) == matched_depth({}, 0.8, 20, 8) == 5


def test_probes_meet_what_is_near():
    from strandlab.llm import neardup as N

    r, signer = random.Random(3), N.Signer(5, 4)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    texts = [list(base) for _ in range(40)]
    for k, w in enumerate(texts):
        for _ in range(k // 4):
            w[r.randrange(len(w))] = f"x{r.randrange(999)}"
    own = [np.unique(N.shingle_hashes(w)) for w in texts]
    keys, paths = [N.text_key(w) for w in texts], [signer(x) for x in own]
    probes = N.Probes(keys[:10], own[:10], paths[:10], 0.8)
    for key, x, p in zip(keys, own, paths):
        near = [i for i in range(10) if keys[i] != key and len(np.intersect1d(x, own[i])) >= 0.8 * len(np.union1d(x, own[i]))]
        assert probes.meet(key, x, p) == [max(next((d for d in range(4) if a[d] != b[d]), 4) for a, b in zip(paths[i], p)) for i in near]


def test_paths_of_long_texts_agree_as_often_as_the_index():
    """Values of minima over many shingles must still tell texts apart."""
    from strandlab.llm import neardup as N

    signer = N.Signer(20, 8)
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    b = np.concatenate([a[:10_000], r.integers(0, 1 << 63, 10_000, dtype=np.uint64)])  # index 1 / 3
    c = r.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert abs((signer(a) == signer(b)).mean() - 1 / 3) < 0.12 and (signer(a) == signer(c)).mean() == 0


def test_stage_keeps_one_row_of_each_class(spark):
    import corpus_pipeline as P

    one, other = part("a", 60), part("b", 60)
    rows = [(1, one, "en", "s", 1), (1, other, "de", "t", 2), (2, one, "en", "u", 3), (3, one.upper(), "fr", "v", 4), (3, one.upper(), "fr", "v", 4), (None, one, "en", "s", 5), (4, None, None, None, None), (5, "", "en", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in P.near_duplicates(spark, d, "").collect())
    assert got == Counter([(1, one, "en", "s", 1), (1, other, "de", "t", 2), (None, one, "en", "s", 5), (4, None, None, None, None)])


def test_mixed_rows_keep_their_own_columns(spark):
    from strandlab.llm.mixing import mix_documents

    r = random.Random(2)
    rows = [(1, "a b c", "en", "x", None), (1, "a b c", "de", "x", None), (None, None, None, None, None)] + [(r.randrange(40), part("w", r.randrange(1, 30)), r.choice(["en", "de", None]), r.choice(["x", "y", None]), r.randrange(3)) for _ in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(map(tuple, mix_documents(d).collect()))
    have = Counter(rows)
    assert all(got[k] <= 2 * have[k] for k in got) and Counter(map(tuple, mix_documents(d.repartition(5)).collect())) == got


def test_copies_are_systematic(spark, sf):
    """Every source's copies against prefix sums along (size, hash)."""
    from strandlab.llm.mixing import mix

    rows = pd.DataFrame([r.asDict() for r in mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()])
    for _, g in rows.groupby("source"):
        g = g.sort_values(["size", "h", "doc_id"])
        step = g.target.iloc[0] / g.source_size.iloc[0]
        total = g.copies.cumsum().to_numpy()
        # emitted so far: integers crossed by offset + i * step, for one offset in [0, 1)
        low, high = total - np.arange(1, len(g) + 1) * step, total + 1 - np.arange(1, len(g) + 1) * step
        assert low.max() <= high.min() + 1e-9 and high.min() > 0 and low.max() < 1


def test_targets_of_many_sources(spark):
    from strandlab.llm.mixing import source_targets

    r = random.Random(4)
    size = {f"s{i:04d}": r.randrange(0, 50) ** 2 for i in range(300)}
    d = spark.createDataFrame([*size.items(), (None, 70)], "source string, size long")
    got = {x["source"]: x for x in source_targets(d).collect()}
    names = [*sorted(size), None]
    size[None] = 70
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    left, open_, want = 1.5 * sum(size.values()), set(names), {}
    while open_:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        full = {n for n in open_ if share[n] > 2 * size[n]}
        if not full:
            want |= share
            break
        want |= {n: 2.0 * size[n] for n in full}
        left -= sum(2.0 * size[n] for n in full)
        open_ -= full
    assert [got[n]["rank"] for n in names] == list(range(301))
    assert {n: x["target"] for n, x in got.items()} == pytest.approx(want)


@pytest.mark.parametrize(("name", "draw"), [("short", lambda r: 31), ("mixed", lambda r: r.randrange(20, 41)), ("lognormal", lambda r: min(2048, max(1, int(r.lognormvariate(2.8, 0.8)))))])
def test_packing_of_short_documents_stays_distributed(spark, name, draw):
    from strandlab.llm import packing as P

    r = random.Random(1)
    rows = [(i, 0, draw(r)) for i in range(30_000)] + [(7, 0, 20)] * 3000
    df = P.pack_pieces(spark.createDataFrame(rows, "doc_id long, piece int, length long"), per_task=11_000)
    got = df.toPandas()
    full = got.groupby("sequence_id").length.sum()
    ideal = full.sum() / 2048 if name != "short" else 30_000 / 66 + 3000 / 102
    assert Counter(got.doc_id) == Counter(x[0] for x in rows) and full.max() <= 2048 and len(full) <= 1.01 * ideal + 3
    assert (got.sequence_id // (1 << 32)).value_counts().tolist() == [11_000] * 3  # tasks get as many, whatever repeats


def test_next_document_of_uneven_ids(spark):
    """An outlying id, many null ids, and one id with many texts."""
    import hashlib

    from strandlab.llm.fingerprints import fingerprint_documents

    rows = [(i, part(f"t{i}", 12)) for i in range(40)] + [(2**62, part("far", 9)), (-(2**63), part("low", 9))] + [(None, part(f"n{i}", 7)) for i in range(30)] + [(7, part(f"seven{i}", 8)) for i in range(30)] + [(8, part("t8", 12))] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint_documents(d).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(x)) for i, x in rows)
    hashed = {(r["doc_id"], r["text"]): r["h"] for r in d.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hashed[x]))
    want = []
    for (i, x), (_, y) in zip(order, order[1:] + order[:1]):
        want.append((i, hashlib.sha256((x[: len(x) - len(x) // 4] + y[: len(x) // 4]).encode()).hexdigest()))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == Counter(want)


def test_no_sample_decides_which_texts_are_compared(spark, monkeypatch):
    """Pairs at the threshold beside a crowd of closer ones; only the measurement draws texts."""
    from strandlab.llm import neardup as N

    r = random.Random(12)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(900)}" for _ in range(60)]
        far, near = list(base), list(base)
        far[20], near[0] = "x", "y"  # 51 of 61 shingles; 55 of 57
        texts += [base, far, near]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert sum(N.measured(docs).values()) == 2 * 36
    monkeypatch.setattr(N, "draw_probes", None)
    assert [x["n_links"] for x in N.jaccard_classes(docs).orderBy("doc_id").collect()] == [2] * 36
    assert N.expected_depth(N.THRESHOLD, N.TREES, N.DEEPEST, N.EXPECTED) == 4
