"""Each operator against a plain version of what it has to compute."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from strandlab.llm.queries import QUERIES

BASE = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def docs(sf):
    return pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def auc(score, y):
    r = pd.Series(np.asarray(score)).rank()
    y = np.asarray(y)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / n1 / n0


def test_packing_round_trip(spark, sf):
    from tokenizers import Tokenizer

    from strandlab.llm.packing import cut, default_vocabulary

    t = Tokenizer.from_file(default_vocabulary()[0])
    got = QUERIES["op1_best_fit_packing"](spark, sf).toPandas()
    want = []
    for i, x in zip(docs(sf).doc_id, docs(sf).text):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), 2048))]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(want)
    g = got.sort_values(["sequence_id", "offset"])
    assert ((g.groupby("sequence_id").length.cumsum() - g.length) == g.offset).all()
    full = g.groupby("sequence_id").length.sum()
    assert full.max() <= 2048 and len(full) <= 1.05 * full.sum() / 2048 + 1


def test_packing_in_several_tasks(spark):
    from strandlab.llm.packing import pack_pieces

    r = random.Random(1)
    rows = [(i, 0, r.randrange(1, 900)) for i in range(3000)]
    p = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    got = pack_pieces(p, per_task=400, open_bins=16).toPandas()
    assert sorted(got.doc_id) == list(range(3000))
    g = got.sort_values(["sequence_id", "offset"])
    assert ((g.groupby("sequence_id").length.cumsum() - g.length) == g.offset).all()
    assert g.groupby("sequence_id").length.sum().max() <= 2048
    assert g.sequence_id.nunique() <= 1.06 * g.length.sum() / 2048 + 2


def test_best_fit_is_best_fit():
    from strandlab.llm.packing import BestFit

    r = random.Random(2)
    bins, model = BestFit(50, 5), []  # model: lists of lengths of open bins
    for k in range(2000):
        n = r.randrange(1, 51)
        fits = [b for b in model if 50 - sum(b) >= n]
        closed = None
        if fits:
            b = max(fits, key=sum)
            assert sum(b) == max(map(sum, fits))
        else:
            if len(model) == 5:
                closed = max(map(sum, model))
                model.remove(max(model, key=sum))
            model.append(b := [])
        b.append(n)
        got = bins.add((k, n), n)
        if got is not None and closed is not None:
            assert sum(x[0][1] for x in got) == closed
        if sum(b) == 50 and closed is None:
            assert sum(x[0][1] for x in got) == 50
            model.remove(b)


def test_fast_encoder_equals_tokenizers():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from strandlab.llm.packing import default_vocabulary, token_encoder

    both = token_encoder(*default_vocabulary()), token_encoder(default_vocabulary()[0], None)
    plain = st.text(alphabet=[chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250), 0x2019, 0x20AC]], max_size=60)

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(plain, st.text(max_size=40)))
    def same(text):
        assert both[0](text).tolist() == both[1](text).tolist()

    same()


def test_line_dedup(spark, sf):
    got = QUERIES["op2_line_dedup"](spark, sf).toPandas().set_index("doc_id")
    first, text = {}, docs(sf).set_index("doc_id").text
    for i, x in text.items():
        for line in x.split("\n"):
            first.setdefault(line.strip(), i)
    for i, r in got.iterrows():
        lines = text[i].split("\n")
        gone = set() if r.removed is None else set(r.removed)
        assert r.text == "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert all(first[lines[k].strip()] < i for k in gone)  # an earlier document keeps each deleted line
        kept = [x for k, x in enumerate(lines) if k not in gone and len(x.split()) >= 20]
        assert all(first[x.strip()] == i for x in kept)  # no long line of an earlier document stays


def test_patience_blocks():
    from strandlab.llm.linededup import common_blocks, patience_matches

    assert common_blocks(list("abcdef"), list("xbcdyef")) == [(1, 4), (5, 7)]
    assert common_blocks(list("aab"), list("aab")) == [(0, 3)]
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randrange(12))] for _ in range(2))
        m = patience_matches(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))


def test_line_dedup_passage_in_many(spark):
    from strandlab.llm.linededup import dedup_lines

    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own {i} line\n{passage}\nshared short\nlast {i}") for i in range(300)]
    out = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(passage in x for x in out.values()) == 1 and passage in out[0]
    assert all(f"own {i} line" in out[i] and f"last {i}" in out[i] for i in out)


def test_line_dedup_passage_whose_lines_were_elsewhere_first(spark):
    """Passages of several short lines in many documents; each line has another first holder."""
    from strandlab.llm.linededup import dedup_lines

    part = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    three, tail = [part(c, 18) for c in "abc"], [part("d", 12), part("e", 12), part("f", 5)]
    early = [*three, "\n".join(tail[:2]), tail[2]]
    rows = [(i, x) for i, x in enumerate(early)]
    rows += [(10 + i, "\n".join([f"own {i} line", *three, f"middle {i}", *tail, f"last {i}"])) for i in range(100)]
    out = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == x for i, x in enumerate(early))
    assert out[10] == "\n".join(["own 0 line", *three, "middle 0", tail[2], "last 0"])
    assert all(out[10 + i] == f"own {i} line\nmiddle {i}\nlast {i}" for i in range(1, 100))


def test_line_windows_cover_every_line_of_a_block():
    from strandlab.llm.linededup import spans

    r = np.random.default_rng(6)
    for _ in range(300):
        w = r.integers(0, 24, r.integers(1, 12))
        for s in range(len(w)):
            for e in range(s + 1, len(w) + 1):
                if w[s:e].sum() >= 20:
                    held = {k for a, b in spans(w, 20) if s <= a and b <= e for k in range(a, b)} | {k for k in range(s, e) if w[k] >= 20}
                    assert all(k in held for k in range(s, e) if w[k])


def test_mixing(spark, sf):
    d = docs(sf)
    got = QUERIES["op3_mixing"](spark, sf).toPandas()
    again = QUERIES["op3_mixing"](spark, sf).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    m = got.merge(d, on="doc_id")
    assert (m["size"] == m.text.map(lambda t: len(BASE.findall(t)))).all()
    assert (m.taken <= 2 * m["size"]).all() and (m.taken % m["size"].clip(lower=1) == 0).all()
    size = m.groupby("source")["size"].sum().sort_index()
    weight = dict(zip(size.index, [5, 2, 1] * len(size)))
    target, open_, left = {}, set(size.index), 1.5 * size.sum()
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    for s, g in m.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(target[s])
        assert abs(g.taken.sum() - target[s]) <= 2 * g["size"].max()


def test_mixed_rows(spark, edge):
    from strandlab.llm.mixing import mix, mix_documents

    taken = mix(edge).selectExpr("sum(copies)").first()[0]
    assert mix_documents(edge).count() == taken


def test_mixing_does_not_depend_on_partitions(spark, sf):
    from strandlab.llm.mixing import mix

    d = spark.read.parquet(f"{sf}/documents.parquet")
    one = {r["doc_id"]: r["copies"] for r in mix(d).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert {r["doc_id"]: r["copies"] for r in mix(d.repartition(7)).collect()} == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(("name", "label", "mod", "fold", "least"), [("op4_quality_classifier", "quality", 3, 1, 0.97), ("op5_toxicity", "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, name, label, mod, fold, least):
    sf = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, sf).toPandas()
    held = got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % mod == fold)
    assert (held == got.held_out).all() and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    m = got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert auc(m.score, m[label]) > least


def test_descent_reaches_the_optimum():
    """The primal loss at w equals the dual value, which no multipliers can exceed: the gap bounds the error."""
    from strandlab.llm.quality import dual_coordinate_descent

    r = np.random.default_rng(1)
    x = [np.sort(r.choice(50, 6, replace=False)).astype(np.uint32) for _ in range(80)]
    y = np.array([int((v < 25).sum() > 3) for v in x])
    value, cost = r.normal(size=1 << 18), r.uniform(0.2, 0.8, 80)
    s = np.where(y == 1, 1.0, -1.0)

    def loss(w):
        margin = np.array([w[v] @ value[v] / np.sqrt(len(v)) for v in x])
        return w @ w / 2 + (cost * np.maximum(0, 1 - s * margin)).sum()

    w = dual_coordinate_descent(x, value, y, cost, epochs=2000)
    best = loss(w)
    for _ in range(200):
        step = np.zeros_like(w)
        step[:50] = r.normal(size=50) * r.choice([0.001, 0.01, 0.1])
        assert loss(w + step) >= best - 1e-4


def test_isotonic_is_monotone():
    from strandlab.llm.toxicity import isotonic

    r = np.random.default_rng(2)
    s = r.normal(size=400).round(1)
    at, p = isotonic(s, (s + r.normal(size=400) > 0).astype(int), np.ones(400))
    assert (np.diff(at) >= 0).all() and (np.diff(p) >= 0).all() and 0 < p.min() < p.max() < 1


def test_quality_counts(spark, sf):
    got = QUERIES["op6_quality_rules"](spark, sf).toPandas().set_index("doc_id")
    for i, x in zip(docs(sf).doc_id, docs(sf).text):
        w = BASE.findall(x)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(tri)
        rep = {k + j for k, t in enumerate(tri) if n[t] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in x.split("\n"):
            if BASE.search(line):
                dup += line in seen
                seen.add(line)
        r = got.loc[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(rep)]
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_token_rollup(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    from strandlab.llm import tokencounts as T
    from strandlab.llm.packing import default_vocabulary

    t = Tokenizer.from_file(default_vocabulary()[0])
    low = set(pd.read_parquet(f"{sf}/labels.parquet").query("quality == 0").doc_id)
    want = defaultdict(lambda: [0, 0])
    for r in docs(sf).itertuples():
        if r.doc_id not in low:
            want[(r.source, r.lang)][0] += 1
            want[(r.source, r.lang)][1] += len(t.encode(r.text, add_special_tokens=False).ids)
    got = {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in QUERIES["op7_token_counts"](spark, sf).collect()}
    assert got == {k: v for k, v in want.items() if v[0]}
    # idempotent, order-free, and the same after compaction
    roll = T.Rollup(spark, f"file://{tmp_path}/r")
    rows = lambda *x: spark.createDataFrame(x, "source string, lang string, tokenizer string, tokens long, sign int")
    a, b = rows(("s", "en", "v1", 5, 1), ("s", "en", "v1", 7, 1)), rows(("s", "en", "v1", 5, -1), (None, "en", "v2", 4, 1))
    assert roll.commit("b", b) and roll.commit("a", a) and not roll.commit("a", a)
    total = lambda: sorted(map(str, roll.totals().collect()))
    before = total()
    roll.compact()
    assert total() == before and not roll.commit("b", b) and total() == before and len(before) == 2


def shingles(x):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def test_fingerprints(spark, sf):
    got = QUERIES["op8_fingerprints"](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    text = docs(sf).text.tolist()
    error = []
    for i, x in enumerate(text):
        y = text[(i + 1) % len(text)]
        k = len(x) // 4
        e = x[: len(x) - k] + y[:k]
        assert got.n_chars[i] == len(x) and got.edited_sha256[i] == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = shingles(x), shingles(e), shingles(y)
        error += [got.near_edited[i] - len(a & b) / len(a | b), got.near_next[i] - len(a & c) / len(a | c)]
    assert abs(np.mean(error)) < 0.02 and np.abs(error).mean() < 0.06
    same = defaultdict(set)
    for x, f in zip(text, got.fingerprint):
        same[x].add(f)
    assert all(len(f) == 1 for f in same.values())


def classes_of(text):
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)]) for i, w in ((i, re.findall(r"\w+", x.lower())) for i, x in text.items())}
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = defaultdict(set)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in where[g] if j < i).items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                root[max(find(i), find(j))] = min(find(i), find(j))
                if sets[i] != sets[j]:
                    links[i].add(sets[j])
                    links[j].add(sets[i])
    return {i: find(i) for i in sets}, {i: len(links[i]) for i in sets}


def test_near_duplicates(spark):
    r = random.Random(5)
    text = {}
    for c in range(25):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice([30, 120, 400]))]
        for k in range(r.choice([1, 2, 8, 40])):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 40) + 1)):
                w[r.randrange(len(w))] = f"x{r.randrange(4000)}"
            text[c * 100 + k] = " ".join(w)
    text |= {9000: "", 9001: "", 9002: "a b", 9003: "A  b!"}
    from strandlab.llm import neardup as N

    old = N.BLOCK_TEXTS
    N.BLOCK_TEXTS = 10  # so that classes are split over pairs of blocks
    try:
        got = {x["doc_id"]: x for x in N.jaccard_classes(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    finally:
        N.BLOCK_TEXTS = old
    want, links = classes_of(text)
    assert {i: x["class_id"] for i, x in got.items()} == want
    assert {i: x["n_links"] for i, x in got.items()} == links


def test_components(spark):
    from strandlab.llm.graph import components

    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2000 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in root if any(i in e and e[0] != e[1] for e in edges)}


def test_licenses(spark, sf):
    got = QUERIES["op10_license_scan"](spark, sf).toPandas().set_index("doc_id")
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for i, x in zip(docs(sf).doc_id, docs(sf).text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x))
        at = [(k, v) for p, v in phrases.items() for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p]
        r = got.loc[i]
        assert r.n_words == len(w) and r.n_base == len(at) and r.base_labels == ",".join(sorted({v for _, v in at}))
        if at:
            assert (r.first_word, r.last_word) == (min(at)[0], max(at)[0])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_diagonals(spark):
    from strandlab.llm.licenses import scan_licenses

    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    changed = bsd.replace("source and", "source code and").replace("permitted provided", "permitted, provided")
    rows = [(1, "some words " + bsd + " more"), (2, changed + " x " + bsd), (3, "use in source and binary forms"), (4, " ".join(reversed(bsd.split())))]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3, 4)] == ["bsd", "bsd", "", ""] and 0 < got[3]["score"] < 0.7 and got[4]["score"] == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{sf}/documents.parquet")
    rules = QUERIES["op6_quality_rules"](spark, sf).where("kept").select("doc_id")
    a = P.STAGES[0][1](spark, d, sf).toPandas()
    assert sorted(a.doc_id) == sorted(r[0] for r in rules.collect())
    b = P.STAGES[1][1](spark, spark.createDataFrame(a, d.schema), sf).toPandas()
    assert set(b.doc_id) <= set(a.doc_id) and (b.n_chars == b.text.str.len()).all()
    c = P.STAGES[2][1](spark, spark.createDataFrame(b, d.schema), sf).toPandas()
    assert sorted(c.doc_id) == sorted(set(classes_of(dict(zip(b.doc_id, b.text)))[0].values()))
    e = P.STAGES[3][1](spark, spark.createDataFrame(c, d.schema), sf).toPandas()
    words = e.text.map(lambda t: len(BASE.findall(t))).sum() / c.text.map(lambda t: len(BASE.findall(t))).sum()
    assert abs(words - 1.5) < 0.1 and e.groupby("doc_id").size().max() <= 2
    f = P.run(spark, sf).toPandas()
    assert Counter(f[f.piece == 0].doc_id) == Counter(e.doc_id)
