"""Clusters, manifests and languages against plain versions and DuckDB SQL."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from strandlab.llm import clustering as C
from strandlab.llm import langid as L
from strandlab.llm import merkle as M


def H(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# ---- clusters


def plain_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in map(float, np.array(v, dtype=np.float32))]) for i, v in rows]
    first = sorted(((H(f"3:{i}"), v) for i, v in kept))[:k]
    c = [v for _, v in first]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    pick = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in kept:
            own[pick(v)].append(v)
        c = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else old for o, old in zip(own, c, strict=True)]
    at = [pick(v) for _, v in kept]
    d = [far(v, c[j]) for (_, v), j in zip(kept, at, strict=True)]
    fits = lambda n: n if n < 1 << 63 else None
    return sorted((i, j, fits(x), fits(sum(y for y, m in zip(d, at, strict=True) if m == j)), fits(sum(d)), H(",".join(map(str, c[j])))) for (i, _), j, x in zip(kept, at, d, strict=True))


@pytest.mark.parametrize("reach", [1.0, 1e6, 1e12, 1e30])
def test_clusters_equal_plain_ones(spark, reach):
    r = random.Random(5)
    rows = [(i, [r.uniform(-reach, reach) for _ in range(64)]) for i in range(90)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(200, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = [tuple(x) for x in C.centroid_clusters(df).collect()]
    assert sorted(got) == plain_clusters(rows)


def test_clusters_are_the_same_at_any_partitioning(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(64)]) for i in range(300)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, C.centroid_clusters(df.coalesce(1)).collect())) == sorted(map(tuple, C.centroid_clusters(df.repartition(9)).collect()))


def test_nearest_is_exact_beyond_float64():
    big = 1 << 26
    x = np.array([[big, 0], [0, 0]], dtype=np.int64)
    at, far = C.nearest(x, [[0, 1], [big, 1]])
    assert at.tolist() == [1, 0] and far.tolist() == [1, 1]
    huge = 1 << 100
    at, far = C.nearest(np.array([[huge, 3]], dtype=object), [[huge + 1, 3], [huge, 2]])
    assert at.tolist() == [0] and far.tolist() == [1]


def test_blocks_hold_what_was_put_in():
    for flat in ([1.5, -1.5, 0.0, 2.0], [40.0, -41.0], [2e6, 3.0], [1e15, 1.0], [1e300, -1e308]):
        kind, raw = C.whole(np.array(flat))
        assert [int(v) for v in C.block(kind, raw, len(flat))[0]] == [math.floor(1024 * x) if abs(1024 * x) < 1e308 else int(x) * 1024 for x in flat]


# ---- manifest


def plain_manifest(docs, fan=8):
    """doc_id, leaf, subroot, root, proof, folded, verified by lists."""

    def leaf(d, text):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d[0], d[3], d[2], d[4], text)))

    lower = str.maketrans(M.UPPER, M.LOWER)
    groups: dict = {}
    for d in docs:
        groups.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf(d, d[1]), d))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
        return out

    def steps(levels, i):
        out = []
        for nodes in levels[:-1]:
            a = i - i % fan
            out.append((nodes[a:i], nodes[i + 1 : a + fan]))
            i //= fan
        return out

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (_, _, own, d) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = steps(trees[g], i) + steps(top, k)
            tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
            h = leaf(d, d[1].translate(lower) if tampered and d[1] is not None else d[1])
            for a, b in path:
                h = H("".join(a) + h + "".join(b))
            root = top[-1][0]
            out.append((str(d[0]), own, trees[g][-1][0], root, H("".join(x for a, b in path for x in a + b)), h, h == root))
    return sorted(out)


def both_manifests(spark, tmp_path, rows):
    d = str(tmp_path)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(5).write.parquet(f"{d}/documents.parquet")
    got = sorted((str(r[0]), *r[1:]) for r in M.merkle(spark, d).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == plain_manifest(rows)
    return got


def test_manifest_equals_plain_one(spark, tmp_path):
    r = random.Random(3)
    words = "Ab c É ß 漢 \n İ".split(" ")
    some = lambda v: None if r.random() < 0.1 else v
    rows = [(some(r.randrange(400)), some("".join(r.choices(words, k=r.randrange(6)))), r.choice(["en"] * 6 + ["de", "é", "", None]), some("s"), some(r.randrange(9))) for _ in range(700)]
    rows += [rows[5]] * 20 + [(900, "X", "one", None, 1), (901, "Y", "two", "s", 1)]
    got = both_manifests(spark, tmp_path, rows)
    assert 0 < sum(x[-1] for x in got) < len(got)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_manifest_of_few_rows(spark, tmp_path, n):
    got = both_manifests(spark, tmp_path, [(i, f"Text {i}", "en", "s", i) for i in range(n)])
    assert n > 1 or got[0][1] == got[0][2] == got[0][3] and got[0][4] == H("")


def test_manifest_of_many_groups(spark, tmp_path):
    both_manifests(spark, tmp_path, [(i, "t", f"lang{i % 75}", "s", i) for i in range(200)])


def test_sql_of_clusters_and_manifest(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for f, sql in ((C.clusters, C.ORACLE), (M.merkle, M.ORACLE)):
        df, found = f(spark, sf), con.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(found.fetchall())


# ---- languages


def plain_grams(text, orders=L.ORDERS):
    """The distinct n-grams as strings."""
    import unicodedata

    if not any(unicodedata.category(c)[0] == "L" for c in text.lower()):
        return set()
    s = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    s = f" {' '.join(s.split(' '))} "
    while "  " in s:
        s = s.replace("  ", " ")
    return {s[i : i + n] for n in orders for i in range(len(s) - n + 1)}


@pytest.mark.parametrize("stretch", [7, 1 << 19])
def test_grams_equal_plain_ones(monkeypatch, stretch):
    monkeypatch.setattr(L, "STRETCH", stretch)
    r = random.Random(1)
    for k in range(150):
        t = "".join(r.choices("aabcdeÉ漢́ \n.,1", k=r.randrange(60))) if k else "One word"
        u = "".join(r.choices("aabcdeÉ漢́ \n.,1", k=r.randrange(60)))
        a, b = L.grams(t), L.grams(u)
        assert len(a) == len(plain_grams(t)) and np.all(a[1:] > a[:-1])
        assert len(np.intersect1d(a, b)) == len(plain_grams(t) & plain_grams(u))


def test_kernel_features_and_regression_equal_plain_ones():
    r = random.Random(2)
    texts = ["".join(r.choices("abcd" if k % 2 else "cdef", k=40)) + " " + "".join(r.choices("ab ef", k=20)) for k in range(60)]
    sets = [plain_grams(t) for t in texts]
    marks = texts[:12]
    k = np.array([[len(a & plain_grams(m)) / math.sqrt(len(a) * len(plain_grams(m))) for m in marks] for a in sets])
    kernel = L.Kernel([L.grams(t) for t in marks])
    got = kernel([L.grams(t) for t in texts])
    assert np.allclose(got, k, atol=1e-6)
    project = L.nystroem(k[:12])
    x = k @ project
    assert np.allclose(x[:12] @ x[:12].T, k[:12], atol=1e-6)  # exact on the landmarks
    y = np.array([i % 2 for i in range(60)])
    w, b = L.ridge(x, y, 2, 0.1)
    target = np.where(y[:, None] == np.arange(2), 1.0, -1.0)
    loss = lambda w, b: ((x @ w + b - target) ** 2).mean(axis=0) + 0.1 * (w**2).sum(axis=0)
    for _ in range(50):
        step = np.random.default_rng(_).normal(size=w.shape) * 1e-3
        assert np.all(loss(w + step, b) >= loss(w, b) - 1e-12)
    assert ((x @ w + b).argmax(axis=1) == y).mean() > 0.95


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    got = L.languages(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    apart = got[got.held_out]
    assert len(got) == 1000 and (apart.lang == apart.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_held_out_rows_do_not_matter(spark, tmp_path):
    """Other texts and languages in the held-out rows change nothing for the rest."""
    from pyspark.sql import functions as F
    from strandlab.llm.ngrams import held_out

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    swapped = docs.withColumn("text", F.when(held_out(3, 1), F.lit("zzz qqq")).otherwise(F.col("text"))).withColumn("lang", F.when(held_out(3, 1), F.lit("xx")).otherwise(F.col("lang")))
    for name, d in (("a", docs), ("b", swapped)):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    a, b = ({r[0]: tuple(r) for r in L.languages(spark, f"{tmp_path}/{n}").where("not held_out").collect()} for n in "ab")
    assert a == b


def test_one_language_and_none(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, lang, want in (("one", "en", {("en", 1.0), ("und", 0.0)}), ("none", None, {("und", 0.0)})):
        spark.createDataFrame([(i, "some words" if i % 2 else "12 !", lang, "s", 1) for i in range(20)], kind).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert {(r["lang_pred"], r["score"]) for r in L.languages(spark, f"{tmp_path}/{name}").collect()} == want
