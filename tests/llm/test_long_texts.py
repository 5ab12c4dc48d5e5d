"""Pipeline stages, token counts and the fits' samples with texts of more than 10 MB."""

import pytest

from strandlab.llm import tokencounts as T


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("long"))
    big = "\n".join(" ".join(f"w{(i * 7919 + k * 31) % 9973}" for k in range(40)) for i in range(50_000))
    assert len(big) > 10_000_000
    near = big.replace("w31 ", "w32 ", 3)
    rows = [(1, "a few words " * 30, "en", "s"), (2, big, "en", "s"), (3, "more words here " * 20, "de", "t"), (4, near, "en", "t")]
    spark.createDataFrame([(i, t, g, s, len(t)) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i != 1), 0) for i in range(1, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_take_long_texts(spark, long_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{long_dir}/documents.parquet")
    out = {name: {r["doc_id"] for r in stage(spark, docs, long_dir).select("doc_id").collect()} for name, stage in P.STAGES}
    assert out["quality_rules"] <= {1, 2, 3, 4} and out["line_dedup"] >= {1, 2, 3} and out["near_duplicates"] == {1, 2, 3}
    assert {2, 4} & out["mix_sources"] and out["pack"] == {1, 2, 3, 4}


def test_long_texts_are_counted_whole(spark, long_dir):
    got = {(r["source"], r["tokenizer"]): r["n_tokens"] for r in T.token_counts(spark, long_dir).collect()}
    assert got["t", T.BPE] > 2_000_000 and got["s", T.BPE] > 2_000_000
    words = {r["doc_id"]: r["tokens"] for r in T.count_words(spark.read.parquet(f"{long_dir}/documents.parquet")).collect()}
    assert words[2] == words[4] == 2_000_000


def test_probes_leave_out_texts_beyond_their_bound(spark, long_dir, monkeypatch):
    """A text longer than all probes together may be is none of them; the others still are."""
    from strandlab.llm import neardup as N

    monkeypatch.setattr(N, "PROBE_CHARS", 5_000)
    docs = spark.read.parquet(f"{long_dir}/documents.parquet")
    probes = N.draw_probes(docs, N.Signer(2, 3), 0.8)
    assert len(probes.keys) == 2
    assert {r["doc_id"]: r["n_links"] for r in N.jaccard_classes(docs).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}
